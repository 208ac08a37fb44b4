"""What a worker takes, in a process of its own, and that smaller runs give the same."""

import random
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle

import corpus_pipeline
from quarry.llm import bpe
from quarry.llm.queries import rank_file

#: MB by which the peak grows from a short text to 3.2 million characters, nearly all of whose words differ.
PEAK = """
import pickle, random, resource, sys
import pyarrow as pa
work = pickle.load(open(sys.argv[1], "rb"))
batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = random.Random(5)
given = batch([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4_000)) for _ in range(100)])
list(work(iter([batch(["a short text"])])))
before = peak()
assert sum(b.num_rows for b in work(iter([given]))) == 100
print(peak() - before)
"""


def test_tokenize(spark, documents, monkeypatch, tmp_path):
    """The last stage of the pipeline: its runs are bounded, whatever the table has."""
    docs, taken = documents([(1, "a", "s")]), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: taken.append(work) or self)
    corpus_pipeline.tokenize(spark, docs, "")
    (tmp_path / "work").write_bytes(cloudpickle.dumps(taken[0]))
    run = subprocess.run([sys.executable, "-c", PEAK, tmp_path / "work"], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 260


@pytest.mark.parametrize("part", [8, 10_000_000])
def test_parts(documents, part):
    """Runs, queries and their rows of any part, down to one text, one piece and one round."""
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    rng = random.Random(4)
    texts = ["", "thnterreed qzorblex, qzorblex", "  two\n\nlines wzzyxq's", "ab" * 150 + "=-" * 90, "".join(rng.choices("abcdefghij", k=130)), "漢字仮名 é"]
    got = bpe.encode(documents(texts + [None]), rank_file(), public_tokenizers.PATTERN, memo=3, part=part).collect()
    assert {r.doc_id: r.ids for r in got} == dict(enumerate(map(want.encode_ordinary, [*texts, ""])))
