"""Quality by supervised subword embeddings.

Features of a text: every word, every pair of neighbouring words and every 3- to 4-gram of its characters
(case kept). Each is hashed
to one of 2**BITS rows of a table of vectors; the mean over all features of a document, repeats counted,
goes through a linear layer and a softmax over two classes. Vectors and layer are learnt by numpy
stochastic gradient descent, one document a step, on a bounded sample on the driver. Steps are scaled by
the sum of squared feature shares, so that long and short documents move their outcome alike. Classes
are sampled alike; the output's bias is then moved to their shares among all labelled rows.

As the layer is linear, a row's vector counts only by its product with the difference of the layer's two
columns: scoring takes the mean of one float a feature (2**BITS floats broadcast, 1 MB).

Defined cases: null and empty texts have no features and score by the bias alone; repeated rows repeat;
an empty table gives no rows; without labelled rows of both classes every score is the share of label 1.
Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.labelled import fold, sample
from quarry.llm.text import char_grams, mix64, word_hashes

BITS, GRAMS, DIM = 18, range(3, 5), 8
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 20_000_000  #: training rows a class at most, and about how many characters of them together
EPOCHS, RATE, SEED = 4, 0.5, 7


def features(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Buckets of all features, in blocks, repeats included."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    shift = np.uint64(64 - bits)
    if len(words):
        yield (words >> shift).astype(np.uint32)
    if len(words) > 1:
        yield (mix64(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.uint32)
    if text:
        yield from char_grams(text, GRAMS, bits)


def train(texts: list[str], y: np.ndarray, share: float, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Score of each bucket's vector, and the bias: of label 1 against 0."""
    odds = lambda p: np.log(p / (1 - p))
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << bits, np.float32), float(odds(share))
    docs = []
    for t in texts:
        found = list(features(t, bits))
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint32), np.empty(0))
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.array([(y == 0).sum(), (y == 1).sum()]))  # both classes weigh alike
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, part = docs[i]
            rows = vectors[ids]
            mean = part @ rows
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            p *= rate * weight[int(y[i])]
            norm = max(float(part @ part), 1e-6)
            vectors[ids] = rows - np.outer(part / norm, layer @ p).astype(np.float32)
            layer -= np.outer(mean, p)
            bias -= 0.1 * p
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0] + odds(share))


def logit(text: str | None, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for x in features(text or ""):
        total += float(table[x].sum(dtype=np.float64))
        n += len(x)
    return bias + (total / n if n else 0.0)


def score(docs: DataFrame, table: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((table, bias))  # 4 * 2**BITS bytes
    given = docs.select(id_col, F.col(text_col).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, b = shared.value
        for batch in batches:
            z = np.array([logit(x.as_py(), t, b) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[id_col, "score"])

    return given.mapInArrow(work, given.drop("__text").schema.add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, out_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of the held-out fold are never seen."""
    held_out = fold("doc_id", folds) == out_fold
    scored = score(docs, *train(*sample(docs, labels, "quality", held_out, SAMPLE_ROWS, SAMPLE_CHARS)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
