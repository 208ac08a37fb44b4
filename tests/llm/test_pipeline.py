"""The stages one by one: each works on what the one before kept, and its decisions take effect."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = i % 10 == 3
        if toxic:
            t[5] = "scumbag"
        text = " ".join(t)
        if i % 10 == 5:
            text += " " + passage
        if i % 10 == 7:
            text = rows[-1][1] + " extra"
        rows.append((i, text, "en", rng.choice("abc"), len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "no id at all", "en", "a", 12)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    out = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns and after.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
            path = f"{folder}/{name}.parquet"
            after.write.mode("overwrite").parquet(path)
            after = spark.read.parquet(path)
        out[name] = after.collect()
        before = after
    toxic = {i for i in range(300) if i % 10 == 3}
    assert {r.doc_id for r in out["toxicity"]} == {r[0] for r in rows} - toxic
    copies = {i for i in range(300) if i % 10 == 7}
    assert {r.doc_id for r in out["near_dedup"]} == {r[0] for r in rows} - toxic - copies
    assert len(out["substring_dedup"]) == len(out["near_dedup"])
    before_text = {r.doc_id: r.text for r in out["near_dedup"]}
    for r in out["substring_dedup"]:
        if r.doc_id is not None and r.doc_id % 10 == 5 and r.doc_id != 5:
            assert before_text[r.doc_id].startswith(r.text) and len(r.text.split()) <= len(before_text[r.doc_id].split()) - 60
            assert r.n_chars == len(r.text)
        else:
            assert r.text == before_text[r.doc_id]
    text = {r.doc_id: r.text or "" for r in out["mixing"]}
    assert 0 < len(out["mixing"]) <= 2 * len(out["substring_dedup"])
    assert len(out["bpe"]) == len(out["mixing"])
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in out["bpe"])


def test_run(spark, tables):
    folder, _ = tables
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_odd_tables(spark, tables, tmp_path):
    """Every stage on an empty table, and on repeated rows with further columns whose names hold dots and spaces."""
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for given in (docs.limit(0), docs.where("doc_id < 40").unionByName(docs.where("doc_id < 10")).withColumns({"a.b": F.lit(1), "c d": F.lit("x"), "score": F.lit(0.5), "size": F.lit(1)})):
        before, rows = given, given.count()
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, before, folder)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == given.columns
                path = f"{tmp_path}/{rows}-{name}.parquet"
                after.write.parquet(path)
                before = spark.read.parquet(path)
                assert (before.count() > 0) == (rows > 0)
            else:
                assert (after.count() > 0) == (rows > 0)
