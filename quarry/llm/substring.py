"""Substring dedup: windows of words that an earlier document has, by FM-indexes over shards.

A window is ``window`` consecutive words. It counts as repeated where its words also start in a document
with a smaller id. Which shard must know a window follows from its content: the least hash among its runs
of GRAM words, its anchor. Documents are cut into segments, maximal runs of windows with one anchor;
anchors that only one text has are dropped, so that the shards hold the repeated parts of the corpus and
no more. Equal texts count once, equal segments of a batch once with the least id that has them. Each shard builds
an FM-index over its segments; the segments of its documents are streamed against it by backward search over its
wavelet tree, which gives every position its matching statistic up to the window's length and, where it has that, the
range of suffixes and the least id among them. Windows whose least id is smaller are reported as intervals of words. (As
a segment is one of those that the index is made of, its matches are as long as it allows; ``FMIndex.matching`` takes any.)

Bounds: a shard is cut at SHARD_WORDS words, at a change of anchor; the segments of an anchor with over HOT
are split into their single windows, which are routed by their own hash. Shuffles carry anchors
(8 bytes, about one in five words), segments of repeated anchors, and texts of documents that have any.

Defined cases: ids are whole numbers, and a text that isn't one fails as an id; null and empty texts have no words; of rows with equal text the least id counts as the
first, and rows with that id are no repeats of each other; a null id is neither repeated nor a repeat's
origin; an empty table gives no rows; other columns are carried along or ignored, as stated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import named, numbered
from quarry.llm.fmindex import FMIndex
from quarry.llm.text import shingle_hashes, word_hashes
from quarry.plans.shared import Scratch, materialize

WINDOW, GRAM = 13, 5
SHARD_WORDS, HOT = 1_000_000, 20_000


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the least hash of its runs of GRAM words."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    least, size, want = shingle_hashes(words, min(GRAM, window)), 1, window - min(GRAM, window) + 1
    while size < want:
        step = min(size, want - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return least


def survey(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """A row a document: id, digest of the text, n_words, the hash of its words joined by one space, its anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts, clean, anchors = [], [], [], []
            for t in b.column(1):
                data = (t.as_py() or "").encode()
                words = data.split()
                digests.append(hashlib.md5(data).digest())
                counts.append(len(words))
                clean.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(window_anchors(word_hashes(data), window)).view(np.int64))
            flat = np.concatenate(anchors) if anchors else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(clean, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "digest", "n_words", "clean_sha256", "anchors"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(work, "id long, digest binary, n_words long, clean_sha256 string, anchors array<long>")


SEGMENT = "id long, key long, start int, segment_id binary, anchor long, segment binary"
_ARROW = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())


def _rows(rows: list[tuple], schema: str = SEGMENT, types: tuple = _ARROW) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def segments(texts: DataFrame, window: int) -> DataFrame:
    """(id, key, text, anchors) -> where segments with these anchors start (id, key, start, segment_id) and, with a
    null start, the segments themselves (least id of the batch, segment_id, anchor, segment). key tells texts apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, bodies = [], {}
            for id_, of, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data = text.as_py().encode()
                words, anchors = data.split(), window_anchors(word_hashes(data), window)
                edges = np.flatnonzero(np.diff(anchors, prepend=~anchors[:1], append=~anchors[-1:]))
                runs = anchors[edges[:-1]].view(np.int64)
                at = np.flatnonzero(np.isin(runs, wanted.values.to_numpy()))
                for a, e, anchor in zip(edges[at].tolist(), edges[at + 1].tolist(), runs[at].tolist(), strict=True):
                    body = b" ".join(words[a : e + window - 1])
                    key = xxhash.xxh3_128_digest(body)
                    rows.append((id_, of, a, key, None, None))
                    if key not in bodies or id_ < bodies[key][0]:
                        bodies[key] = (id_, None, None, key, anchor, body)
            yield _rows(rows + list(bodies.values()))

    return texts.select("id", "key", "text", "anchors").mapInArrow(work, SEGMENT)


def single_windows(bodies: DataFrame, window: int) -> DataFrame:
    """Segments cut into their windows: (of, at) name segment and place, the rest are rows like segments."""
    schema, types = "of binary, at int, id long, segment_id binary, anchor long, segment binary", (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, key, segment in zip(*(b.column(c).to_pylist() for c in ("id", "segment_id", "segment")), strict=True):
                words = segment.split()
                for j in range(len(words) - window + 1):
                    body = b" ".join(words[j : j + window])
                    own = xxhash.xxh3_128_digest(body)
                    out.append((key, j, id_, own, int.from_bytes(own[:8], "little", signed=True), body))
            yield _rows(out, schema, types)

    return bodies.mapInArrow(work, schema)


def search_shards(bodies: DataFrame, window: int) -> DataFrame:
    """(id, segment_id, anchor, segment) -> segment_id and the least id of each of its windows."""

    def shard(found: dict[bytes, list]) -> pa.RecordBatch:
        symbol: dict[bytes, int] = {}
        split = [body.split() for body, _ in found.values()]
        text = np.fromiter((s for words in split for s in (*(symbol.setdefault(w, len(symbol) + 1) for w in words), 0)), np.int64)
        sizes = np.array([len(w) for w in split])
        starts = np.cumsum(sizes + 1) - sizes - 1
        index = FMIndex(text, np.repeat(np.array([i for _, i in found.values()], np.int64), sizes + 1), window)
        _, least = index.matching(text, starts, sizes)
        lengths = sizes - window + 1
        values = least[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["segment_id", "least"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words, last = {}, 0, None
        for b in batches:
            for anchor, key, body, id_ in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if words > SHARD_WORDS and anchor != last:
                    yield shard(found)
                    found, words = {}, 0
                if key not in found:
                    found[key] = [body, id_]
                    words += body.count(b" ") + 2
                elif id_ < found[key][1]:
                    found[key][1] = id_
                last = anchor
        if found:
            yield shard(found)

    dealt = bodies.select("anchor", "segment_id", "segment", "id").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, "segment_id binary, least array<long>")


def repeated_windows(docs: DataFrame, window: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, digest) and the first words of its repeated windows, for the first document of each text; the survey, without
    anchors; and the least id (rep) of each text."""
    some = scratch.table(survey(docs, window, id_col, text_col), "sub-survey")
    known = scratch.table(some.drop("anchors"), "sub-known")
    reps = known.where("id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    some = some.where("id is not null")
    each = some.select(F.xxhash64("digest").alias("text"), F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("anchor")  # of two texts at least
    where = some.select("id", F.explode("anchors").alias("anchor")).join(shared.hint("shuffle_hash"), "anchor")
    wanted = scratch.table(where.groupBy("id").agg(F.collect_list("anchor").alias("anchors")), "sub-anchors")
    first = known.select("id", "digest").join(reps, "digest").where("id = rep").select("id", "digest", F.xxhash64("digest").alias("key")).dropDuplicates(["digest"])
    wanted = scratch.table(wanted.join(first, "id"), "sub-wanted")
    scratch.drop("sub-anchors", "sub-survey")

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted.hint("shuffle_hash"), "id").where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("digest"))
    parts = scratch.table(segments(texts, window), "sub-segments")
    scratch.drop("sub-wanted")

    bodies = parts.where("segment is not null")
    hot = scratch.table(bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"), "sub-hot")
    found = search_shards(bodies.join(hot, "anchor", "left_anti"), window)
    if not hot.isEmpty():
        windows = scratch.table(single_windows(bodies.join(hot, "anchor", "left_semi").select(*parts.columns), window), "sub-windows")
        least = windows.select("of", "at", "segment_id").distinct().join(search_shards(windows, window), "segment_id")
        found = found.unionByName(least.groupBy(F.col("of").alias("segment_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("least")[0].alias("m")))), lambda x: x["m"]).alias("least")))
    found = scratch.table(found, "sub-found")

    starts = F.filter(F.transform("least", lambda m, j: F.when(m < F.col("id"), F.col("start") + j)), lambda x: x.isNotNull())
    hits = parts.where("start is not null").select("id", "key", "start", "segment_id").join(found, "segment_id").select("id", "key", starts.alias("starts")).where(F.size("starts") > 0)
    hits = hits.groupBy("id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts")).join(first, ["id", "key"]).select("id", "digest", "starts")
    hits = scratch.table(hits, "sub-hits")
    scratch.drop("sub-segments", "sub-hot", "sub-windows", "sub-found")
    return hits, known, reps


def removed(words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in a window that begins at one of ``starts``."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, words), -1)
    return np.cumsum(change)[:words] > 0


def _apply(docs: DataFrame, hits: DataFrame, window: int, id_col: str, text_col: str, how: str, texts: bool) -> DataFrame:
    """Joins documents with their windows: (all columns of docs, __removed, __kept) with kept words or their hash."""
    names = docs.columns
    given = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__digest", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    joined = given.join(hits.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("starts").alias("__starts")).hint("shuffle_hash"), ["__id", "__digest"], how)
    joined = numbered(joined.select(*map(named, names), "__starts"))
    schema = joined.drop(joined.columns[-1]).schema.add("removed", "long").add("kept", "string")
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, kept = [], []
            for text, starts in zip(b.column(at), b.column(len(names)), strict=True):
                text = text.as_py()
                words = (text or "").encode().split()
                gone = removed(len(words), starts.values.to_numpy().astype(np.int64), window) if starts.is_valid else np.zeros(len(words), bool)
                counts.append(int(gone.sum()))
                if not texts:
                    kept.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
                elif counts[-1]:
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode())
                else:
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return joined.mapInArrow(work, schema).toDF(*names, "__removed", "__kept")


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    scratch = Scratch(docs.sparkSession)
    hits, known, reps = repeated_windows(docs, window, id_col, text_col, scratch)
    changed = _apply(docs.select(id_col, text_col), hits, window, id_col, text_col, "inner", texts=False)
    digest = F.unhex(F.md5(F.col(text_col).cast("binary")))
    changed = scratch.table(changed.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.col("__removed").alias("n_removed"), F.col("__kept").alias("kept")).dropDuplicates(["id", "digest"]), "sub-changed")
    out = known.select("id", "digest", "n_words", "clean_sha256").join(reps, "digest", "left").join(changed, ["id", "digest"], "left")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= window)  # all its windows start in the first document of its text
    out = out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "clean_sha256")).alias("kept_sha256"),
    )
    out = materialize(out, "sub-digests")
    scratch.drop()
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs; repeated words are taken from the text, the rest joined by one space.

    Texts without repeats stay as they are.
    """
    scratch = Scratch(docs.sparkSession)
    hits, known, reps = repeated_windows(docs, window, id_col, text_col, scratch)
    copies = known.join(reps, "digest").where((F.col("id") > F.col("rep")) & (F.col("n_words") >= window)).select("id", "digest", F.sequence(F.lit(0), (F.col("n_words") - window).cast("int")).alias("starts")).dropDuplicates(["id", "digest"])
    hits = materialize(hits.unionByName(copies), "sub-all-hits")
    scratch.drop()
    out = _apply(docs, hits, window, id_col, text_col, "left", texts=True)
    return out.select(*[F.col("__kept").alias(c) if c == text_col else named(c) for c in docs.columns])
