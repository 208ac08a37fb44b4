"""Approximate nearest neighbours by largest inner product: adaptive dimension scan within probed lists.

Index: equal vectors become one class with its smallest ids (as many as a result can use), classes are
dealt to lists by the nearest of a few directions (spherical k-means on a bounded sample), and each list
is cut into blocks of bounded size, one binary row a block. Every valid row is indexed.

Search: a query goes to the lists whose directions are nearest to it; how many is tuned on the sample so
that these lists hold 98 % of the sample's true neighbours. The nearest of them, as many as it takes to hold k others,
are scanned first; the k-th best product found there is a bound that goes along to the rest of them. Queries of one
list are packed, and each pack meets each block of its list once. There vectors are rotated at random and scanned in
blocks of columns: after each block a candidate is abandoned whose partial squared distance, as a sample of the whole,
says at risk RISK that its product stays below the query's bound, which is the one brought along or, if better, the
k-th best exact product among the LEAD * k candidates that lead after the first block. What is left, and the k best of
these leaders, is scored in double precision on the original vectors.

Defined cases: rows whose id or vector is null, whose vector is zero, or has a null or non-finite
component take no part, as query or candidate; nor do vectors of another length than the most frequent
(ties: the shorter). Rows that share an id count once, with the least vector. Every query gets k rows, or all
candidates where there are fewer. Equal scores go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.shared import materialize

SAMPLE, TUNE = 20_000, 400  #: vectors that fit the directions; queries of these that tune the probes
LISTS_MOST, BLOCK, PACK = 4_096, 1_024, 256
COLUMNS = 16  #: dimensions of a column block
RISK, LEAD = 1.2, 6  #: of the tests; candidates per result that set the bound
SLACK = 1e-5  #: for single precision, of the squared norms
COVER, SEED = 0.98, 11


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(ok)
    good = materialize(good.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (most[0]["d"] if most else 0))


def fit_directions(x: np.ndarray, lists: int, k: int) -> tuple[np.ndarray, int]:
    """Unit directions (one a list), and how many lists a query must probe to cover its k best in the sample."""
    rng = np.random.default_rng(SEED)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(12):
        near = (unit @ c.T).argmax(1)
        for j in range(len(c)):
            m = unit[near == j].sum(0)
            if n := np.linalg.norm(m):
                c[j] = m / n
    near = (unit @ c.T).argmax(1)
    q = rng.choice(len(x), min(TUNE, len(x)), replace=False)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    best = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, :k] if len(x) > k else np.argsort(-s, axis=1)[:, :-1]
    order = np.argsort(np.argsort(-(x[q] @ c.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, near[best], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(COVER * len(ranks))))]) + 1 if len(ranks) else len(c)
    return c, min(len(c), probes)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scan(q: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, brought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that hold every query's k best of the block, but for what the tests abandon. Where nothing
    was ``brought`` (a bound a query, -inf for none) there are at least k of each query, or all of the block."""
    qr, xr = (q @ turn).astype(np.float32), (x @ turn).astype(np.float32)
    d = q.shape[1]
    edges = [*range(0, d, COLUMNS), d]
    upto = lambda m: np.concatenate([np.zeros((len(m), 1)), (m.astype(np.float64) ** 2).cumsum(1)], axis=1).astype(np.float32)  # noqa: E731  squared norm of the first columns
    qn, xn = upto(qr), upto(xr)
    part = qr[:, : edges[1]] @ xr[:, : edges[1]].T
    k, lead = min(k, len(x)), min(LEAD * k, len(x))
    first = np.argpartition(-part, lead - 1, axis=1)[:, :lead]
    exact = np.einsum("qkd,qd->qk", x[first], q)
    order = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    leaders = np.take_along_axis(first, order, axis=1)
    bound = np.maximum(np.take_along_axis(exact, order, axis=1).min(1), brought)
    i, j = np.nonzero(np.ones_like(part, bool)) if len(edges) == 2 else (None, None)
    if i is not None:
        part = part[i, j]
    for n, a in enumerate(edges[1:]):
        # Of a random rotation's first a columns, squared distances are a/d of the whole within this factor but for
        # a small risk; of all columns, they are exact but for single precision.
        grow = np.float32(a / d * (1 + RISK / np.sqrt(a)) ** 2 if a < d else 1)
        if i is None:
            far = (qn[:, d] - 2 * bound)[:, None] + xn[:, d][None]  # squared distance at the bound
            near = qn[:, a][:, None] + xn[:, a][None] - 2 * part
            i, j = np.nonzero(near <= grow * far + SLACK * (qn[:, d][:, None] + xn[:, d][None]))
            part = part[i, j]
            continue
        if n:
            cols = slice(edges[n], a)
            dense = len(i) * 4 > len(q) * len(x)
            part += (qr[:, cols] @ xr[:, cols].T)[i, j] if dense else np.einsum("nd,nd->n", qr[i, cols], xr[j, cols])
        far = qn[i, d] - 2 * bound[i] + xn[j, d]
        stay = qn[i, a] + xn[j, a] - 2 * part <= grow * far + SLACK * (qn[i, d] + xn[j, d])
        i, j, part = i[stay], j[stay], part[stay]
    alone = np.flatnonzero(np.isneginf(brought))
    pairs = np.unique(np.concatenate([i * len(x) + j, (alone[:, None] * len(x) + leaders[alone]).ravel()]))
    return pairs // len(x), pairs % len(x)


def best_of(q_ids: np.ndarray, q: np.ndarray, brought: np.ndarray, x: np.ndarray, members: list[np.ndarray], turn: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's k best of the block that reach its bound, its own row left out."""
    out = []
    i, j = scan(q, x, turn, k + 1, brought)
    score = np.einsum("nd,nd->n", q[i], x[j])
    reach = score >= brought[i]
    i, j, score = i[reach], j[reach], score[reach]
    order = np.lexsort((-score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.searchsorted(i, np.arange(len(q) + 1))
    for n in range(len(q)):
        a, b = starts[n], starts[n + 1]
        if b - a > k + 1:
            b = a + int(np.searchsorted(-score[a:b], -score[a + k], side="right"))  # ties of the last stay
        ids = np.concatenate([members[c] for c in j[a:b]]) if b > a else np.empty(0, np.int64)
        s = np.repeat(score[a:b], [len(members[c]) for c in j[a:b]])
        own = ids != q_ids[n]
        ids, s = ids[own], s[own]
        top = np.lexsort((ids, -s))[:k]
        out += zip([int(q_ids[n])] * len(top), ids[top].tolist(), s[top].tolist(), strict=True)
    return out


def _packed(rows: DataFrame, size: int, lists: int, payload: str, pack, schema: str) -> DataFrame:
    """Rows with a column ``list`` in groups of about ``size`` per list, each made one row by ``pack``."""
    counts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))  # as many rows as lists
    dealt = rows.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return dealt.select("list", "part", *payload.split()).groupBy("list", "part").applyInPandas(pack, schema)


def search(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    good = valid_vectors(rows, id_col, vector_col)
    smallest = Window.partitionBy("v").orderBy("vec_id")
    first = good.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    classes = materialize(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v"), "ann-classes")  # k + 1 ids at most
    total = classes.count()
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toLocalIterator()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres, probes = fit_directions(sample, int(np.clip(round(np.sqrt(total) / 4), 1, LISTS_MOST)), k)
    shared = spark.sparkContext.broadcast((centres, rotation(sample.shape[1])))  # LISTS_MOST * d and d * d doubles
    d = sample.shape[1]

    def to_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, _ = shared.value
        for b in batches:
            if len(b):
                yield b.assign(list=(np.stack(b["v"]) @ c.T).argmax(1).astype(np.int32))

    def to_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, _ = shared.value
        for b in batches:
            for at in range(0, len(b), PACK):
                part = b.iloc[at : at + PACK]
                near = np.argsort(-(np.stack(part["v"]) @ c.T), axis=1, kind="stable")
                held = np.cumsum(sizes[near], axis=1)
                first = np.minimum((held <= k).sum(1) + 1, len(c))  # lists that hold k others and the query itself, or all
                n = np.maximum(first, probes)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(np.arange(len(part)), n)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "v": part["v"].to_numpy()[row], "list": near[row, place].astype(np.int32), "first": place < first[row]})

    def pack_block(b: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.asarray(x, np.int64) for x in b["ids"]])
        sizes = np.array([len(x) for x in b["ids"]], np.int64)
        return pd.DataFrame({"list": [b["list"].iloc[0]], "ids": [ids.tobytes()], "sizes": [sizes.tobytes()], "x": [np.stack(b["v"]).tobytes()]})

    def pack_queries(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"list": [b["list"].iloc[0]], "q_ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "q": [np.stack(b["v"]).tobytes()], "bounds": [b["bound"].to_numpy(np.float64).tobytes()]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, turn = shared.value
        for b in batches:
            for q_ids, q, bounds, ids, sizes, x in zip(*(b.column(c) for c in ("q_ids", "q", "bounds", "ids", "sizes", "x")), strict=True):
                q_ids, ids, sizes = (np.frombuffer(v.as_buffer(), np.int64) for v in (q_ids, ids, sizes))
                q, x = (np.frombuffer(v.as_buffer(), np.float64).reshape(-1, d) for v in (q, x))
                found = best_of(q_ids, q, np.frombuffer(bounds.as_buffer(), np.float64), x, np.split(ids, np.cumsum(sizes)[:-1]), turn, k)
                qi, vi, s = zip(*found, strict=True) if found else ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(vi, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    lists = materialize(classes.mapInPandas(to_lists, "vec_id long, ids array<long>, v array<double>, list int"), "ann-lists")
    counted = lists.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect()  # as many rows as lists
    sizes = np.zeros(len(centres), np.int64)
    for r in counted:
        sizes[r["list"]] = r["n"]
    queries = materialize(good.where(F.col("vec_id") % every == 0).mapInPandas(to_probes, "vec_id long, v array<double>, list int, first boolean"), "ann-queries")
    blocks = materialize(_packed(lists, BLOCK, len(centres), "ids v", pack_block, "list int, ids binary, sizes binary, x binary"), "ann-blocks")

    def meet(rows: DataFrame) -> DataFrame:
        packs = _packed(rows, PACK, len(centres), "vec_id v bound", pack_queries, "list int, q_ids binary, q binary, bounds binary")
        key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set(key, "8")  # a row of blocks is up to 8 * BLOCK * d bytes
        try:
            return materialize(packs.join(blocks, "list").mapInArrow(compare, "query_id long, vec_id long, score double"), "ann-found")
        finally:
            spark.conf.set(key, before)

    best = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    found = meet(queries.where("first").withColumn("bound", F.lit(float("-inf"))))
    rest = queries.where("not first")
    if not rest.isEmpty():
        bounds = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        found = found.unionByName(meet(rest.join(bounds, "vec_id")))  # who has lists left has k rows and so a bound
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
