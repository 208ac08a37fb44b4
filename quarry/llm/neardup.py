"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Equal sets are one class, found by a digest and numbered. Each class
has SIGNATURE minwise tokens. A tree starts with all classes in its root; a node chooses one coordinate of
the signature by its own hash, for a quarter of nodes a second one, and a class goes on to the child named
by its token there, so that two classes of similarity J share a child with 1.25 J at the mean, 1 or more
from 0.8 on. Nodes of up to LEAF classes are compared exhaustively, by a sketch of 32 bytes; larger nodes
branch again. As branching can't part classes that are alike, a class of a large node whose mean agreement
with the node (by a random block of it) is DENSE or more is compared with all of the node that may be
similar (at the first level in DENSE_TREES of the trees), and goes no further. From the second level on, nodes of up to WIDE classes are compared in a grid of
blocks, as is all that is left at level DEPTH. TREES
independent trees bring the recall of a pair at the threshold to over 0.999 at any depth up to 5. Every
candidate is confirmed on the full sets, rebuilt from whole texts.

Large groups of near copies: links are first sought from each class to the most similar one of its block of
a node, in FIRST trees, and their components found. After that only pairs of different components matter:
nodes within one component are dropped. Where many pairs of a group are candidates, they are not written
out: the texts of the group's classes are brought together in blocks, compared in place, and links alone
come out, one for each class and component. Hot nodes are dealt to blocks by salt; star centres are
confirmed in salted parts. Nothing is capped and nothing collected.

Defined cases: a text without words, or null, has an empty set and links with nothing; fewer words than a
shingle are one shingle; ids are whole numbers, and a text that isn't one fails as an id; rows with equal ids are one vertex, with the links of all its texts; a null id takes part in no link, has a null
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.text import mix64, shingle_hashes, word_hashes
from quarry.plans.shared import Scratch, materialize

SIGNATURE, SKETCH = 128, 32
TREES, FIRST, DEPTH, LEAF, WIDE = 12, 3, 10, 192, 4_096
DENSE, NEARLY = 16, 6  #: of 32, mean agreement with a node; by the triangle inequality what is similar to a dense class has NEARLY
CROWDED, GRID = 2, 1_024  #: candidates per class of a group that are compared in place; classes of a block among dense ones
DENSE_TREES = 8  #: trees in which the dense classes of the first level are compared: two similar ones meet in one but for 3 of a million cases
HEAVY = 10_000  #: nodes that are broadcast at most
SKETCH_LEAST = 16  #: of 32 coordinates; a pair of similarity 0.8 has fewer in 3 of a million cases
STAR = 512  #: members of a star that are confirmed in one group
FEW = 100_000  #: classes met late whose texts are picked by a broadcast of their keys; for more of them, all texts are shuffled
_RNG = np.random.Generator(np.random.PCG64(77))
_MUL = _RNG.integers(1 << 31, size=SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(1 << 32, size=SIGNATURE, dtype=np.uint32)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of k words, A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), k))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of SIGNATURE hash functions over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        h = _MUL[:, None] * x[None, at : at + 4096] + _ADD[:, None]
        np.minimum(out, (h ^ (h >> np.uint32(15))).min(1), out=out)
    return out


def root_keys() -> np.ndarray:
    return mix64(np.arange(1, TREES + 1, dtype=np.uint64))


def children(nodes: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for a node and a signature a row: one child, and for a quarter of nodes another."""
    rows, keys = [], []
    for second in (0, 1):
        h = mix64(nodes + np.uint64(0x51ED2701 + second))
        at = np.flatnonzero((h >> np.uint64(62)) == 0) if second else np.arange(len(nodes))
        coordinate = (h[at] & np.uint64(SIGNATURE - 1)).astype(np.int64)
        token = signatures[at, coordinate].astype(np.uint64)
        rows.append(at)
        keys.append(mix64(nodes[at] ^ mix64((token << np.uint64(8)) + coordinate.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(keys)


def sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n, digest, signature: the last two null for an empty set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, signatures = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "text_hash", "n", "digest", "signature"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col), F.col(text_col)).mapInArrow(work, f"id {id_type}, text_hash long, n long, digest binary, signature binary")


NODE = "tree int, node long, id long, comp long, sketch binary"


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint32).reshape(-1, SIGNATURE)


def _node_batch(tree, node, ids, comp, signatures) -> pa.RecordBatch:
    low = np.ascontiguousarray(signatures[:, :SKETCH].astype(np.uint8))
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node.view(np.int64)), pa.array(ids, pa.int64()), pa.array(comp, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())], names=["tree", "node", "id", "comp", "sketch"])


def first_level(classes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.repeat(_signatures(b.column(1)), TREES, axis=0)
                rows, keys = children(np.tile(root_keys(), b.num_rows), sig)
                ids = b.column(0).to_numpy()[rows // TREES]
                yield _node_batch((rows % TREES).astype(np.int32), keys, ids, ids, sig[rows])

    return classes.select("id", "signature").mapInArrow(work, NODE)


def next_level(open_rows: DataFrame, classes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = _signatures(b.column(4))
                rows, keys = children(b.column(1).to_numpy().view(np.uint64), sig)
                yield _node_batch(*(x[rows] if i != 1 else keys for i, x in enumerate(b.column(i).to_numpy() for i in range(4))), sig[rows])

    return open_rows.select("tree", "node", "id", "comp").join(classes.select("id", "signature").hint("shuffle_hash"), "id").select("tree", "node", "id", "comp", "signature").mapInArrow(work, NODE)


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one group, rows sorted by it, as (later, earlier), step by step."""
    at = np.arange(len(group))
    for step in range(1, len(group)):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        yield at + step, at


def by_group(rows: DataFrame, columns: str, work, schema: str) -> DataFrame:
    """``work`` on numpy columns group, then ``columns`` (the last one the sketch), a batch of whole groups at a time."""
    names = ["group", *columns.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(len(names) - 1)] + [np.frombuffer(b"".join(x.as_py() for x in b.column(len(names) - 1)), np.uint8).reshape(-1, SKETCH)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = np.searchsorted(cols[0], cols[0][-1])  # the last group may go on in the next batch
            if cut:
                yield work(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        if held is not None:
            yield work(*held)

    return rows.select(*names).repartition("group").sortWithinPartitions("group", "id").mapInArrow(run, schema)


def nearest(groups: DataFrame) -> DataFrame:
    """Rows that have a similar one in their group, with the most similar (partner); ties: the least id."""

    def work(group, tree, node, whole, ids, sketch):
        best = np.zeros(len(ids), np.int64)
        partner = np.zeros(len(ids), np.int64)
        for a, b in _pairs(group):
            agree = (sketch[a] == sketch[b]).sum(1)
            for x, y in ((a, b), (b, a)):
                better = (agree > best[x]) | ((agree == best[x]) & (ids[y] < partner[x]))
                best[x[better]], partner[x[better]] = agree[better], ids[y[better]]
        hit = np.flatnonzero(best >= SKETCH_LEAST)
        return pa.RecordBatch.from_arrays([pa.array(tree[hit]), pa.array(node[hit]), pa.array(whole[hit]), pa.array(ids[hit]), pa.array(partner[hit]), pa.array([x.tobytes() for x in sketch[hit]], pa.binary())], names=["tree", "node", "whole", "id", "partner", "sketch"])

    return by_group(groups, "tree node whole id sketch", work, "tree int, node long, whole int, id long, partner long, sketch binary")


def agreement(groups: DataFrame) -> DataFrame:
    """Rows of blocks of large nodes, each with its mean agreement with the others of its block (of SKETCH)."""

    def work(group, tree, node, ids, comp, sketch):
        total = np.zeros(len(ids))
        for a, b in _pairs(group):
            agree = (sketch[a] == sketch[b]).sum(1)
            total[a] += agree  # an index stands once in a and once in b of a step
            total[b] += agree
        keys, at, rows = np.unique(group, return_inverse=True, return_counts=True)
        mean = total / np.maximum(rows[at] - 1, 1)
        return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node), pa.array(ids), pa.array(comp), pa.array(mean), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["tree", "node", "id", "comp", "mean", "sketch"])

    return by_group(groups, "tree node id comp sketch", work, "tree int, node long, id long, comp long, mean double, sketch binary")


def candidates(groups: DataFrame) -> DataFrame:
    """What a group tells, by kind. 0: similar pairs (a, b), a > b, of different components. 1: of groups that have
    many, the members that are in any instead (a = id, b = component, group)."""

    def work(group, ids, comp, side, sketch):
        found = []
        for a, b in _pairs(group):
            fit = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[fit], b[fit]
            fit = (sketch[a] == sketch[b]).sum(1) >= SKETCH_LEAST
            found.append(np.stack([a[fit], b[fit]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        keys, at, rows = np.unique(group, return_inverse=True, return_counts=True)
        crowded = np.bincount(at[a], minlength=len(keys)) > CROWDED * rows
        many = crowded[at[a]]
        members = np.unique(np.concatenate([a[many], b[many]]))
        a, b = a[~many], b[~many]
        kinds = np.repeat(np.arange(2, dtype=np.int32), [len(a), len(members)])
        groups_of = np.concatenate([np.zeros(len(a), group.dtype), group[members]])
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(groups_of), pa.array(np.concatenate([ids[a], ids[members]])), pa.array(np.concatenate([ids[b], comp[members]]))], names=["kind", "group", "a", "b"])

    return by_group(groups, "id comp side sketch", work, "kind int, group long, a long, b long")


def similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the two lists have at least ``percent`` of their union in common: a boolean matrix."""
    sizes = np.array([len(s) for s in (*left, *right)])
    tokens, at, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    more = counts > 1
    place = np.cumsum(more) - 1
    row, at = row[more[at]], place[at[more[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    n, both = len(left), np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(more.sum()), 4096):
        a, b = np.searchsorted(at, [first, first + 4096])
        m = np.zeros((len(sizes), 4096), np.float32)
        m[row[a:b], at[a:b] - first] = 1
        both += m[:n] @ m[n:].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:n, None] + sizes[None, n:] - both)


def confirm_blocks(rows: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (g, side, id, comp): links between side 0 and side 1 of a group, or within it (side 2), of different
    components; of several from one class to a component, one."""
    given = rows.join(texts.hint("shuffle_hash"), "id").select("g", "side", "id", "comp", "text").repartition("g").sortWithinPartitions("g")

    def links(side, ids, comp, sets) -> tuple[list[int], list[int]]:
        side, ids, comp = np.array(side), np.array(ids), np.array(comp)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return [], []
        fit = similar([sets[i] for i in left], [sets[i] for i in right], percent) & (comp[left][:, None] != comp[right][None])
        i, j = np.nonzero(fit)
        _, first = np.unique(np.stack([ids[left[i]], comp[right[j]]], axis=1), axis=0, return_index=True)
        return ids[left[i[first]]].tolist(), ids[right[j[first]]].tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for batch in batches:
            out = ([], [])
            for g, side, id_, comp, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                if g != key:
                    if held[0]:
                        for x, y in zip(out, links(*held), strict=True):
                            x += y
                    key, held = g, ([], [], [], [])
                for x, y in zip(held, (side.as_py(), id_.as_py(), comp.as_py(), shingle_set(text.as_py(), k)), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
        if held[0]:
            a, b = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return scratch.table(given.mapInArrow(work, "a long, b long"), "near-links")


def of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows joined with what ``nodes`` (written, with their sizes n) says of theirs. The nodes with most rows, HEAVY at most,
    are broadcast, so that the rows of none of them meet in one task."""
    most = max(LEAF, (nodes.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = nodes.where(F.col("n") > most)  # fewer than HEAVY, as all have n rows
    light = rows.join(F.broadcast(heavy.select("node")), "node", "left_anti").join(nodes.where(F.col("n") <= most), "node")
    return rows.join(F.broadcast(heavy), "node").unionByName(light)


def dense_grid(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (tree, node, id, comp, sketch) of classes that may be similar to dense ones, in groups with sides 0 and 1: in
    each node, all that are not of its most frequent component against all."""
    counts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("node").agg(F.max_by("comp", "n").alias("most"), F.max("n").alias("of_most"), F.sum("n").alias("n")).withColumn("rest", F.col("n") - F.col("of_most")).where("rest > 0")
    parts = lambda c: F.ceil(F.col(c) / F.lit(GRID)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id", "node"), parts(c)).cast("int")
    both, columns = of_nodes(rows, scratch.table(nodes, "near-nodes")), ["id", "comp", "sketch", "node"]
    rest = both.where("comp <> most").select(*columns, F.lit(0).alias("side"), own("rest").alias("i"), F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("j"))
    every = both.select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), parts("rest") - 1)).alias("i"), own("n").alias("j"))
    return rest.unionByName(every).withColumn("group", F.xxhash64("node", "i", "j"))


def confirm_stars(pairs: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those (a, b) whose full sets have at least ``percent`` of their union in common.

    Stars around b are split into parts of about STAR members; each part gets b's text once and is worked
    through row by row.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("parts"))
    members = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("b", "part", F.col("a").alias("id"))
    centres = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("id"))
    rows = members.withColumn("centre", F.lit(0)).union(centres.withColumn("centre", F.lit(1))).join(texts.hint("shuffle_hash"), "id")
    rows = rows.select("b", "part", "centre", "id", "text").repartition("b", "part").sortWithinPartitions("b", "part", F.desc("centre"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in batches:
            a_out, b_out = [], []
            for b, part, is_centre, a, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                own = shingle_set(text.as_py(), k)
                if (b, part) != key:
                    key, centre = (b, part), []
                if is_centre.as_py():
                    centre.append(own)
                    continue
                for c in centre:
                    both = len(np.intersect1d(own, c, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(c) - both):
                        a_out.append(a.as_py())
                        b_out.append(b.as_py())
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return scratch.table(rows.mapInArrow(work, "a long, b long"), "near-links")


def blocks_of(rows: DataFrame, sizes: DataFrame, grid: bool = False) -> DataFrame:
    """Rows of nodes in blocks of LEAF at the mean, salted by id, each with its block's key (group).

    side: 2, or, where each block of a node meets each (``grid``), 0 and 1 for two blocks that meet, 2 within a block.
    """
    dealt = of_nodes(rows, sizes.select("node", "n")).withColumn("n", F.ceil(F.col("n") / F.lit(LEAF)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)) if grid else F.col("block"))
    side = F.when(F.col("block") < F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(2)
    return dealt.withColumn("group", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", side)


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """id and text of the classes in ``ids``; docs: rep, text_hash, text. Where they are ``few``, no document is shuffled."""
    own = classes.select("id", "rep", "text_hash")
    keys = F.broadcast(own.join(F.broadcast(ids), "id")) if few else own.join(ids, "id").hint("shuffle_hash")
    return docs.join(keys, ["rep", "text_hash"]).select("id", "text")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of docs."""
    scratch = Scratch(docs.sparkSession)
    all_sets = scratch.table(sets(docs, k, id_col, text_col), "near-sets")
    alive = all_sets.where("digest is not null and id is not null")
    reps = alive.groupBy("digest").agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "text_hash")).alias("rep"))
    classes = alive.join(reps, "digest").where("id = rep.id and text_hash = rep.text_hash").dropDuplicates(["digest"])
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("id"), "digest", F.col("rep.id").alias("rep"), "text_hash", "signature"), "near-classes")
    base = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    # Links to the most similar class of a block, in a few trees; their components.
    level = scratch.table(first_level(classes), "near-level")
    sizes = scratch.table(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    close = scratch.table(nearest(blocks_of(level, sizes).withColumn("whole", (F.col("n") == 1).cast("int"))), "near-close")
    texts = scratch.table(texts_of(base, classes, close.select("id").distinct()), "near-texts")
    first = close.where(F.col("tree") < FIRST).select(F.greatest("id", "partner").alias("a"), F.least("id", "partner").alias("b")).distinct()
    links = [confirm_stars(first, texts, k, percent, scratch)]
    comps = components(links[0])

    # All other pairs of different components, level by level. In whole nodes only rows that have a similar one matter.
    columns = ["tree", "node", "id", "sketch"]
    level = level.join(sizes.where(F.col("n") > LEAF).select("node"), "node", "left_semi")
    level = close.where("whole = 1").select(*columns).unionByName(level.select(*columns))
    level = scratch.table(level.join(comps, "id", "left").select(*columns, F.coalesce("component", "id").alias("comp")), "near-level")
    found = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("node", "n")
        sizes = scratch.table(sizes, "near-sizes")
        most = LEAF if depth == 1 else WIDE if depth < DEPTH else 1 << 62  #: rows of a node whose rows all meet
        found.append(scratch.table(candidates(blocks_of(level, sizes.where(F.col("n") <= most), grid=True)), "near-found"))
        thick = scratch.table(agreement(blocks_of(level, sizes.where(F.col("n") > most))), "near-thick")
        if thick.isEmpty():
            break
        dense = thick.where(F.col("mean") >= NEARLY)
        if depth == 1:  # two similar classes share a node there in four of five trees at least
            dense = dense.where(F.col("tree") < DENSE_TREES)
        found.append(scratch.table(candidates(dense_grid(dense, scratch)), "near-found"))
        level = scratch.table(next_level(thick.where(F.col("mean") < DENSE), classes), "near-level")

    found = reduce(DataFrame.union, found)
    pairs = scratch.table(found.where("kind = 0").select("a", "b").distinct(), "near-pairs")
    blocks = found.where("kind = 1").select(F.col("group").alias("g"), F.lit(2).alias("side"), F.col("a").alias("id"), F.col("b").alias("comp"))
    known = texts.select("id")
    more = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(blocks.select("id")).distinct().join(known, "id", "left_anti")
    more = scratch.table(more, "near-more")
    if late := more.count():
        texts = texts.unionByName(scratch.table(texts_of(base, classes, more, few=late <= FEW), "near-texts"))
    links += [confirm_stars(pairs, texts, k, percent, scratch), confirm_blocks(blocks, texts, k, percent, scratch)]
    comps = components(reduce(DataFrame.union, links))

    comps = comps.unionByName(comps.select(F.col("component").alias("id"), "component").distinct())  # the least number has no row of its own
    least = comps.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    comps = comps.join(least, "component").select(F.col("id").alias("start"), "least")
    out = all_sets.select("id", "n", "digest").join(classes.select("digest", F.col("id").alias("start"), "rep"), "digest", "left").join(comps, "start", "left")
    rows = Scratch(docs.sparkSession)
    out = rows.table(out.select("id", "n", F.coalesce("least", "rep", F.col("id").cast("long")).alias("component")), "near-rows")
    # Components that an id with different texts has rows in are one.
    several = out.where("id is not null").groupBy("id").agg(F.min("component").alias("b"), F.max("component").alias("most")).where("b <> most").select("id", "b")
    several = scratch.table(out.join(several, "id").select(F.col("component").alias("a"), "b"), "near-several")
    if not several.isEmpty():
        joined = components(several).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        out = out.join(joined, "component", "left").select("id", "n", F.coalesce("joined", "component").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    out = materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept), "near-duplicates")
    rows.drop()
    scratch.drop()
    return out


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the least id; rows with a null id stay. Of rows with equal ids there is one, that
    with the least text; only this one is compared, so that no row goes for the sake of one that isn't kept."""
    given = docs
    order = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(order).alias("__least"), F.max(order).alias("__most")).where("__least <> __most")
    several = materialize(several.select("__id", "__least"), "near-ids")
    if not several.isEmpty():
        docs = docs.join(several, docs[id_col] == F.col("__id"), "left").where(F.col("__least").isNull() | (order == F.col("__least"))).drop("__id", "__least")
    kept = near_duplicates(docs.select(id_col, text_col), k, percent, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    rows = docs.join(kept.hint("shuffle_hash"), docs[id_col] == F.col("__id"), "left_semi")
    one = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    rows = rows.withColumn("__row", one).where("__row = 1").drop("__row")
    return rows.unionByName(given.where(F.col(id_col).isNull()))
