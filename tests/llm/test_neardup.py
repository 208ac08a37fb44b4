"""Near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from quarry.llm import neardup as nd
from quarry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, k, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, n, size, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [None, "", "  \t", "one", "One", "ONE two", "one  two", "Ünder x", "ünder x", "of the " * 3000]
    texts += family(rng, 60, 60, 9) + family(rng, 25, 20, 2) + family(rng, 5, 400, 40)
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 50))) for _ in range(60)]
    texts += rng.sample(texts, 20)
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(documents, rows, k):
    got = nd.near_duplicates(documents([(i, t, "s") for i, t in rows]), k=k)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, k)


@pytest.mark.parametrize("wide, depth", [(0, 3), (30, 6)])
def test_large_nodes_and_crowded_groups(documents, rows, monkeypatch, wide, depth):
    for name, value in (("LEAF", 8), ("WIDE", wide), ("DEPTH", depth), ("GRID", 7), ("CROWDED", 0), ("STAR", 4), ("FIRST", 1)):
        monkeypatch.setattr(nd, name, value)
    got = nd.near_duplicates(documents([(i, t, "s") for i, t in rows]), k=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 2)


def test_filter(documents, rows):
    docs = documents([(i, t, "s") for i, t in rows] + [(None, "no id", "s"), (1, "another text of one id", "s")])
    kept = nd.without_near_duplicates(docs, k=5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, _, k) in brute(rows, 5).items() if k)
    assert ids.count(None) == 1


def test_empty(documents):
    assert nd.near_duplicates(documents([])).count() == 0
    got = nd.near_duplicates(documents([(None, "a b", "s"), (None, "a b", "s")]))
    assert [(r.component_id, r.kept) for r in got.collect()] == [(None, True)] * 2


def test_similar_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, size=rng.integers(1, 30)).astype(np.uint64)) for _ in range(30)]
    got = nd.similar(sets[:10], sets[10:], 50)
    for i, a in enumerate(sets[:10]):
        for j, b in enumerate(sets[10:]):
            both = len(set(a) & set(b))
            assert got[i, j] == (100 * both >= 50 * len(set(a) | set(b)))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500 + i, 500) for i in range(30)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == find(v) for v in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_id_with_different_texts(documents):
    """Copies are found of each text of an id, and what shares an id is one vertex."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = documents([(i, t, "s") for i, t in [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, c), (13, d), (15, c), (15, d), (15, d), (17, "apart")]])
    got = nd.near_duplicates(docs, k=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True)] * 2 + [(7, 5, False), (9, 5, False), (11, 11, True), (13, 11, False)] + [(15, 11, False)] * 3 + [(17, 17, True)]
    # One row of id 5 stays; the copy of its other text does, too.
    kept = {r.doc_id: r.text for r in nd.without_near_duplicates(docs, k=2).collect()}
    assert kept.keys() == {5, 11, 13, 17} | ({9} if kept[5] == a else {7})


def test_few_late_texts_are_not_shuffled(documents, rows, monkeypatch):
    """Texts of classes that are met late come without a shuffle of all documents. Blocks of large nodes, which only seek first
    links, miss half of the classes here."""
    for name, value in (("LEAF", 2), ("FIRST", 1)):
        monkeypatch.setattr(nd, name, value)
    seen, texts_of, nearest = [], nd.texts_of, nd.nearest
    monkeypatch.setattr(nd, "nearest", lambda groups: nearest(groups).where("whole = 1 or id % 2 = 0"))

    def watched(docs, classes, ids, few=False):
        both = [texts_of(docs, classes, ids, x) for x in (few, not few)]
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in both]
        seen.append((few, ["Exchange hashpartitioning" in p for p in plans], len({tuple(sorted(map(tuple, x.collect()))) for x in both}), both[0].count()))
        return both[0]

    monkeypatch.setattr(nd, "texts_of", watched)
    got = nd.near_duplicates(documents([(i, t, "s") for i, t in rows]), k=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 2)
    first, late = seen
    assert (first[0], first[2]) == (False, 1)
    assert late[:3] == (True, [False, True], 1) and late[3] > 0
