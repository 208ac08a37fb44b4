"""Sharding by LPT, mixing by thresholds."""

import heapq
import random
import zlib

import pytest

from quarry.llm import mixing, sharding


def lpt(sizes, shards):
    loads = [(0, j) for j in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, j = heapq.heappop(loads)
        heapq.heappush(loads, (load + s, j))
    return sorted(load for load, _ in loads)


@pytest.mark.parametrize("sizes", [[5] * 1000, [100] * 3 + [7] * 500 + [1] * 40, list(range(1, 300)), [9]])
def test_schedule_is_lpt(sizes):
    classes = [(s, sizes.count(s), float(s)) for s in set(sizes)]
    dealt = sharding.schedule(classes, 7)
    assert all(sum(dealt[s]) == sizes.count(s) for s in set(sizes))
    assert sorted(sum(dealt[s][j] * s for s in dealt) for j in range(7)) == lpt(sizes, 7)


def test_assign(documents):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "dup " * 50, "x" * rng.randrange(400), "é" * rng.randrange(90)]) for _ in range(500)] + ["y" * 90_000]
    docs = documents(texts)
    rows = sharding.assign(docs, 24).collect()
    assert len(rows) == len(texts)
    shard_of = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(data, r.shard) == r.shard  # groups stay together
    for j in range(24):
        slots = sorted(r.slot for r in rows if r.shard == j)
        assert slots == list(range(len(slots)))
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    assert sorted(sum(r.size for r in rows if r.shard == j) for j in range(24)) == pytest.approx(lpt(groups.values(), 24), rel=0.01)
    again = sharding.assign(docs.repartition(3), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_assign_empty(documents):
    assert sharding.assign(documents([])).count() == 0


@pytest.fixture(scope="module")
def mixture():
    rng = random.Random(4)
    return [(i, rng.choice([None, "", "w " * rng.randrange(1, 60)]), rng.choice(["big"] * 12 + ["a", "b", "é", None])) for i in range(900)]


def test_mix(documents, mixture):
    docs = documents(mixture)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(mixture)
    source = {i: s for i, _, s in mixture}
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert r.size == len((mixture[r.doc_id][1] or "").split())
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(source[r.doc_id], []).append(r)
    targets = {}
    for s, rs in by.items():
        assert {r.source_size for r in rs} == {sum(r.size for r in rs)}
        (targets[s],) = {r.target for r in rs}
        assert abs(sum(r.taken for r in rs) - targets[s]) <= max(r.size for r in rs)
        assert targets[s] <= 2 * sum(r.size for r in rs) + 1e-6
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)


def test_mix_odd_tables(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([None, ""])).collect()] == [0, 0]
    rows = mixing.mix(documents([(7, "a b c", "s")] * 3 + [(None, "a", "s")])).collect()  # ids that stand thrice are taken alike
    assert len({r.taken for r in rows if r.doc_id == 7}) == 1
    assert sum(r.taken for r in rows) <= 20


def test_large_classes_in_ranges(documents, monkeypatch):
    """A class of many groups is ranked in ranges; rows repeated under one id are separate rows."""
    monkeypatch.setattr(sharding, "RANGE", 7)
    texts = [(i % 90, f"{i:04d}", "s") for i in range(200)] + [(5, "0001", "s")]
    rows = sharding.assign(documents(texts), 24).collect()
    assert len(rows) == 201
    loads = [sum(r.size for r in rows if r.shard == j) for j in range(24)]
    assert sorted(loads) == lpt([12] * 199 + [24], 24)


def test_wordless_rows_and_sources(spark, documents):
    """In a source at its cap no row stands oftener than that; a source without words stands not at all."""
    rows = [(i, "a b c" if i % 2 else "", "small") for i in range(40)] + [(100 + i, "w " * 30, "large") for i in range(60)] + [(300 + i, " ", "none") for i in range(5)]
    docs = documents(rows)
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert max(r.times for r in plan.values()) <= 2 and all(r.taken <= 2 * r.size for r in plan.values())
    got = {}
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: r.times for i, r in plan.items() if r.times}
    assert not any(i >= 300 for i in got)
