"""Recall against brute force, and odd vectors."""

import numpy as np
import pytest

from quarry.llm import ann


def search(spark, rows, **options):
    return ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int"), **options).collect()


def brute(ids, x, every, k):
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        s = np.round(x @ x[n], 12)
        s[n] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[n])] = [(int(ids[o]), s[o]) for o in order]
    return out


@pytest.mark.parametrize("kind", ["random", "near", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 48)).astype(np.float32)
    if kind == "near":  # a third almost alike
        x[::3] = x[0] + rng.normal(scale=1e-4, size=x[::3].shape)
    if kind == "norms":
        x *= rng.lognormal(sigma=0.5, size=(1500, 1)).astype(np.float32)
    ids = rng.permutation(3000)[:1500]
    got = {}
    for r in search(spark, [(int(i), v.tolist(), 0, None) for i, v in zip(ids, x)]):
        got.setdefault(r.query_id, []).append(r)
    want = brute(ids, x.astype(float), 20, 20)
    assert set(got) == set(want)
    at, hit = {int(i): n for n, i in enumerate(ids)}, []
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(x[at[r.vec_id]].astype(float) @ x[at[q]].astype(float)), abs=1e-9) for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        hit.append(len({r.vec_id for r in rs} & {v for v, _ in want[q]}) / 20)
    assert np.mean(hit) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, 9), (1, [1.0, 0.0], 0, 9), (2, [1.0, 0.0], 0, 9), (3, [0.0, 0.0], 0, 9), (4, None, 0, 9), (5, [float("nan"), 1.0], 0, 9), (6, [None, 1.0], 0, 9)]
    rows += [(7, [float("inf"), 1.0], 0, 9), (8, [1.0], 0, 9), (None, [1.0, 1.0], 0, 9), (9, [0.5, 0.0], 0, 9), (9, [0.5, 0.0], 1, 9), (20, [0.0, 1.0], 0, 9)]
    got = search(spark, rows)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.5), (0, 4, 20, 0.0),
        (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 9, 0.0),
    ]


def test_copies_and_limits(spark):
    got = search(spark, [(i, [1.0, 2.0], 0, None) for i in range(100)], k=3)
    assert all([r.vec_id for r in got if r.query_id == q] == [v for v in range(5) if v != q][:3] for q in (0, 20, 40, 60, 80))
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], 0, None)]) == []


@pytest.mark.parametrize("few", [1, 2, 25])
def test_unequal_clusters(spark, few):
    """Queries of a cluster with fewer than k members get their rows from other lists."""
    rng = np.random.default_rng(3)
    x = rng.normal(scale=0.05, size=(400, 16))
    x[:, 0] += 1
    x[:few, 0] = -1
    rows = search(spark, [(int(i), v.tolist(), 0, None) for i, v in enumerate(x)])
    x = x.astype(np.float32).astype(float)
    want, hit = brute(np.arange(400), x, 20, 20), []
    for q in range(0, 400, 20):
        got = sorted((r.rank, r.vec_id) for r in rows if r.query_id == q)
        assert [rank for rank, _ in got] == list(range(1, 21))
        hit.append(len({v for _, v in got} & {v for v, _ in want[q]}) / 20)
    assert np.mean(hit) >= 0.9
