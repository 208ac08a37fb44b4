"""The FM-index and substring dedup against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import substring as sub
from quarry.llm.fmindex import FMIndex, Wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("symbols", [2, 3, 70])
def test_wavelet_rank(symbols):
    rng = np.random.default_rng(symbols)
    v = rng.integers(0, symbols, 300)
    w = Wavelet(v, symbols)
    s, at = rng.integers(0, symbols, 500), rng.integers(0, 301, 500)
    assert w.rank(s, at).tolist() == [int((v[:p] == c).sum()) for c, p in zip(s, at)]


@pytest.mark.parametrize("window", [2, 5, 13, 16])
def test_least_owner_of_each_window(window):
    rng = np.random.default_rng(window)
    parts = [rng.integers(1, 4, rng.integers(window, window + 9)) for _ in range(80)]
    owner = rng.integers(0, 50, len(parts))
    sizes = np.array([len(p) for p in parts])
    text, starts = np.concatenate([np.append(p, 0) for p in parts]), np.cumsum(sizes + 1) - sizes - 1
    index = FMIndex(text, np.repeat(owner, sizes + 1), window)
    lengths, got = index.matching(text, starts, sizes)
    assert all(lengths[a + i] == min(window, n - i) for a, n in zip(starts, sizes) for i in range(n))  # its own sequences
    best = {}
    for p, o in zip(parts, owner):
        for j in range(len(p) - window + 1):
            key = tuple(p[j : j + window])
            best[key] = min(best.get(key, o), o)
    for p, s in zip(parts, starts):
        assert [got[s + j] for j in range(len(p) - window + 1)] == [best[tuple(p[j : j + window])] for j in range(len(p) - window + 1)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"v{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(55)]
    texts = [None, "", " \t\n", "short text", "same " * 40, "same " * 30, "same " * 13]
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 70))]
        if rng.random() < 0.5:
            a = rng.randrange(40)
            t[rng.randrange(len(t)) :] = passage[a : a + rng.randrange(1, 55)]
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += rng.sample(texts, 15)
    ids = list(range(0, 2 * len(texts), 2))
    rng.shuffle(ids)
    return list(zip(ids, texts)) + [(ids[5], " ".join(passage)), (ids[9], texts[9])]  # ids that stand twice


def check(documents, rows, window):
    got = sub.digests(documents([(i, t, "s") for i, t in rows]), window).collect()
    want = [(i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in brute(rows, window)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("window", [13, 4])
def test_against_brute_force(documents, rows, window):
    check(documents, rows, window)


def test_hot_anchors(documents, rows, monkeypatch):
    monkeypatch.setattr(sub, "HOT", 1)
    check(documents, rows, 13)


def test_texts(documents, rows):
    docs = documents([(i, t, "s") for i, t in rows] + [(None, "same " * 40, "s")])
    out = sub.without_repeats(docs, 13)
    assert out.columns == docs.columns
    want = sorted((i, kept if m else t) for (i, n, m, kept), (_, t) in zip(brute(rows, 13), rows) if t is not None)
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None and r.doc_id is not None) == want
    assert [r.text for r in out.collect() if r.doc_id is None] == ["same " * 40]


def test_empty(documents):
    assert sub.digests(documents([])).count() == 0
    got = sub.digests(documents([None, ""])).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("window", [2, 5, 13, 16])
def test_matching_statistics_of_other_sequences(window):
    """Sequences that aren't in the index, with symbols that it hasn't, against a search by brute force."""
    rng = np.random.default_rng(window)
    known = [rng.integers(1, 4, size=n) for n in (40, 3, 1, 25, 60)]
    known.append(np.tile([1, 2], 30))
    sizes = np.array([len(x) for x in known])
    owner = np.array([7, 3, 9, 1, 5, 2])
    index = FMIndex(np.concatenate([np.append(x, 0) for x in known]), np.repeat(owner, sizes + 1), window)
    asked = [rng.integers(0, 6, size=30), np.concatenate([known[0][5:30], known[3][:20]]), np.tile([2, 1], 40), np.array([5]), known[4][::-1], rng.integers(1, 4, size=50)]
    text, n = np.concatenate(asked), np.array([len(x) for x in asked])
    starts = np.cumsum(n) - n
    lengths, least = index.matching(text, starts, n)
    has = lambda p: [o for x, o in zip(known, owner, strict=True) if any((x[k : k + len(p)] == p).all() for k in range(len(x) - len(p) + 1))]
    for a, x in zip(starts, asked, strict=True):
        for i in range(len(x)):
            want = max((m for m in range(1, min(window, len(x) - i) + 1) if 0 not in x[i : i + m] and has(x[i : i + m])), default=0)
            assert lengths[a + i] == want
            assert least[a + i] == (min(has(x[i : i + window])) if want == window else np.iinfo(np.int64).max)
