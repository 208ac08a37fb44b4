"""Numpy hashes against plain Python."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import text as tx

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab \t\n\x0b\x0cüA漢\x1c\x85\xa0"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(t):
    data = t.encode()
    words = WORD.findall(data)
    assert data.split() == words
    h = tx.word_hashes(data)
    assert len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words))
    assert h.tolist() == [int(tx.word_hashes(w)[0]) for w in words]


def test_blocks_do_not_matter(monkeypatch):
    data = b" ".join(b"w%d" % (i % 37) for i in range(500)) + b" " + b"x" * 300
    want, grams = tx.word_hashes(data), [np.sort(np.concatenate(list(tx.char_grams(data.decode(), range(3, 6), 18))))]
    monkeypatch.setattr(tx, "BLOCK", 64)
    assert (tx.word_hashes(data) == want).all()
    assert (np.sort(np.concatenate(list(tx.char_grams(data.decode(), range(3, 6), 18)))) == grams[0]).all()


def test_shingles():
    h = tx.word_hashes(b"a b a b c")
    s = tx.shingle_hashes(h, 2)
    assert len(s) == 4 and s[0] == s[2] and len(set(s.tolist())) == 3
    assert len(tx.shingle_hashes(h[:1], 2)) == 1
    assert len(tx.shingle_hashes(h[:0], 2)) == 0
