"""Encoding against tiktoken, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe
from quarry.llm.queries import rank_file


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.get(rank_file(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})


TEXTS = [
    "", " ", "  ", "\n", " \n", "x ", " x", "a\n\n b\t c  d\r\n", "it's we'll I'D you've", "café’s ２３ ٣١ Ⅷ東京🎌", "<|endoftext|>", "\x00\x01 \x1c\x1f \x85", "a b　c  d",
    "a" * 3001, "ab" * 400 + "=-" * 300, "漢字仮名交じり文章" * 40, "Zz" * 40 + "qqq" * 33, "hello world" * 30, "-" * 200, "thnterreed onatwh%%% QUE!! é",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_tiktoken(codec, reference, text):
    codec.learn([text], bpe.MEMO)
    ids, decoded = codec.run(text)
    assert ids == " ".join(map(str, reference.encode_ordinary(text)))
    assert decoded == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, reference, text):
    codec.learn([text], bpe.MEMO)
    ids, decoded = codec.run(text)
    assert ids == " ".join(map(str, reference.encode_ordinary(text)))
    assert decoded == text.encode()


def test_unsafe_merges():
    """A small vocabulary in which a token merges on at a rank below its own."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"aa": 258, b"aaaa": 259, b"ba": 260}
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcabcbcbc" * 20, "aaaaabcaaab" * 15, "a" * 131, "ababab" * 30, "abc", "bcabca"):
        assert own.encode_pieces([text.encode()])[0][0] == " ".join(map(str, want.encode_ordinary(text)))


def test_small_memo(reference):
    own = bpe.Codec(bpe.read_ranks(rank_file()), public_tokenizers.PATTERN)
    for text in ("alpha beta gammaq", "deltaq alpha", "alpha beta gammaq"):
        own.learn([text], 2)
        assert own.run(text)[0] == " ".join(map(str, reference.encode_ordinary(text)))


def test_frames(documents, reference):
    docs = documents([(1, "thing one", "s"), (2, None, "s"), (3, "", "s"), (1, "thing one", "s"), (None, "z" * 500, "s")])
    got = bpe.encode(docs, rank_file(), public_tokenizers.PATTERN, digests=True)
    for r in got.collect():
        text = {1: "thing one", 2: "", 3: "", None: "z" * 500}[r.doc_id]
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.count() == 5
    back = bpe.decode(got, rank_file(), public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(["thing one", "", "", "thing one", "z" * 500])
    assert bpe.encode(docs.limit(0), rank_file(), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("letters, n", [("abcdefghijklmnopqrstuvwxyz", 100_000), ("ACDEFGHIKLMNPQRSTVWY", 35_000)])
def test_long_random_run(codec, reference, letters, n):
    """One piece of many rounds."""
    text = "".join(random.Random(n).choices(letters, k=n))
    assert codec.encode_pieces([text.encode()])[0] == (" ".join(map(str, reference.encode_ordinary(text))), text.encode())


def test_megabyte_without_a_space(codec, reference):
    """In one piece of letters, and of one letter: no round takes its memory from those before it."""
    for text in ("".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzäéñ", k=1_000_000)), "a" * 1_000_000, "abcab" * 200_000):
        assert codec.encode_pieces([text.encode()])[0] == (" ".join(map(str, reference.encode_ordinary(text))), text.encode())


def test_many_pieces_of_many_rounds(codec, reference):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=62)) for _ in range(40_000)]
    assert [ids for ids, _ in codec.encode_pieces([t.encode() for t in texts])] == [" ".join(map(str, reference.encode_ordinary(t))) for t in texts]


@pytest.mark.parametrize("long", [0, 64])
def test_any_vocabulary_in_batches_of_rounds(monkeypatch, long):
    """Random vocabularies, most of whose tokens merge on at lower ranks; a table for every few rounds."""
    monkeypatch.setattr(bpe, "ROWS", 400)
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(2 + long)
    for i in range(25):
        tokens = list({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(10 + 3 * i)})
        rng.shuffle(tokens)
        tokens.sort(key=lambda t: len(t) if i % 3 else 0)  # some vocabularies hardly do
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        own = bpe.Codec(ranks, public_tokenizers.PATTERN)
        want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choices("abc", k=n)) for n in (150, 40, 70, 99, 20)] + ["a" * 90, "abc" * 40]
        assert [ids for ids, _ in own.encode_pieces([t.encode() for t in texts])] == [" ".join(map(str, want.encode_ordinary(t))) for t in texts]


def test_decodes_by_id():
    """A vocabulary that has other bytes for an id shows in what is decoded, of whole tokens too."""
    own = bpe.Codec(bpe.read_ranks(rank_file()), public_tokenizers.PATTERN)
    the = own.ranks[b" the"]
    own.con.execute(f"UPDATE vocabulary SET hex = '{b'other'.hex()}' WHERE id = {the}")
    own.learn(["in the"], bpe.MEMO)
    assert own.run("in the") == (f"{own.ranks[b'in']} {the}", b"inother")


def test_known_pieces_are_not_encoded_again(monkeypatch, reference):
    """A piece that was a chunk of its own comes from the memo, with or without a space before it."""
    own = bpe.Codec(bpe.read_ranks(rank_file()), public_tokenizers.PATTERN)
    text = "qzorblex\n  wzzyxq thnterreed it's 12345 \u3000x"
    own.learn([text], bpe.MEMO)
    encoded, encode_pieces = [], own.encode_pieces
    monkeypatch.setattr(own, "encode_pieces", lambda pieces: encoded.extend(pieces) or encode_pieces(pieces))
    for text in ("qzorblex, thnterreed! 'wzzyxq it's12345 .", "(qzorblex) thnterreed\n\n wzzyxq's  x"):
        own.learn([text], bpe.MEMO)
        assert own.run(text) == (" ".join(map(str, reference.encode_ordinary(text))), text.encode())
    assert not {b"qzorblex", b" thnterreed"} & set(encoded)
    assert encoded
