"""Payloads in tar shards: exact round trips."""

import hashlib
import tarfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import media
from quarry.plans.shared import new_path


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=700))
def test_png_round_trip(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 576 == 0 and payload and payload[:n] == text.encode() and set(payload[n:]) <= {255}
    data = media.to_png(payload)
    assert media.from_png(data) == payload
    assert media.header_of(data[: media.HEADER]) == (576, len(payload) // 576, 8)


def test_damage_is_found():
    data = bytearray(media.to_png(media.payload_of("abc")[0]))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(data))


def test_columns(documents):
    texts = [None, "", "a", "a", "é" * 400, "z" * 576, "z" * 577, "long " * 40_000]
    rows = media.media_columns(documents(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.width, r.height, r.bits) == (576, len(payload) // 576, 8)
        assert r.media_bytes == r.length
    by = {r.doc_id: (r.shard, r.offset, r.media_sha256, r.feature) for r in rows}
    assert by[0] == by[1] and by[2] == by[3]
    assert media.media_columns(documents([])).count() == 0


def test_shards_are_tar_files(spark, documents, tmp_path):
    stored = media.store(documents(["a", "b", "a"]).coalesce(1), f"file://{tmp_path}").collect()
    (name,) = {r.shard for r in stored}
    with tarfile.open(tmp_path / name) as tar:
        members = {m.name: (m.offset_data, m.size) for m in tar.getmembers()}
    assert members == {f"{r.digest}.png": (r.offset, r.length) for r in stored}
    assert len(members) == 2
