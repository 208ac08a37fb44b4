"""Golden values of the record format."""

import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import frames as fr


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("size, framed", [(0, 12), (1, 16), (4, 16), (5, 20), (7, 20), (485, 500)])
def test_framed_size(spark, size, framed):
    assert one(spark, fr.framed_size(F.lit(size))) == framed


@pytest.mark.parametrize("text, crc", [("abc", 891568578), ("Forever", 973212988), ("", 0), ("ü漢", None)])
def test_crc(spark, text, crc):
    want = zlib.crc32(text.encode()) if crc is None else crc
    assert one(spark, fr.record_crc(fr.payload_of("t")), t=text) & 0xFFFFFFFF == want
    assert one(spark, fr.crc_matches(fr.payload_of("t"), fr.record_crc(fr.payload_of("t"))), t=text)


def test_frame(spark):
    assert one(spark, fr.frame(fr.payload_of("t")), t="Forever").hex() == "434333533c0d023a07000000466f726576657200"


@pytest.mark.parametrize("file, index, key", [(0, 0, 0), (20, 1, 5121), (33554432, 3, 8589934595), (1073741824, 255, 274877907199), (1073741824, -1, 274877907199)])
def test_block_key(spark, file, index, key):
    assert one(spark, fr.block_key("f", "i"), f=file, i=index) == key
    assert one(spark, fr.key_file("k"), k=key) == file
    assert one(spark, fr.key_index("k"), k=key) == index & 255


def test_object_key(spark):
    key = fr.object_key(F.lit("order"), "host-001122334455", "instanceA", F.lit("bucketA"), F.lit(20), F.lit(1))
    assert one(spark, key) == "order/10966213_host-001122334455_instanceA_bucketA_20_1.block"


@pytest.mark.parametrize("text", ["", "a", "naïve 漢字", "𝄞 clef"])
def test_hash24_counts_utf16_units(spark, text):
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[i : i + 2])) & 0xFFFFFF
    assert one(spark, fr.hash24("t"), t=text) == h


def test_block_arithmetic(spark):
    assert one(spark, fr.blocks_for(F.lit(4097), 4096)) == 2
    assert one(spark, fr.whole_blocks(F.lit(8191), 4096)) == 1
    assert one(spark, fr.within_block(F.lit(8191), 4096)) == 4095
    assert one(spark, fr.bytes_to_mib(F.lit(3 << 20))) == 3
    with pytest.raises(ValueError):
        fr.power_of_two(48)
