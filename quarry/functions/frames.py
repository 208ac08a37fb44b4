"""Record frames, checksums and keys as Column expressions; all stay in the JVM.

Fixed values of the on-disk format: magic numbers, header length, alignment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = 0x53334343  #: first word of a record, little-endian on disk
PAD_MAGIC = 0x50444444  #: marks the unused tail of a block
HEADER_BYTES = 12  #: magic, CRC, length
ALIGN = 4
FILE_HEADER_BYTES = 4096
MAX_BLOCKS_PER_FILE = 256


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def power_of_two(n: int) -> int:
    if n <= 0 or n & (n - 1):
        raise ValueError(f"{n} is not a power of two")
    return n


def payload_of(text: Column | str) -> Column:
    return F.encode(_column(text), "UTF-8")


def payload_bytes(payload: Column | str) -> Column:
    return F.octet_length(_column(payload)).cast("long")


def framed_size(length: Column | str) -> Column:
    """Header and payload, rounded up to the alignment."""
    return (_column(length).cast("long") + F.lit(HEADER_BYTES + ALIGN - 1).cast("long")).bitwiseAND(F.lit(-ALIGN).cast("long"))


def to_signed(crc: Column) -> Column:
    return F.when(crc >= 1 << 31, crc - F.lit(1 << 32)).otherwise(crc).cast("int")


def record_crc(payload: Column | str) -> Column:
    """CRC-32 as stored: a signed int."""
    return to_signed(F.crc32(_column(payload)))


def crc_matches(payload: Column | str, stored: Column | str) -> Column:
    return F.crc32(_column(payload)) == _column(stored).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _little_endian(word: Column) -> Column:
    h = F.lpad(F.hex(word), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def frame(payload: Column | str) -> Column:
    """The record as bytes on disk."""
    p, n = _column(payload), payload_bytes(payload)
    pad = (framed_size(n) - n - HEADER_BYTES).cast("int")
    return F.concat(_little_endian(F.lit(MAGIC).cast("long")), _little_endian(F.crc32(p)), _little_endian(n), p, F.unhex(F.repeat(F.lit("00"), pad)))


def slice_payload(payload: Column | str, start: int, length: int) -> Column:
    return F.substring(_column(payload), start + 1, length)


def block_key(file_from_offset: Column | str, block_index: Column | str) -> Column:
    return F.shiftleft(_column(file_from_offset).cast("long"), 8).bitwiseOR(_column(block_index).cast("long").bitwiseAND(F.lit(255)))


def key_file(key: Column | str) -> Column:
    return F.shiftrightunsigned(_column(key), 8)


def key_index(key: Column | str) -> Column:
    return _column(key).bitwiseAND(F.lit(255)).cast("int")


def hash24(text: Column | str) -> Column:
    """The low 24 bits of the 31-polynomial hash over a string's UTF-16 units."""
    units = F.hex(F.encode(_column(text), "UTF-16BE"))
    at = F.sequence(F.lit(1), F.length(units), F.lit(4))
    value = lambda i: F.conv(F.substr(units, i, F.lit(4)), 16, 10).cast("long")
    step = lambda h, i: (h * F.lit(31) + value(i)).bitwiseAND(F.lit(0xFFFFFF))
    return F.when(F.length(units) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(at, F.lit(0).cast("long"), step))


def object_key(prefix: Column | str, machine: str, instance: Column | str, bucket: Column | str, file_from_offset: Column | str, block_index: Column | str) -> Column:
    name = F.concat_ws("_", F.lit(machine), F.lit(instance) if isinstance(instance, str) else instance, _column(bucket), _column(file_from_offset).cast("string"), _column(block_index).cast("string"))
    return F.concat(_column(prefix), F.lit("/"), hash24(name).cast("string"), F.lit("_"), name, F.lit(".block"))


def blocks_for(size: Column | str, block_bytes: int) -> Column:
    """Blocks that hold ``size`` bytes, the last one perhaps in part."""
    return F.ceil(_column(size) / F.lit(power_of_two(block_bytes))).cast("long")


def whole_blocks(size: Column | str, block_bytes: int) -> Column:
    return F.shiftright(_column(size).cast("long"), power_of_two(block_bytes).bit_length() - 1)


def within_block(position: Column | str, block_bytes: int) -> Column:
    return _column(position).cast("long").bitwiseAND(F.lit(power_of_two(block_bytes) - 1))


def bytes_to_mib(size: Column | str) -> Column:
    return F.shiftright(_column(size).cast("long"), 20)


def ordered_concat(position: str, payload: str) -> Column:
    """Aggregate: the payloads of a group in order of position, as one binary value.

    Joined as hexadecimal text: concatenating binaries one by one would copy the whole for each.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.hex(F.col(payload)).alias("hex"))))
    return F.unhex(F.array_join(F.transform(parts, lambda x: x["hex"]), ""))
