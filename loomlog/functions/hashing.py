"""Key hashes as native expressions: no Python runs on a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 32 bits: offset basis and prime.
BASIS, PRIME, MASK = 2166136261, 16777619, 4294967295


def _step(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * F.lit(PRIME)).bitwiseAND(F.lit(MASK))


def fnv1a32(key: Column) -> Column:
    """FNV-1a over the key's UTF-8 bytes, as a long from 0 to 2^32-1.

    Keys of ASCII characters, nearly all, are taken character by character."""
    basis = F.lit(BASIS).cast("long")
    plain = F.aggregate(F.split(key, ""), basis, lambda h, c: _step(h, F.ascii(c).cast("long")))
    digits = F.hex(F.encode(key, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    bytewise = F.aggregate(F.sequence(F.lit(1), F.octet_length(key)), basis, lambda h, i: _step(h, byte(i)))
    return F.when(key == "", basis).when(F.octet_length(key) == F.length(key), plain).otherwise(bytewise)


def fnv_partition(key: Column, n: int) -> Column:
    """The partition that a produced message goes to: 0 for the empty key."""
    return F.when(key == "", F.lit(0)).otherwise((fnv1a32(key) % F.lit(max(n, 1))).cast("int"))


def sha1_prefix(key: Column) -> Column:
    """The first 32 bits of SHA-1, big-endian, as a long."""
    return F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("long")


def message_bytes(key: Column, value: Column) -> Column:
    """Bytes of key and value, not characters."""
    return (F.octet_length(key) + F.octet_length(value)).cast("long")
