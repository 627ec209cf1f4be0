"""Forms in which the log's cells are stored elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def encode_offset(offset: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(offset), 16, "0"))


def decode_offset(cell: Column) -> Column:
    """The offset in a cell; 0 where the cell is missing or shorter than eight bytes."""
    return F.when(F.octet_length(cell) >= 8, F.conv(F.hex(F.substring(cell, 1, 8)), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def message_key(topic: Column, partition: Column, offset: Column) -> Column:
    return F.format_string("msg:%s:%d:%d", topic, partition, offset)


def offset_key(topic: Column, partition: Column) -> Column:
    return F.format_string("offset:%s:%d", topic, partition)


def persisted_json(key: Column, value: Column, timestamp: Column, offset: Column) -> Column:
    return F.to_json(F.struct(key.alias("key"), F.base64(value).alias("value"), F.date_format(timestamp, STAMP).alias("timestamp"), offset.alias("offset")))


def read_persisted_json(record: Column) -> Column:
    """The record as a struct of key, value, timestamp, offset; null if it's corrupt."""
    read = F.from_json(record, "key string, value string, timestamp timestamp, offset bigint")
    whole = read["key"].isNotNull() & read["value"].isNotNull() & read["offset"].isNotNull()
    return F.when(whole, F.struct(read["key"].alias("key"), F.unbase64(read["value"]).alias("value"), read["timestamp"].alias("timestamp"), read["offset"].alias("offset")))
