"""Bulk-load batches: the packed record format, as a source and a sink.

A record is a header (type, user timestamp, key length, value length), the key in
wire form and the value; a record of type 0 ends the batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import MAX_INLINE_BYTES, MAX_KEY_BYTES, StoreError
from palimpsest.workers import map_batches

#: The packed header, and the head of a key (length, dimensions, unused).
HEADER, KEY_HEAD = struct.Struct("<BQIQ"), struct.Struct("<II8x")
#: Record types.
NULL, VALUE, COUNTER_SET, COUNTER_ADD, TOMBSTONE = 0, 1, 2, 3, 4
#: Fixed value: bits of a dimension's head that hold flags.
FLAG_BITS = 8
RECORD = "dims array<binary>, op string, value binary, uts long"


def encode_key(dims: list[bytes]) -> bytes:
    at = KEY_HEAD.size + 4 * len(dims)
    heads, body = b"", b""
    for d in dims:
        heads += struct.pack("<I", (at + len(body)) << FLAG_BITS)
        body += d
    # the length does not count itself
    return KEY_HEAD.pack(at + len(body) - 4, len(dims)) + heads + body


def decode_key(data: bytes) -> list[bytes]:
    length, n = KEY_HEAD.unpack_from(data)
    heads = struct.unpack_from(f"<{n}I", data, KEY_HEAD.size)
    offsets = [h >> FLAG_BITS for h in heads] + [length + 4]
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def encode_batch(records: list[tuple[list[bytes], bytes, int]]) -> bytes:
    """A batch of (dims, value, user timestamp) records."""
    out = []
    for dims, value, uts in records:
        key = encode_key(dims)
        out += [HEADER.pack(VALUE, uts, len(key), len(value)), key, value]
    return b"".join([*out, HEADER.pack(NULL, 0, 0, 0)])


def decode_batch(data: bytes) -> Iterator[tuple[list[bytes], bytes, int]]:
    """The records of a batch; only values are accepted, as in the format's own reader."""
    at = 0
    while at + HEADER.size <= len(data):
        kind, uts, key_length, value_length = HEADER.unpack_from(data, at)
        at += HEADER.size
        if kind == NULL:
            return
        if kind != VALUE:
            raise StoreError("EINVAL", f"record type {kind}")
        if key_length > MAX_KEY_BYTES:
            raise StoreError("E2BIG", "key")
        if value_length > MAX_INLINE_BYTES:
            raise StoreError("ENOSPC", "value")
        if at + key_length + value_length > len(data):
            raise StoreError("EINVAL", "the batch ends inside a record")
        yield decode_key(data[at : at + key_length]), data[at + key_length : at + key_length + value_length], uts
        at += key_length + value_length


def decode(batches: DataFrame, column: str = "content") -> DataFrame:
    """(dims, op, value, uts) of all records in a column of batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column(0).to_pylist():
                rows = list(decode_batch(data or b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.list_(pa.binary())), pa.array(["VALUE"] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                    ["dims", "op", "value", "uts"],
                )

    return map_batches(batches.select(column), run, RECORD)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The records of every batch file below ``path``; a file is read by one task."""
    return decode(spark.read.format("binaryFile").load(path))


def encode(rows: DataFrame, per_batch: int = 10_000) -> DataFrame:
    """(content): batches of the rows (dims, value, uts), cut inside each partition as it is sorted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = list(zip(*(part.column(i).to_pylist() for i in range(3))))
            blobs = [encode_batch([(d, v or b"", u or 0) for d, v, u in rows[i : i + per_batch]]) for i in range(0, len(rows), per_batch)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["content"])

    return map_batches(rows.select("dims", F.col("value").cast("binary"), F.col("uts").cast("long")), run, "content binary")
