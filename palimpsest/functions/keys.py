"""Functions over keys: lists of byte strings, their order, boxes and encodings."""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palimpsest.workers import ship

#: Marker bytes of the byte-comparable form, strides between markers
#: and the numbers of content bytes at which the stride changes.
MINUS_INF, END, MORE, PLUS_INF = 0x01, 0x02, 0xFE, 0xFF
STRIDES = (1, 3, 4, 8, 16, 32, 64)
BOUNDS = (1, 4, 16, 64, 256, 1024)
#: Stand for dimensions without a finite value in Python keys.
LOW, HIGH = -1, 1


def order_key(dims: Column) -> Column:
    """Sorts as keys do: fewer dimensions first, then each as unsigned bytes, shorter first."""
    return F.struct(F.size(dims).alias("n"), dims.alias("dims"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = order_key(a), order_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def n_dims(dims: Column) -> Column:
    return F.size(dims)


def strip(dims: Column, n: int) -> Column:
    """The first n dimensions, by which keys with a common prefix group."""
    return F.slice(dims, 1, n)


def meld(a: Column, b: Column, n: int) -> Column:
    """The first n dimensions of a and the others of b."""
    return F.concat(F.slice(a, 1, n), F.slice(b, n + 1, 2_000_000))


def key_hash(dims: Column, prefix: int | None = None) -> Column:
    """A 64-bit hash of the whole key, or of its first dimensions."""
    return F.xxhash64(dims if prefix is None else strip(dims, prefix))


def key_bytes(dims: Column) -> Column:
    """Length of the wire form: 16 bytes, four a dimension, and the content."""
    return 16 + 4 * F.size(dims) + F.aggregate(dims, F.lit(0), lambda n, d: n + F.length(d))


def in_box(keys: list[Column], low: list, high: list) -> Column:
    """Every dimension inside its inclusive bounds; None leaves a side open."""
    out = F.lit(True)
    for k, lo, hi in zip(keys, low, high, strict=True):
        if lo is not None:
            out = out & (k >= F.lit(lo))
        if hi is not None:
            out = out & (k <= F.lit(hi))
    return out


def outside(keys: list[Column], low: list, high: list) -> Column:
    """The number, from 0, of the first dimension outside its bounds; null inside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(keys))):
        out = F.when(~in_box(keys[i : i + 1], low[i : i + 1], high[i : i + 1]), F.lit(i)).otherwise(out)
    return out


def next_in_box(key: tuple, low: tuple, high: tuple) -> tuple | None:
    """The least key inside the box that is not below ``key``; None past the end."""
    for i, (k, lo, hi) in enumerate(zip(key, low, high)):
        if k < lo:
            return key[:i] + low[i:]
        if k > hi:
            # go on after this prefix: the dimension before must grow
            return None if i == 0 else ("after", key[:i])
    return key


def after(keys: list[Column], last: list) -> Column:
    """Keys strictly behind ``last`` in key order: the way to the next page."""
    out = F.lit(False)
    for k, x in reversed(list(zip(keys, last, strict=True))):
        out = (k > F.lit(x)) | ((k == F.lit(x)) & out)
    return out


def validate(dims: Column) -> Column:
    """The reason why a key cannot be stored, or null."""
    from palimpsest.schema import MAX_KEY_BYTES, MIN_KEY_BYTES

    size = key_bytes(dims)
    return (
        F.when(dims.isNull() | (F.size(dims) < 1), "EINVAL: no dimensions")
        .when(size < MIN_KEY_BYTES, "EINVAL: too short")
        .when(size > MAX_KEY_BYTES, "ENAMETOOLONG")
        .when(F.exists(dims, lambda d: d.isNull()), "EINVAL: null dimension")
    )


def _strides() -> Iterator[int]:
    at = 0
    for stride, bound in zip(STRIDES, (*BOUNDS, None)):
        while bound is None or at < bound:
            yield stride
            at += stride


def pack(dims: list) -> bytes:
    """The byte-comparable form of a key: packed keys compare as the keys do.

    The number of dimensions comes first. A dimension is cut into strides, each
    filled up with zeros and followed by a marker: more to come, or END and the
    number of bytes in the last stride, so that an end sorts before any more.
    """
    out = [struct.pack(">I", len(dims))]
    for d in dims:
        if d == LOW or d == HIGH:
            out.append(bytes([MINUS_INF if d == LOW else PLUS_INF]))
            continue
        out.append(bytes([END]))
        at, d = 0, bytes(d)
        for stride in _strides():
            piece = d[at : at + stride]
            at += stride
            if at >= len(d):
                out.append(piece.ljust(stride, b"\0") + bytes([END + len(piece)]))
                break
            out.append(piece + bytes([MORE]))
    return b"".join(out)


def unpack(packed: bytes) -> list:
    """The key whose packed form this is."""
    (n,), at, out = struct.unpack_from(">I", packed), 4, []
    for _ in range(n):
        first, at = packed[at], at + 1
        if first in (MINUS_INF, PLUS_INF):
            out.append(LOW if first == MINUS_INF else HIGH)
            continue
        pieces = []
        for stride in _strides():
            marker = packed[at + stride]
            pieces.append(packed[at : at + stride] if marker == MORE else packed[at : at + marker - END])
            at += stride + 1
            if marker != MORE:
                break
        out.append(b"".join(pieces))
    return out


def pack_udf(dims: Column | str) -> Column:
    """``pack`` of an array<binary> column; only where one sortable value is wanted."""

    ship(SparkSession.active())

    @F.pandas_udf("binary")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda d: None if d is None else pack(list(d)))

    return run(dims)


def unpack_udf(packed: Column | str) -> Column:
    """``unpack`` of a column of packed keys."""

    ship(SparkSession.active())

    @F.pandas_udf("array<binary>")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda p: None if p is None else unpack(bytes(p)))

    return run(packed)
