"""Schemas, operation names and error codes."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE, TOMBSTONE, COUNTER_SET, COUNTER_ADD = "VALUE", "TOMBSTONE", "COUNTER_SET", "COUNTER_ADD"
OPS = (VALUE, TOMBSTONE, COUNTER_SET, COUNTER_ADD)

#: Largest key, largest inline value and largest medium value in bytes.
MIN_KEY_BYTES, MAX_KEY_BYTES, MAX_INLINE_BYTES, MAX_MEDIUM_BYTES = 16, 512, 512, 20 << 20
#: Live versions of a tree, versions ever.
MAX_LIVE_VERSIONS, MAX_VERSIONS = 200, 50_000

LOG = T.StructType(
    [
        T.StructField("vertree", T.LongType(), False),
        T.StructField("array_id", T.LongType(), False),
        T.StructField("data_age", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("v", T.LongType(), False),
        T.StructField("dims", T.ArrayType(T.BinaryType(), False), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("uts", T.LongType()),
    ]
)
#: What a caller hands over to be written; the store adds the rest.
WRITES = T.StructType([f for f in LOG if f.name in ("dims", "op", "value", "n", "uts")])
VERSIONS = T.StructType(
    [
        T.StructField("v", T.LongType(), False),
        T.StructField("parent", T.LongType(), False),
        T.StructField("o", T.LongType(), False),
        T.StructField("r", T.LongType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("is_leaf", T.BooleanType(), False),
        T.StructField("is_mutable", T.BooleanType(), False),
        T.StructField("live_parent", T.LongType(), False),
        T.StructField("creation_ts", T.LongType()),
        T.StructField("immute_ts", T.LongType()),
    ]
)

#: Error codes and their texts.
ERRORS = {
    1: "Not enough space available on disk.",
    3: "Operation Failed.",
    4: "Operation already running.",
    8: "Couldn't find associated structure in kernel.",
    10: "Invalid version.",
    12: "Already exists.",
    13: "Invalid operation.",
    14: "Permission denied.",
    101: "Merge can't be done on zero trees.",
    103: "Arrays belong to invalid version tree.",
    107: "Array is invalid.",
    108: "Array is already merging.",
    109: "Array is owned by kernel. Can't do merge.",
    110: "Arrays are not in order.",
    112: "Invalid merge ID.",
    113: "Merge is already running.",
    114: "Trying to merge beyond back-up barrier.",
    201: "Invalid version tree.",
}


class StoreError(Exception):
    """An operation that the store refuses: an error code or an errno name."""

    def __init__(self, code: int | str, what: str = ""):
        super().__init__(f"{code}: {what or ERRORS.get(code, '')}" if isinstance(code, int) else f"{code}: {what}")
        self.code = code
