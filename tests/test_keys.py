from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions.keys import HIGH, LOW, next_in_box, pack, unpack

DIM = st.one_of(st.binary(max_size=5), st.binary(max_size=300), st.sampled_from([b"", b"\0", b"\0\0", b"\xff", b"a\0b"]))
KEY = st.lists(st.one_of(DIM, st.sampled_from([LOW, HIGH])), max_size=6)


def order(key):
    """Fewer dimensions first; in each, low, then bytes, then high."""
    return len(key), [(d, b"") if d in (LOW, HIGH) else (0, d) for d in key]


@settings(max_examples=400, deadline=None)
@given(KEY, KEY)
def test_packed_keys_sort_as_keys(a, b):
    assert (order(a) < order(b)) == (pack(a) < pack(b))
    assert (order(a) == order(b)) == (pack(a) == pack(b))


@settings(max_examples=400, deadline=None)
@given(KEY)
def test_round_trip(key):
    assert unpack(pack(key)) == key


@given(st.binary(min_size=900, max_size=3000))
@settings(max_examples=30, deadline=None)
def test_long_dimensions(d):
    assert unpack(pack([d])) == [d]
    assert pack([d]) < pack([d + b"\0"])


def test_column_functions(spark):
    df = spark.createDataFrame([([b"b"],), ([b"a", b""],), ([b"a"],), ([b"a\0"],), ([b"\x80"],), ([b"\x7f"],)], "dims array<binary>")
    got = [[bytes(x) for x in r[0]] for r in df.orderBy(K.order_key(F.col("dims"))).collect()]
    assert got == [[b"a"], [b"a\0"], [b"b"], [b"\x7f"], [b"\x80"], [b"a", b""]]
    r = df.limit(1).select(K.compare(F.col("dims"), F.array(F.lit(b"c"))), K.strip(F.col("dims"), 0), K.key_bytes(F.col("dims"))).first()
    assert r[0] == -1 and r[1] == [] and r[2] == 21


def test_validation(spark):
    df = spark.createDataFrame([([],), (None,), ([b"x" * 600],), ([b"x"],), ([None],)], "dims array<binary>")
    assert [r[0] for r in df.select(K.validate(F.col("dims"))).collect()] == ["EINVAL: no dimensions", "EINVAL: no dimensions", "ENAMETOOLONG", None, "EINVAL: null dimension"]


def test_next_in_box():
    low, high = (2, 3), (5, 6)
    assert next_in_box((3, 4), low, high) == (3, 4)
    assert next_in_box((1, 9), low, high) == (2, 3)
    assert next_in_box((3, 1), low, high) == (3, 3)
    assert next_in_box((3, 9), low, high) == ("after", (3,))
    assert next_in_box((6, 0), low, high) is None
