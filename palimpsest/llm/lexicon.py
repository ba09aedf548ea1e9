"""A table of terms split by frequency into a bounded head and an exact tail.

Terms of text follow a power law: a bounded number of frequent ones covers most
occurrences. These go to every Python worker as a dictionary; all other
occurrences are counted per document and joined with the whole table. Nothing is
left out, and what is broadcast never holds more than ``HEAD_TERMS`` terms nor
``HEAD_BYTES`` bytes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_TERMS = 250_000
HEAD_BYTES = 8 << 20
#: Terms longer than this stay in the tail.
HEAD_TERM_BYTES = 128


def head(table: DataFrame, term: str, count: str, value: str, terms: int = HEAD_TERMS, most_bytes: int = HEAD_BYTES) -> dict:
    """{term: value} of the most frequent terms, within both bounds.

    The bound is kept by a least count: sizes are summed by power-of-two class of
    the count (at most 64 rows come to the driver) and whole classes are taken.
    """
    short = table.where(F.octet_length(term) <= HEAD_TERM_BYTES)
    by_class = short.groupBy(count_class(F.col(count)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(term)).alias("b")).orderBy(F.desc("k")).collect()
    least, n, b = None, 0, 0
    for row in by_class:
        n, b = n + row["n"], b + row["b"]
        if n > terms or b > most_bytes:
            break
        least = row["k"]
    if least is None:
        return {}
    taken = short.where(count_class(F.col(count)) >= least).select(term, value).toArrow()
    return dict(zip(taken.column(0).to_pylist(), taken.column(1).to_pylist(), strict=True))


def count_class(count: Column) -> Column:
    """Four classes for each power of two, by whole-number arithmetic on the binary form."""
    bits = F.length(F.bin(count.cast("long")))
    return bits * 4 + F.when(bits >= 3, F.conv(F.substring(F.bin(count.cast("long")), 2, 2), 2, 10).cast("int")).otherwise(0)
