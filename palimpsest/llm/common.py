"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: one word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the white space between words.
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary
    folder of this process stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        named = _own_dirs[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
        remove_at_exit(spark, spark.sparkContext.getCheckpointDir())  # a folder of this application inside the shared one
    return named.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that executors do not take it for a local one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove_quietly, spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end, but those to be kept; what is returned must not read the others."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove_quietly(spark, path)


def staged(df: DataFrame, what: str, level: int = 3, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Columnar and compressed, so cheaper than a checkpoint for wide tables. The
    files go when the application ends, or with the ``scratch`` around the call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table: written out and read back.

    A checkpoint would keep the size that the planner made up for its plan; joins
    multiply these, and over some rounds the numbers grow beyond all bounds.
    """
    return staged(df, "cut", level=1)


#: Keys (an id and a hash) up to so many are broadcast to leave rows out; more meet them in a shuffle.
BROADCAST_KEYS = 500_000


def without_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, xxhash64 of text) is not among ``keys``, null ids included.

    The keys are counted first: while they are few the texts need no shuffle.
    """
    keys = cut(keys.toDF("__doc_id", "__hash").distinct())
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    on = (docs["doc_id"] == keys["__doc_id"]) & (F.xxhash64(docs["text"]) == keys["__hash"])
    return docs.join(F.broadcast(keys) if few else keys, on, "left_anti").select(docs.columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas below reuse it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the column as text, modulo ``m``; null for null."""
    return F.crc32(col.cast("string").cast("binary")) % m


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@cache
def tokenizer(path: str):  # noqa: ANN201
    """The tokenizer of a file, loaded once in each Python worker and kept to one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
