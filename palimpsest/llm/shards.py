"""Token shards in training order.

Texts are tokenised once and packed into sequences of a fixed number of ids. The
n sequences get the slots 0 to n - 1 by a keyed Feistel permutation; a number
that leaves the range goes round again until it falls inside (cycle-walking), so
that no table of the order exists anywhere. Shard k holds the slots from k times
the shard's sequences on. All records have one length: slot s lies at a known
byte of a known file, and reading can resume at any slot.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import qualified, scratch, shared_dir, slices, staged
from palimpsest.workers import map_batches

#: Ids in a sequence, sequences in a shard, rounds of the permutation.
SEQUENCE, SHARD, ROUNDS = 2048, 4096, 6
#: Sequences that serve as a compression dictionary for what goes through the shuffle.
DICTIONARY = 128
_CHUNK = 1 << 20


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """Scatter 64-bit numbers, by multiplications and shifts."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of ``index``, a one-to-one map of range(n) that depends on ``seed``."""
    x = np.asarray(index, np.uint64).copy()
    if n < 2:
        return x.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(_mix(np.array([seed * 1_000_003 + r], np.uint64), 0x5851F42D4C957F2D)[0]) for r in range(rounds)]
    inside = np.ones(len(x), bool)
    while inside.any():
        left, right = x[inside] >> shift, x[inside] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        x[inside] = (left << shift) | right
        inside = x >= n
    return x.astype(np.int64)


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary in rank form, loaded once in each Python worker."""

    path: str

    def load(self):  # noqa: ANN201
        import base64

        import public_tokenizers
        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def end(self) -> int:
        """The first free id, which ends each text."""
        with open(self.path, "rb") as f:
            return sum(1 for line in f if line.strip())


def file_window(docs: DataFrame) -> Column | None:
    """The file that a row was read from, as its window; None for rows that come from no file.

    Writers number their files by partition, so files keep the order of ranges.
    """
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return None
    return F.col("_metadata.file_name")


def pack(docs: DataFrame, tokenizer: Tokenizer, sequence: int = SEQUENCE, window: Column | None = None) -> DataFrame:
    """(window, part, seq, n_tokens, doc_ids, starts, ids): sequences of each window and input partition.

    Texts follow one another in the order of the partition, each with an end id;
    doc_ids and starts tell which texts begin or go on in a sequence and where.
    Only the last sequence of a window in a partition is filled up with end ids;
    n_tokens are its own. Without ``window`` all is one window. ids are little-endian 16-bit numbers.
    """
    end = tokenizer.end
    if end >= 1 << 16:
        raise ValueError("ids do not fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = tokenizer.load().encode_ordinary, TaskContext.get().partitionId()
        held, spans, size, now, written = [], [], 0, None, {}

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal held, spans, size
            seq = written.get(now, 0)
            flat = np.concatenate(held) if held else np.empty(0, np.uint16)
            n = -(-size // sequence) if last else size // sequence
            body, rest = flat[: n * sequence], flat[n * sequence :]
            own = np.full(n, sequence)
            if last and n:
                own[-1] = size - (n - 1) * sequence
                body = np.concatenate([body, np.full(n * sequence - size, end, np.uint16)])
            ids: list[list] = [[] for _ in range(n)]
            at: list[list] = [[] for _ in range(n)]
            after = []
            for doc, start, stop in spans:
                for k in range(start // sequence, min(n, -(-stop // sequence))):
                    ids[k].append(doc)
                    at[k].append(max(0, start - k * sequence))
                if stop > n * sequence:
                    after.append((doc, max(0, start - n * sequence), stop - n * sequence))
            data = body.astype("<u2").tobytes()
            stride = 2 * sequence
            out = pa.RecordBatch.from_arrays(
                [pa.array([now] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(own, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array([data[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())],
                ["window", "part", "seq", "n_tokens", "doc_ids", "starts", "ids"],
            )
            held, spans, size, written[now] = [rest], after, len(rest), seq + n
            return out

        for batch in slices(batches):
            for doc, text, of in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if of != now:
                    if size:
                        yield rows(last=True)
                    now = of
                ids = np.array([*encode(text), end] if text else [end], np.uint16)
                held.append(ids)
                spans.append((doc, size, size + len(ids)))
                size += len(ids)
                if size > _CHUNK:
                    yield rows(last=False)
        if size:
            yield rows(last=True)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.lit("") if window is None else F.coalesce(window.cast("string"), F.lit(""))).alias("window"))
    return map_batches(texts, run, "window string, part int, seq long, n_tokens int, doc_ids array<long>, starts array<int>, ids binary")


def write_shards(docs: DataFrame, tokenizer: Tokenizer, folder: str, seed: int = 17, sequence: int = SEQUENCE, shard: int = SHARD, window: Column | None = None) -> DataFrame:
    """Write the shards; (slot, shard, offset, n_tokens, crc, doc_ids, starts) of each sequence.

    Files are ``<folder>/shard-<number>.bin``; a task writes under a name of its
    own and then renames, so that a repeated task leaves the same file. All files
    are there when the call returns. ``window`` is a column whose values, in order,
    have consecutive ranges of slots; sequences are permuted inside them. Null and empty texts are one end id; rows
    with a null doc_id are written like others; an empty table writes nothing.
    Packing follows the partitions of the input, and the same input is packed alike.
    """
    with scratch(docs.sparkSession):
        return staged(_write(docs, tokenizer, qualified(docs.sparkSession, folder), seed, sequence, shard, window), "index", keep=True)


def _write(docs: DataFrame, tokenizer: Tokenizer, folder: str, seed: int, sequence: int, shard: int, window: Column | None) -> DataFrame:
    spark = docs.sparkSession
    packed = staged(pack(docs, tokenizer, sequence, window), "packed", level=6)
    # a number for each input partition, and for each part of a window in it, comes to the driver
    counts = sorted((r["window"], r["part"], r["n"]) for r in packed.groupBy("window", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, ranges, n = {}, {}, 0
    for of, part, c in counts:
        first, held = ranges.get(of, (n, 0))
        bases[of, part], ranges[of] = held, (first, held + c)
        n += c
    place_of = spark.sparkContext.broadcast((bases, ranges))
    sample = b"".join(bytes(r["ids"]) for r in packed.select("ids").limit(DICTIONARY).collect())
    words = spark.sparkContext.broadcast(sample)

    def dictionary():  # noqa: ANN202
        import zstandard

        return zstandard.ZstdCompressionDict(words.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bases, ranges = place_of.value
        squeeze = zstandard.ZstdCompressor(level=6, dict_data=dictionary()).compress
        for batch in slices(batches, 1024):
            of, part, seq = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            index = np.array([bases[k] for k in zip(of, part)], np.int64) + seq
            slots, names = np.empty(len(index), np.int64), np.array(of, object)
            for name in set(of):
                here, (first, held) = names == name, ranges[name]
                slots[here] = first + permute(index[here], held, seed + zlib.crc32(name.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // shard).astype(np.int32)), *batch.columns[3:6], pa.array([squeeze(x.as_buffer()) for x in batch.column(6)], pa.binary())], ["slot", "shard", "n_tokens", "doc_ids", "starts", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        unpack = zstandard.ZstdDecompressor(dict_data=dictionary()).decompress
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, number, kept = None, "", -1, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, kept
            if out is not None:
                out.close()
                store.move(name, f"{root}/shard-{number:06d}.bin")
                yield from kept
                out, kept = None, []

        for batch in batches:
            shards = batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if shards[lo] != number or out is None:
                    yield from close()
                    number = int(shards[lo])
                    name = f"{root}/.shard-{number:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                data = [unpack(x.as_buffer()) for x in batch.column(5).slice(lo, hi - lo)]
                for x in data:
                    out.write(x)
                slots = batch.column(0).slice(lo, hi - lo)
                crc = [zlib.crc32(x) for x in data]
                kept.append(
                    pa.RecordBatch.from_arrays(
                        [slots, pa.array([number] * (hi - lo), pa.int32()), pa.array((slots.to_numpy() - number * shard) * (2 * sequence)), batch.column(2).slice(lo, hi - lo), pa.array(crc, pa.int64()), batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo)],
                        ["slot", "shard", "offset", "n_tokens", "crc", "doc_ids", "starts"],
                    )
                )
        yield from close()

    placed = map_batches(packed, place, "slot long, shard int, n_tokens int, doc_ids array<long>, starts array<int>, ids binary")
    dealt = placed.repartitionById(max(1, -(-n // shard)), F.col("shard")).sortWithinPartitions("slot")
    return map_batches(dealt, write, "slot long, shard int, offset long, n_tokens int, crc long, doc_ids array<long>, starts array<int>")


def shard_folder(spark: SparkSession, name: str = "shards") -> str:
    """A new folder for shards inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_slots(folder: str, first: int, count: int, sequence: int = SEQUENCE, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences from a slot on, read in order; the way to resume a training run."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    slot = first
    while slot < first + count:
        k, at = divmod(slot, shard)
        with store.open_input_file(f"{root}/shard-{k:06d}.bin") as f:
            f.seek(at * 2 * sequence)
            while slot < first + count and slot // shard == k:
                data = f.read(2 * sequence)
                if not data:
                    return
                yield np.frombuffer(data, "<u2")
                slot += 1
