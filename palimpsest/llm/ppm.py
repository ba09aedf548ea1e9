"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts holds how often each byte followed each context. A byte
is coded in the longest context that the trie has; each context left on the way
costs an escape (estimated from its number of distinct bytes), and bytes seen in
a longer context are excluded from the shorter ones. Byte 0xFF, which UTF-8 never
holds, pads the start and ends the text.

The pretrained model counts contexts of up to four bytes over the whole training
set. What travels to the workers is bounded: at most ``TRIE_PAIRS`` pairs of a
context of two to four bytes and a next byte, of the contexts seen most often,
and all shorter ones. Bytes behind any other context are counted for each text and
joined with the whole tables, so that the bound changes no score. Since every context holds the bytes seen after any longer
one, what an exclusion takes away is one number a context, and scores come from
hash tables in numpy arrays, level by level, for many texts at once. The adaptive
model (any order) starts from an empty trie with each document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_mod, slices, staged
from palimpsest.llm.lexicon import HEAD_TERMS, count_class, head
from palimpsest.workers import map_batches

END = 0xFF
ORDER = 4
#: Pairs (context of two bytes or more, next byte) of the trie that scores.
TRIE_PAIRS = 1_000_000
_GATHER = 200_000
#: Bytes of text that are looked up together; longer texts go in parts.
_WINDOW = 1 << 19
#: The end of a text as a token of the word model; no word is empty.
_END_WORD = b""


class Trie:
    """A byte-context trie of any order, one dictionary a context."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            seen = self.counts.setdefault(context[len(context) - k :], {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def learn(self, text: bytes) -> None:
        data = bytes([END]) * self.order + text + bytes([END])
        for i in range(self.order, len(data)):
            self.add(data[i - self.order : i], data[i])

    def log10(self, context: bytes, symbol: int) -> float:
        """Log probability of a byte: escapes down the contexts, seen bytes excluded."""
        total, out = 0.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            seen = {s: n for s, n in self.counts.get(context[len(context) - k :], {}).items() if s not in out}
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return total + math.log10(seen[symbol] / (n + d))
            if d:
                total += math.log10(d / (n + d))
                out |= seen.keys()
        return total - math.log10(256 - len(out))

    def score(self, text: bytes, learn: bool) -> float:
        data, total = bytes([END]) * self.order + text + bytes([END]), 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            total += self.log10(context, data[i])
            if learn:
                self.add(context, data[i])
        return total


def windows(texts: list[bytes], size: int = _WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owners) of all bytes to code: four bytes of context and the byte, and the text's number.

    Short texts share a window, a long one takes several.
    """
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) + ORDER + 1 <= size):
            total += len(texts[end]) + ORDER + 1
            end += 1
        data = np.frombuffer(b"".join(bytes([END]) * ORDER + t + bytes([END]) for t in texts[at:end]), np.uint8)
        starts = np.cumsum([0, *(len(t) + ORDER + 1 for t in texts[at:end])])
        for lo in range(ORDER, len(data), size):
            part = data[lo - ORDER : lo + size].astype(np.int64)
            code = part[ORDER:].copy()
            for k in range(1, ORDER + 1):
                code |= part[ORDER - k : len(part) - k] << (8 * k)
            place = np.arange(lo, lo + len(code))
            owner = np.searchsorted(starts, place, side="right") - 1
            real = place - starts[owner] >= ORDER
            yield code[real], owner[real] + at
        at = end


class Table:
    """An open-addressing hash table from distinct whole numbers to rows of float columns."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        row_of = np.zeros(1 << self.bits, np.int64)
        rows, slots = np.arange(len(keys)), self._home(keys)
        while len(rows):
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            won = np.zeros(len(rows), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]] = keys[rows[won]]
            row_of[slots[won]] = rows[won]
            rows, slots = rows[~won], (slots[~won] + 1) & ((1 << self.bits) - 1)
        self.columns = [(c[row_of] if len(keys) else np.zeros(1 << self.bits)).astype(np.float32) for c in columns]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slots = self._home(keys)
        held = self.keys[slots]
        out = np.where(held == keys, slots, -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at = (slots[open_] + 1) & ((1 << self.bits) - 1)
            slots[open_] = at
            held = self.keys[at]
            out[open_] = np.where(held == keys[open_], at, -1)
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return out


def _tag(code: np.ndarray, order: int) -> np.ndarray:
    """Numbers of different orders kept apart."""
    return code | (order << 48)


@dataclass
class Model:
    """The trie as two tables: (context, byte) pairs, and contexts."""

    pairs: Table  # log10 of: probability as the longest context; count
    contexts: Table  # log10 of: escape as the longest context; rest behind an exclusion in the next shorter one; escape from that
    floor: float
    whole: bool = True  # no context was left out

    def missed(self, code: np.ndarray) -> np.ndarray:
        """Which bytes of ``windows`` this trie may not tell: those behind four bytes that it lacks."""
        return np.zeros(len(code), bool) if self.whole else self.contexts.find(_tag(code >> 8, ORDER)) < 0

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log probabilities of the bytes of ``windows``."""
        out, rows = np.zeros(len(code)), np.arange(len(code))
        above = np.full(len(code), -1)  # the context just left, whose bytes are excluded
        for k in range(ORDER, -1, -1):
            if not len(rows):
                break
            own = code[rows] & ((1 << (8 * (k + 1))) - 1)
            slot = self.pairs.find(_tag(own, k))
            hit, fresh = slot >= 0, above < 0
            direct, behind = hit & fresh, hit & ~fresh
            out[rows[direct]] += self.pairs.columns[0][slot[direct]]
            out[rows[behind]] += self.pairs.columns[1][slot[behind]] - self.contexts.columns[1][above[behind]]
            rows, above, own = rows[~hit], above[~hit], own[~hit]
            if not len(rows):
                break
            context = self.contexts.find(_tag(own >> 8, k))
            left = above >= 0
            out[rows[left]] += self.contexts.columns[2][above[left]]
            new = ~left & (context >= 0)
            out[rows[new]] += self.contexts.columns[0][context[new]]
            above = context
        out[rows] += self.floor
        return out

    def split_score(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores without the bytes missed, and these for each text: (codes, counts)."""
        total, rest = np.zeros(len(texts)), [[np.empty((2, 0), np.int64)] for _ in texts]
        for code, owner in windows(texts):
            out = self.missed(code)
            total += np.bincount(owner[~out], self.log10(code[~out]), len(texts))
            code, owner = code[out], owner[out]
            for t in np.unique(owner).tolist():
                rest[t].append(np.stack(np.unique(code[owner == t], return_counts=True)))
        return total, [tuple(np.concatenate(r, axis=1)) for r in rest]

    def score(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        for code, owner in windows(texts):
            total += np.bincount(owner, self.log10(code), len(texts))
        return total


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of (code, count) pairs for each order from 0 on.

    Every context's next shorter one must be there too, with all its bytes.
    """
    pair_keys, top, counts, context_keys, escape, rest, escape_on = [], [], [], [], [], [], []
    below: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    for k, (code, n) in enumerate(levels):
        order = np.argsort(code)
        code, n = code[order].astype(np.int64), n[order].astype(np.float64)
        context, first, d = np.unique(code >> 8, return_index=True, return_counts=True)
        total = np.add.reduceat(n, first) if len(n) else np.empty(0)
        pair_keys.append(_tag(code, k))
        top.append(np.log10(n / np.repeat(total + d, d)))
        counts.append(np.log10(n))
        context_keys.append(_tag(context, k))
        escape.append(np.log10(d / (total + d)))
        if below is None:
            rest.append(np.zeros(len(context)))
            escape_on.append(np.zeros(len(context)))
        else:
            b_code, b_n, b_context, b_total, b_d = below
            same = b_n[np.searchsorted(b_code, code & ((1 << (8 * k)) - 1))] if len(code) else np.empty(0)
            up = np.searchsorted(b_context, context & ((1 << (8 * (k - 1))) - 1)) if k else None
            free_n = b_total[up] - (np.add.reduceat(same, first) if len(n) else np.empty(0))
            free_d = b_d[up] - d
            with np.errstate(divide="ignore", invalid="ignore"):
                rest.append(np.where(free_d > 0, np.log10(free_n + free_d), 0.0))
                escape_on.append(np.where(free_d > 0, np.log10(free_d / (free_n + free_d)), 0.0))
        below = code, n, context, total, d
    whole = np.concatenate
    seen = len(levels[0][0])
    return Model(Table(whole(pair_keys), [whole(top), whole(counts)]), Table(whole(context_keys), [whole(escape), whole(rest), whole(escape_on)]), -math.log10(max(256 - seen, 1)))


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each byte followed each four bytes, over all texts of ``docs``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches):
            texts = [t.lower() for t in batch.column(1).to_pylist()]
            for code, _ in windows(texts, 1 << 22):
                held.append(np.unique(code, return_counts=True))
                if sum(len(c) for c, _ in held) > 1 << 21:
                    held = [merged(held)]
                    if len(held[0][0]) > 1 << 20:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged(held))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return code, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return map_batches(_binary(docs), gather, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train_model(docs: DataFrame, pairs: int = TRIE_PAIRS) -> Model:
    """The bounded trie of ``trained``."""
    return trained(docs, pairs)[0]


def trained(docs: DataFrame, pairs: int = TRIE_PAIRS) -> tuple[Model, list[DataFrame]]:
    """The bounded trie, and the whole tables (code, n) of each order from 0 on.

    Count the contexts of all texts; keep those of the bounded trie.

    Contexts of two bytes or more are ranked by how often they were seen, in
    classes of counts (at most a few hundred rows come to the driver for that),
    and whole classes are kept, from the top, while their pairs fit the bound. A
    shorter context is seen at least as often, so it is kept with each longer one.
    """
    grams = staged(gram_counts(docs), "grams")
    levels = [grams.groupBy((F.col("code").bitwiseAND((1 << (8 * (k + 1))) - 1)).alias("code")).agg(F.sum("n").alias("n")) for k in range(ORDER)] + [grams]
    contexts = [level.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("d")) for level in levels[2:]]
    sizes: Counter = Counter()
    for c in contexts:
        for r in c.groupBy(count_class(F.col("total")).alias("k")).agg(F.sum("d").alias("d")).collect():
            sizes[r["k"]] += r["d"]
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > pairs:
            break
        least = k
    got = []
    for k, level in enumerate(levels):
        if k >= 2:
            kept = contexts[k - 2].where(count_class(F.col("total")) >= least if least is not None else F.lit(False)).select("context")
            level = level.withColumn("context", F.shiftright("code", 8)).join(kept, "context", "left_semi").select("code", "n")
        table = level.toArrow()
        got.append((table.column(0).to_numpy(), table.column(1).to_numpy()))
    model = build(got)
    model.whole = held <= pairs
    return model, levels


def exact(codes: DataFrame, levels: list[DataFrame], floor: float) -> DataFrame:
    """(code, log10) of distinct codes of ``windows`` by the whole tables, as ``Trie.log10``."""
    low = lambda k: F.col("code").bitwiseAND((1 << (8 * k)) - 1)
    rows, below = codes, None
    for k, level in enumerate(levels):
        context = F.shiftright("code", 8)
        if below is None:
            found = level.groupBy(context.alias("context")).agg(F.sum("n").alias("t0"), F.count(F.lit(1)).alias("d0"), F.lit(0).cast("long").alias("fn0"), F.lit(0).cast("long").alias("fd0"))
        else:
            shorter = levels[k - 1].select(F.col("code").alias("shorter"), F.col("n").alias("same"))
            found = level.withColumn("shorter", low(k)).join(shorter, "shorter").groupBy(context.alias("context")).agg(F.sum("n").alias(f"t{k}"), F.count(F.lit(1)).alias(f"d{k}"), F.sum("same").alias("same"))
            found = found.withColumn("suffix", F.col("context").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(below.select(F.col("context").alias("suffix"), F.col(f"t{k - 1}").alias("t"), F.col(f"d{k - 1}").alias("d")), "suffix")
            found = found.select("context", f"t{k}", f"d{k}", (F.col("t") - F.col("same")).alias(f"fn{k}"), (F.col("d") - F.col(f"d{k}")).alias(f"fd{k}"))
        rows = rows.withColumn("own", low(k + 1)).join(level.select(F.col("code").alias("own"), F.col("n").alias(f"n{k}")), "own", "left")
        rows = rows.withColumn("context", F.shiftright("own", 8)).join(found, "context", "left").drop("own", "context")
        below = found
    value = F.lit(floor)  # rows that end in a longer context get values here too, which go unused
    for k, _ in enumerate(levels):  # from the shortest context on: what is left to pay once k is reached
        n, t, d = F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"d{k}")
        fresh = F.when(n.isNotNull(), F.log10(n / (t + d))).otherwise(F.when(t.isNotNull(), F.log10(d / (t + d))).otherwise(0.0) + value)
        if k < ORDER:
            free_n, free_d = F.col(f"fn{k + 1}"), F.col(f"fd{k + 1}")
            behind = F.when(n.isNotNull(), F.log10(F.try_divide(n, free_n + free_d))).otherwise(F.when(free_d > 0, F.log10(F.try_divide(free_d, free_n + free_d))).otherwise(0.0) + value)
            fresh = F.when(F.col(f"t{k + 1}").isNotNull(), behind).otherwise(fresh)
        rows = rows.withColumn(f"v{k}", fresh)
        value = F.col(f"v{k}")
    return rows.select("code", value.alias("log10"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``docs``, the end of each text included as an empty word."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                seen.update(text.lower().split())
                seen[_END_WORD] += 1
                if len(seen) > _GATHER:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    return map_batches(_binary(docs), gather, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, train: DataFrame, head_terms: int = HEAD_TERMS, pairs: int = TRIE_PAIRS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row a document.

    The models are learnt from all of ``train``: a byte trie for score and an
    add-half word model for base_score. Null texts are empty ones: one end token
    and the code length of an end. Null and repeated ids keep their rows. Without
    training texts every byte costs log10(256). Only doc_id and text are read.
    """
    spark = docs.sparkSession
    trie, levels = trained(train, pairs)
    model = spark.sparkContext.broadcast(trie)
    words = staged(word_counts(train), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    below = math.log10(total + 0.5 * (distinct + 1))
    known = spark.sparkContext.broadcast(head(words, "word", "c", "c", head_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, get = TaskContext.get().partitionId() << 33, known.value.get
        for batch in slices(batches):
            texts = [t.lower() for t in batch.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(5)]
            for text in texts:
                tokens = text.split()
                tokens.append(_END_WORD)
                found = list(map(get, tokens))
                c = np.array([x for x in found if x is not None], np.float64)
                rare = Counter(t for t, x in zip(tokens, found) if x is None) if len(c) < len(found) else {}
                for x, v in zip(out, (len(tokens), len(c), float((np.log10(c + 0.5) - below).sum()), list(rare), list(rare.values() if rare else ()))):
                    x.append(v)
            n = len(texts)
            scores, missed = model.value.split_score(texts)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(scores, pa.float64()), *(pa.array(x, k) for x, k in zip(out, kinds)), *(pa.array([m[i] for m in missed], pa.list_(pa.int64())) for i in (0, 1))],
                ["row", "doc_id", "score", "n_tokens", "n_known", "base_score", "rare", "counts", "codes", "times"],
            )
            row += n

    rows = staged(map_batches(_binary(docs), run, "row long, doc_id long, score double, n_tokens long, n_known long, base_score double, rare array<binary>, counts array<long>, codes array<long>, times array<long>"), "scores")
    if not trie.whole:
        missed = rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("t")).select("row", F.col("t.codes").alias("code"), F.col("t.times").alias("times"))
        left = missed.join(exact(missed.select("code").distinct(), levels, trie.floor), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("left"))
        rows = rows.join(left, "row", "left").withColumn("score", F.col("score") + F.coalesce("left", F.lit(0.0))).drop("left")
    tail = (
        rows.select("row", F.explode(F.arrays_zip("rare", "counts")).alias("t"))
        .select("row", F.col("t.rare").alias("word"), F.col("t.counts").alias("n"))
        .join(words, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - below)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"))
    )
    return rows.drop("rare", "counts", "codes", "times").join(tail, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"
    )


def adaptive(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, score): each text coded by a trie that learns from that text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [Trie(order).score(t.lower(), learn=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(_binary(docs), run, "doc_id long, score double")


def held_out(col, fold: int = 5):  # noqa: ANN001, ANN201
    """Whether crc32 of the id as text leaves one; false for null."""
    return F.coalesce(crc_mod(col, fold) == 1, F.lit(False))
