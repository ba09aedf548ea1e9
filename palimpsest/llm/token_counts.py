"""Token counts without token ids.

Byte-level BPE never merges across pre-tokens. Each distinct pre-token of the
corpus is encoded once; a document's count is the sum of its pre-tokens'
frequencies times their numbers of pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, staged, tokenizer
from palimpsest.llm.lexicon import HEAD_TERMS, head
from palimpsest.workers import map_batches

#: Fixed value: the pre-tokens of the byte-level vocabulary. White space is spelt
#: out since engines differ on the control characters 0x1C to 0x1F.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Distinct pre-tokens that a task gathers before it passes them on.
_GATHER = 200_000


class PreTokens:
    """Splits a text as the tokenizer file does: special strings first, then the pattern."""

    def __init__(self, specials: list[str]):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def count(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies and the number of special tokens."""
        if self.specials is None or not self.specials.search(text):
            return Counter(self.find(text)), 0
        parts = self.specials.split(text)
        out: Counter = Counter()
        for part in parts:
            out.update(self.find(part))
        return out, len(parts) - 1


def special_strings(path: str) -> list[str]:
    import json

    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n, n_tokens): every distinct pre-token, its count and its number of tokens."""
    specials = special_strings(path)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = PreTokens(specials), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(split.count(text)[0] if text else ())
                if len(seen) > _GATHER:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            sizes = [len(e.ids) for e in tokenizer(path).encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["piece", "n", "n_tokens"])

    distinct = map_batches(docs.select("text"), gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return map_batches(distinct, encode, "piece string, n long, n_tokens long")


def token_counts(docs: DataFrame, path: str, head_terms: int = HEAD_TERMS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row for each row of ``docs``.

    Counts are those of the tokenizer file at ``path`` (a byte-level BPE .json)
    without added begin or end tokens; a special string inside a text is one
    token. Null and empty texts have no bytes and no tokens. Null and repeated
    doc_ids each keep their row. Only doc_id and text are read.
    """
    table = staged(vocabulary(docs, path), "pre-tokens")
    known = docs.sparkSession.sparkContext.broadcast(head(table, "piece", "n", "n_tokens", head_terms))
    specials = special_strings(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, get = PreTokens(specials), known.value.get
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            sizes, sums, pieces, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                found, special = split.count(text or "")
                total, rare, often = special, [], []
                for piece, n in found.items():
                    if (tokens := get(piece)) is None:
                        rare.append(piece)
                        often.append(n)
                    else:
                        total += tokens * n
                sizes.append(len(text.encode()) if text else 0)
                sums.append(total)
                pieces.append(rare)
                counts.append(often)
            ids = pa.array(range(row, row + len(sums)), pa.int64())
            row += len(sums)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "n_tokens", "pieces", "counts"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(map_batches(texts, count, "row long, doc_id long, n_bytes long, n_tokens long, pieces array<string>, counts array<long>"), "frequencies")
    tail = (
        rows.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("t"))
        .select("row", F.col("t.pieces").alias("piece"), F.col("t.counts").alias("n"))
        .join(table.select("piece", "n_tokens"), "piece")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("n_tokens")).alias("more"))
    )
    return rows.select("row", "doc_id", "n_bytes", "n_tokens").join(tail, "row", "left").select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
