"""Quality rules whose thresholds come from mergeable quantile sketches.

A sketch of a measure is a histogram over values cut to their eight leading bits,
so that any quantile is known within 1/128, and sketches merge by adding counts.
One grouping sums them per language and source; the sketches of a language and of
all documents are merged from these, for groups too small to judge by themselves.
A document goes if a measure lies far above or below its group's quartiles, by the
distance of these; a short text, whose measures scatter more, may lie further off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import let, staged, word_array

#: Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Measures of a document with words (whole numbers): centi-characters of a word, and in a thousand
#: ASCII characters other than letters and ASCII capitals among characters, words of one character and distinct words among words.
#: Each with the least distance that its quartiles are taken to have, so that a group full of copies is not cut at their edge.
MEASURES = {"word_centichars": 12, "other_per_mille": 4, "capitals_per_mille": 2, "singles_per_mille": 5, "distinct_per_mille": 60}
#: Distances of the quartiles that a measure may lie beyond them, words at which a text may lie twice as far off, rows a group must have.
SPREADS, SHORT_WORDS, GROUP_ROWS = 8, 100, 200
#: Leading bits of a value that a sketch keeps.
SKETCH_BITS = 8


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words lying in windows of ``width`` words that occur twice or more.

    Windows compare by 64-bit hash. Those of most texts are all distinct, which a
    set tells; for the others the windows sort by hash, equal neighbours give the
    positions, and these the covered words. Nothing is quadratic in the text.
    """

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(w[i + k] for k in range(width))))
        )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: let(positions(r), count))

    def positions(r: Column) -> Column:
        twice = F.filter(r, lambda x, j: F.coalesce(x["h"] == F.get(r, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(r, j + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(p: Column) -> Column:
        reach = F.transform(p, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1), i + width) - i))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    return let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, base verdict and measures (null without words)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda c: c.cast("long")
    words = lambda w: F.struct(
        count(F.size(w)).alias("n_words"), count(F.length(F.array_join(w, ""))).alias("word_chars"), repeat_words(w).alias("n_repeat_words"),
        count(F.size(F.filter(w, lambda x: F.length(x) == 1))).alias("singles"), count(F.size(F.array_distinct(w))).alias("distinct_words"),
    )
    row = docs.select(
        "doc_id", "lang", "source", let(word_array(F.col("text")), words).alias("w"),
        count(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        let(lines, lambda x: count(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        F.length(F.regexp_replace(text, r"[^!-@\[-`{-~]+", "")).alias("others"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).alias("capitals"),
    )
    row = row.select("doc_id", "lang", "source", "w.*", "n_symbols", "n_dup_lines", "others", "capitals")
    per = lambda part, whole, of=1000: F.when(F.col("n_words") > 0, F.expr(f"{of} * {part} div {whole}"))
    return row.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
        per("word_chars", "n_words", 100).alias("word_centichars"),
        per("others", "word_chars").alias("other_per_mille"),
        per("capitals", "word_chars").alias("capitals_per_mille"),
        per("singles", "n_words").alias("singles_per_mille"),
        per("distinct_words", "n_words").alias("distinct_per_mille"),
    )


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): mergeable histograms, values cut to their leading bits."""
    stacked = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for m in MEASURES)))
    low = lambda v: F.expr("shiftleft(shiftright({0}, {1}), {1})".format(v, f"greatest(length(bin({v})) - {SKETCH_BITS}, 0)"))
    values = rows.where("not base_failed").select("lang", "source", stacked.alias("s")).select("lang", "source", "s.*").where("value is not null")
    return values.groupBy("lang", "source", "measure", low("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(level, lang, source, measure, q1, q3, spread, rows): the quartiles and their distance, for groups, languages and all."""
    nothing = F.lit(None).cast("string")
    levels = [
        sketches.select(F.lit(0).alias("level"), "lang", "source", "measure", "value", "n"),
        sketches.select(F.lit(1).alias("level"), "lang", nothing.alias("source"), "measure", "value", "n"),
        sketches.select(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source"), "measure", "value", "n"),
    ]
    by = ["level", "lang", "source", "measure"]
    merged = reduce(DataFrame.unionByName, levels).groupBy(*by, "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    ranked = merged.select(*by, "value", F.sum("n").over(group.orderBy("value")).alias("upto"), F.sum("n").over(group).alias("rows"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("value")))
    found = ranked.groupBy(*by).agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("rows").alias("rows"))
    least = reduce(lambda c, m: c.when(F.col("measure") == m, MEASURES[m]), MEASURES, F)
    return found.select(*by, "q1", "q3", F.greatest(F.col("q3") - F.col("q1"), least).alias("spread"), "rows")


def apply_rules(docs: DataFrame, spreads: int = SPREADS, short_words: int = SHORT_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, counts.., base_failed, kept) for every row of ``docs``.

    A document that passes the base rules is kept if each of its measures lies
    within ``spreads`` distances of the quartiles of its language and source,
    times 1 + ``short_words`` / n_words, above the upper and below the lower one. A
    group of fewer than ``group_rows`` measured documents goes by its language, and
    a small language by all documents. Null texts have no words and fail the base
    rule; null languages and sources are groups of their own; repeated rows each
    stay; other columns are not read.
    """
    rows = staged(measure(docs), "measures")
    n = F.col("n_words")

    def fit(m: str) -> Column:
        at, allowed = F.col("limits")[m], spreads * (n + short_words)
        beyond = F.greatest(F.col(m) - at["q3"], at["q1"] - F.col(m))
        return F.coalesce(beyond * n <= at["spread"] * allowed, F.lit(True))

    fits = reduce(lambda a, b: a & b, map(fit, MEASURES))
    limits = group_limits(thresholds(sketch(rows)), group_rows).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select(*_COUNTS, "base_failed", (~F.col("base_failed") & fits).alias("kept"))


def group_limits(limits: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, limits): for each group its own quartiles, its language's or those of all."""
    limits = staged(limits, "thresholds")
    wide = limits.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), F.struct(*(F.struct(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(c) for c in ("q1", "q3", "spread"))).alias(m) for m in MEASURES)).alias("limits"))
    at = lambda level, name: wide.where(F.col("level") == level).select("lang", "source", F.col("rows").alias(f"{name}_rows"), F.col("limits").alias(name))
    lang = at(1, "by_lang").drop("source").withColumnRenamed("lang", "of_lang")
    every = at(2, "every").drop("lang", "source", "every_rows")  # one row
    groups = at(0, "own").join(lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    chosen = F.when(F.col("own_rows") >= group_rows, F.col("own")).when(F.col("by_lang_rows") >= group_rows, F.col("by_lang")).otherwise(F.col("every"))
    return groups.select("lang", "source", chosen.alias("limits"))


_COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
