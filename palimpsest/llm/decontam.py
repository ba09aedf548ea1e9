"""Benchmark decontamination by templates; DataFrame functions only.

A text is cut into words, and each becomes a template word: a number, a unit or a
name (a capitalised word inside a sentence, but for texts in a language that writes
all nouns so) gives a typed placeholder, any other word itself in lower case.
Windows of five template words of the documents meet those of the benchmark in a
hash join. Where a benchmark item is re-parameterised its windows still meet; then
the slots are compared, and the item counts only if every slot value maps to one
value of the document and back, over all of the item that the document holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import let, scratch, staged, without_keys

#: Words in a window, and the part of an item's words that must be found.
WINDOW, COVERED = 5, 0.6
#: Hashes of benchmark windows up to so many (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Words that are units.
UNITS = (
    "mm cm m km mg g kg t ml l s ms min h hr hrs mph kmh kph hz khz mhz w kw v kb mb gb tb inch inches foot feet yard yards mile miles ounce ounces pound pounds gram grams "
    "kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters liter liters litre litres second seconds minute minutes "
    "hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
#: Frequent small words of languages that write all nouns with a capital, of which one word in so many tells such a text.
NOUN_CAPITALS = "der die das und ist nicht ein eine mit den von zu im auf sich dem des".split()
NOUN_CAPITALS_SHARE = 12
#: Placeholders, and what joins the digits of one number; texts lose these characters first.
NUMBER, UNIT, NAME, JOIN = "\x01n", "\x01u", "\x01p", "\x02"
_WORD = r"\p{L}\p{N}"


def _where(text: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Change the texts that pass a cheap test; the text is computed once."""
    return let(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def plain_text(text: Column) -> Column:
    """The text with the digits of each number joined, so that a number is one word."""
    text = _where(F.coalesce(text, F.lit("")), lambda t: t.rlike(r"[\x01\x02]"), lambda t: F.translate(t, "\x01\x02", "  "))
    return _where(text, lambda t: t.rlike(r"[0-9]"), lambda t: F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", JOIN))


def capital_nouns(plain: Column) -> Column:
    """Whether a text is in a language in which a capital does not tell a name."""
    small = F.size(F.split(plain, rf" (?:{'|'.join(NOUN_CAPITALS)})(?= )")) - 1
    return small * NOUN_CAPITALS_SHARE > F.length(plain) / 6  # a word takes six characters or so


def template_text(plain: Column) -> Column:
    """Plain text with placeholders, each for one word.

    Names are replaced first, while capitals and sentence ends are still there: a
    capitalised word behind a word or comma, whose other letters are small.
    Patterns begin with what is rare, so that most positions fail at once.
    """
    name = rf"\p{{Lu}}(?<=[{_WORD},;:'\")][\x20\x09-\x0D]\p{{Lu}})\p{{Ll}}*(?![{_WORD}\x02])"
    out = F.lower(_where(plain, lambda t: ~capital_nouns(t), lambda t: F.regexp_replace(t, name, "\x01P")))
    number, units = rf"\d(?<![{_WORD}\x01\x02]\d)[\d\x02]*(?![{_WORD}\x02])", "|".join(sorted(UNITS, key=len, reverse=True))
    out = _where(out, lambda t: t.rlike(r"[0-9]"), lambda t: F.regexp_replace(t, number, NUMBER))
    return _where(out, lambda t: F.contains(t, F.lit(NUMBER)), lambda t: F.regexp_replace(t, rf"(\x01n[\x20\x09-\x0D]+)(?:{units})(?![{_WORD}\x02])", "$1\x01u"))


def raw_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, word for word those of ``template_words``."""
    return F.array_remove(F.split(F.lower(plain_text(text)), rf"[^{_WORD}\x02]+"), "")


def template_words(text: Column) -> Column:
    """One template word for each raw word."""
    return F.array_remove(F.split(template_text(plain_text(text)), rf"[^{_WORD}\x01\x02]+"), "")


def _hashes(words: Column, width: int) -> Column:
    """The hash of the window that starts at each word, in order; fewer words are one window."""
    return let(
        words,
        lambda w: F.when(F.size(w) < 1, F.array().cast("array<bigint>"))
        .when(F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(w[i + k] for k in range(width))))),
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item, n, p, width, by_template, by_word, raw, words, telling): the windows of each item.

    ``item`` is a hash of its text, raw are its words in lower case. An item
    shorter than a window is one window, which only a document of as few words
    can meet. Windows of placeholders with less than half of their words their own
    say nothing by themselves and are not telling, unless the item has no others.
    """
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"), raw_words(F.col("text")).alias("raw"), template_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.distinct().select("*", F.size("words").alias("n"), F.least(F.size("words"), F.lit(window)).alias("width"))
    rows = items.select("*", F.posexplode(F.arrays_zip(_hashes(F.col("words"), window).alias("t"), _hashes(F.col("raw"), window).alias("w"))).alias("p", "h"))
    part = lambda c: F.slice(c, F.col("p") + 1, F.col("width"))
    rows = rows.select("item_id", "item", "n", "p", "width", F.col("h.t").alias("by_template"), F.col("h.w").alias("by_word"), part("raw").alias("raw"), part("words").alias("words"))
    rows = rows.withColumn("telling", F.size(F.filter("words", lambda w: ~w.startswith("\x01"))) * 2 >= F.col("width"))
    return rows.withColumn("telling", F.col("telling") | ~F.max("telling").over(Window.partitionBy("item_id", "item")))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words, raw) of all texts with an id."""
    rows = docs.where("doc_id is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), template_words(F.col("text")).alias("words"), raw_words(F.col("text")).alias("raw"))


def met_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, q, by_template, by_word, doc_words, doc_raw): the windows of documents that have the hash of an item's.

    One scan looks up both hashes of every window. Only words of met windows leave
    it, where the hashes of the benchmark are few enough to broadcast.
    """
    texts = _texts(docs)
    # exploded as outer: compiled, so that no text is copied, and without a filter that computes the column twice
    rows = texts.withColumn("h", F.arrays_zip(_hashes(F.col("words"), window).alias("t"), _hashes(F.col("raw"), window).alias("w"))).select(*texts.columns, F.posexplode_outer("h").alias("q", "h"))
    rows = rows.select("doc_id", "text_hash", "words", "raw", "q", F.col("h.t").alias("by_template"), F.col("h.w").alias("by_word"))
    keys = [items.where("telling").select("by_template", F.lit(True).alias("t")).distinct(), items.select("by_word", F.lit(True).alias("w")).distinct()]
    few = items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    if few:
        met = rows
        for k in keys:
            met = met.join(F.broadcast(k), k.columns[0], "left")
        met = met.where("t or w")
    else:
        at = rows.select("doc_id", "text_hash", "q", "by_template", "by_word")
        at = at.join(keys[0], "by_template", "left_semi").unionByName(at.join(keys[1], "by_word", "left_semi")).distinct()
        met = at.join(texts, ["doc_id", "text_hash"])
    part = lambda c: F.slice(c, F.col("q") + 1, window)
    return met.select("doc_id", "text_hash", "q", "by_template", "by_word", part("words").alias("doc_words"), part("raw").alias("doc_raw")).distinct()


def beside(docs: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """The windows too poor in own words that follow their item's template where a telling one met at the same distance."""
    poor = items.where("not telling").drop("by_template", "by_word")
    at = met.select("doc_id", "text_hash", "item", "d").distinct().join(poor, "item")
    first = F.col("p") + F.col("d") + 1
    texts = _texts(docs).withColumnsRenamed({"words": "all_words", "raw": "all_raw"})
    rows = at.join(texts, ["doc_id", "text_hash"]).where((first >= 1) & (first + F.col("width") - 1 <= F.size("all_words")))
    part = lambda c: F.slice(c, F.greatest(first, F.lit(1)), F.col("width"))
    return rows.select(*met.columns[:-2], part("all_words").alias("doc_words"), part("all_raw").alias("doc_raw"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, item_id, item, n, p, d, width, telling, same, slots): windows of items that documents hold.

    d is the distance of the two positions, same tells that the words are as in
    the item in any letter case, slots are the placeholders with both values.
    """
    found = staged(met_windows(docs, items, window), "met-windows")
    columns = ["doc_id", "text_hash", "item_id", "item", "n", "p", "d", "width", "telling", "raw", "words", "doc_words", "doc_raw"]
    pair = lambda key, side: found.join(side.drop("by_word" if key == "by_template" else "by_template"), key).withColumn("d", F.col("q") - F.col("p")).select(columns)
    by_template = pair("by_template", items.where("telling")).where(_equal("words", "doc_words"))  # exact checks behind the hashes
    if not items.where("not telling").isEmpty():
        by_template = staged(by_template, "met-templates")
        by_template = by_template.unionByName(beside(docs, items, by_template).where(_equal("words", "doc_words")))
    slots = F.filter(
        F.zip_with(F.arrays_zip("words", "raw"), "doc_raw", lambda a, b: F.struct(a["words"].alias("kind"), a["raw"].alias("item"), b.alias("doc"))),
        lambda s: s["kind"].startswith("\x01"),
    )
    rows = by_template.select(*columns[:9], _equal("raw", "doc_raw").alias("same"), slots.alias("slots"))
    literal = pair("by_word", items).where(_equal("raw", "doc_raw")).select(*columns[:8], F.lit(False).alias("telling"), F.lit(True).alias("same"), F.array().cast(rows.schema["slots"].dataType).alias("slots"))
    return rows.unionByName(literal).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, coverage, verbatim): the items that documents hold.

    coverage is the part of the item's words in windows met. A window whose words
    are as in the item, in any letter case, counts. One with other values in its
    slots counts if these map one to one over the whole occurrence of the item
    (all stretches, which are windows at one distance, no further apart than the
    item is long), or else over its own stretch if that suffices alone. Windows
    poor in own words count with other values only beside a telling one. Pairs
    below ``covered`` are left out, and so are clean documents. verbatim tells
    whether the windows as in the item suffice. An item of fewer words than a
    window counts where it is all that a document says. Null and empty texts hold
    nothing; items without words are passed over; rows with a null doc_id cannot be
    named and are not searched; of different texts that share a doc_id each counts
    for itself, as do items; repeated rows and items count once; other columns
    are not read.
    """
    return _found(docs, benchmark, window, covered).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("verbatim").alias("verbatim"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, covered: float) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, verbatim) for each text and item."""
    with scratch(docs.sparkSession):
        return staged(_coverage(docs, benchmark, window, covered), "found", keep=True)


def _coverage(docs: DataFrame, benchmark: DataFrame, window: int, covered: float) -> DataFrame:
    items = staged(item_windows(benchmark, window), "item-windows")
    pair = ["doc_id", "text_hash", "item_id", "item", "n"]
    # a stretch holds at most one window for each word of its item, twice if also word for word
    slots_of = lambda which: F.array_distinct(F.flatten(F.collect_set(which)))
    stretch = matches(docs, items, window).groupBy(*pair, "d").agg(
        F.collect_set(F.struct("p", "width", "same", "telling")).alias("at"), slots_of(F.when(F.col("telling"), F.col("slots"))).alias("slots"), slots_of(F.col("slots")).alias("all_slots"), F.max("telling").alias("told")
    )
    by_place = Window.partitionBy(*pair).orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(by_place) > F.col("n"), F.lit(False)).cast("int")
    stretch = stretch.withColumn("apart", apart).withColumn("occurrence", F.sum("apart").over(by_place))
    one = stretch.groupBy(*pair, "occurrence").agg(F.collect_list(F.struct("at", "slots", "all_slots", "told")).alias("stretches"))
    ways = F.concat(F.array("stretches"), F.transform("stretches", lambda s: F.array(s)))
    words = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda w: F.sequence(w["p"], w["p"] + w["width"] - 1))))
    kinds = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda s: F.struct(s["kind"], s[side]))))
    one_to_one = lambda c: let(F.array_distinct(F.flatten(c)), lambda s: (kinds(s, "item") == F.size(s)) & (kinds(s, "doc") == F.size(s)))
    way = one.select(*pair, F.explode(ways).alias("way"))
    way = way.select(
        *pair, F.flatten(F.col("way.at")).alias("at"), one_to_one(F.col("way.slots")).alias("consistent"), (F.exists("way.told", lambda t: t) & one_to_one(F.col("way.all_slots"))).alias("all_consistent")
    )
    counts = F.filter("at", lambda w: w["same"] | (w["telling"] & F.col("consistent")) | (~w["telling"] & F.col("all_consistent")))
    way = way.select(*pair, words(counts).alias("held"), words(F.filter("at", lambda w: w["same"])).alias("same"))
    best = way.groupBy(*pair).agg(F.collect_set("held").alias("held"), F.array_distinct(F.flatten(F.collect_set("same"))).alias("same"))
    found = best.select(*pair, F.array_max(F.transform("held", lambda h: F.size(F.array_union(h, F.col("same"))))).alias("found"), F.size("same").alias("same"))
    return found.where(F.col("found") >= F.col("n") * covered).select("doc_id", "text_hash", "item_id", (F.col("found") / F.col("n")).alias("coverage"), (F.col("same") >= F.col("n") * covered).alias("verbatim"))


def _equal(a: str, b: str) -> Column:
    return F.array_join(a, " ") == F.array_join(b, " ")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    return without_keys(docs, _found(docs, benchmark, window, covered).select("doc_id", "text_hash"))
