"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, mixing, ppm, quality, rules, shards, simhash, token_counts, urls
from palimpsest.llm.queries import URL_RULES, vocabulary

LONG = "word " * 30_000 + "x" * 300_000
TEXTS = [None, "", " \n\t", "one", "The same text of a few words, twice over in the table.", "The same text of a few words, twice over in the table.", LONG, "ünï ☃ 12,5 km <|endoftext|> \x01\x02", "a b c d e f g h i j k l"]
#: Names that operators use inside.
CLASH = ("fp", "key", "row", "words", "h", "n", "size", "u", "v", "piece", "kept", "score", "w", "limits", "seq", "copies", "at", "w", "m", "__time", "level", "q")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3]) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "a"), (1, "", None, "b"), (3, "one", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in dict.fromkeys(CLASH)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0), (2, None, 1), (None, 1, 0), (3, 1, 0), (3, 1, 0), (4, 1, 0), (7, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "d e f g h i"), (1, "d e f g h i"), (2, None), (3, ""), (None, "no id here at all"), (4, "one")], "item_id long, text string")


def run_all(spark, docs, labels, benchmark, tmp_path):
    tokenizer = shards.Tokenizer(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return {
        "quality": quality.classify(docs, labels),
        "rules": rules.apply_rules(docs),
        "counts": token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")),
        "mix": mixing.plan(docs),
        "simhash": simhash.near_duplicates(docs),
        "ppm": ppm.score(docs, docs),
        "decontaminate": decontam.contaminated(docs, benchmark),
        "shards": shards.write_shards(docs, tokenizer, f"file://{tmp_path}/shards", sequence=64, shard=100),
        "good": quality.keep_good(docs, labels),
        "representatives": simhash.representatives(docs),
        "clean": decontam.keep_clean(docs, benchmark),
        "mixed": mixing.mixed(docs),
    }


def test_defined_results(spark, docs, labels, benchmark, tmp_path):
    out = {k: v.collect() for k, v in run_all(spark, docs, labels, benchmark, tmp_path).items()}
    n = docs.count()
    for one_row_each in ("quality", "rules", "counts", "mix", "simhash", "ppm"):
        assert len(out[one_row_each]) == n, one_row_each
        assert sum(r["doc_id"] is None for r in out[one_row_each]) == 1
    assert all(0 <= r["score"] <= 1 for r in out["quality"])
    assert {r["doc_id"]: r["base_failed"] for r in out["rules"]}[0]
    assert {r["doc_id"]: r["n_words"] for r in out["rules"]}[6] == 30_001
    assert {r["n_tokens"] for r in out["counts"] if r["doc_id"] in (0, 1)} == {0}
    assert {r["fp"] for r in out["simhash"] if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in out["simhash"] if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in out["simhash"] if r["doc_id"] in (4, 5)} == {4}
    assert {r["n_tokens"] for r in out["ppm"] if r["doc_id"] in (0, 1)} == {1}
    assert {(r["doc_id"], r["item_id"]) for r in out["decontaminate"]} == {(8, 1), (3, 4)}
    assert {r["doc_id"] for r in out["clean"]} == {None, 0, 1, 2, 4, 5, 6, 7}
    kept = [r["doc_id"] for r in out["representatives"]]
    assert len(kept) == len(set(kept)) and {0, 3, 4, 6, None} <= set(kept) and 5 not in kept
    assert sorted(r["slot"] for r in out["shards"]) == list(range(len(out["shards"])))
    assert all(r["taken"] == r["size"] * r["copies"] for r in out["mix"])


def test_filters_keep_all_columns(spark, docs, labels, benchmark, tmp_path):
    out = run_all(spark, docs, labels, benchmark, tmp_path)
    for name in ("good", "representatives", "clean", "mixed"):
        assert out[name].columns == docs.columns


def test_empty_tables(spark, docs, labels, benchmark, tmp_path):
    none = docs.limit(0)
    for name, df in run_all(spark, none, labels.limit(0), benchmark.limit(0), tmp_path).items():
        assert df.count() == 0, name
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0
    assert {r["predicted"] for r in quality.classify(docs, labels.limit(0)).collect()} == {1}


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first: <|end|>\n & < [ &lt;"), (None, 0, "assistant", "x"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "assistant", LONG), (3, 0, "a<|sep|>b", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat.text_part(F.col("text")).alias("parts"), F.lit("clash").alias("segment"), F.lit(1).alias("at"))
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", "first: <|end|>\n & < [ &lt;"), ("user", ""), ("assistant", ""), ("assistant", "")]
    assert got[None]["loss"] == "x" and got[2]["loss"] == LONG and got[1]["loss"] == ""
    assert [tuple(t) for t in got[3]["turns"]] == [("a<|sep|>b", "t")]
    assert chat.format_conversations(df.limit(0)).count() == 0
    nothing = df.withColumn("parts", F.lit(None).cast(df.schema["parts"].dataType))
    assert chat.format_conversations(nothing).where("conv_id = 2").first()["formatted"] == "<|start|>assistant<|sep|><|end|>\n"


def test_url_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", None), (4, "http://", None), (5, "HTTP://Sub.Example.ORG/es/x?q#f", None), (6, "http://org/", None), (6, "http://org/", None), (None, "http://a.com/de/", None), (7, "x://y.com/fr/://z.com/de/", None), (8, "http://a.b.c.net" + "/p" * 50_000, LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("suffix", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(spark, URL_RULES)).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("", None, "allow")
    assert got[5] == ("sub.example.org", "example.org/es/", "block")
    assert got[6] == ("org", "org/", "allow") and got[None][1:] == ("com/de/", "block") and got[7] == ("y.com", "com/fr/", "allow")
    assert urls.judge(df, urls.rule_table(spark, URL_RULES)).count() == len(rows)
    assert urls.judge(df.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0


def test_documents_that_the_mix_leaves_out_are_dealt_over_all_ranges(spark):
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, id, null) as doc_id", "id as size", "if(id % 4 = 3, id / 4000D, null) as first_read")
    parts = mixing.in_order(rows, "first_read", 8).withColumn("p", F.spark_partition_id()).collect()
    assert len(parts) == 4000
    for p in range(8):
        own = [r["first_read"] for r in parts if r["p"] == p]
        assert 300 < own.count(None) < 450
        times = [t for t in own if t is not None]
        assert times == sorted(times) and own[: len(times)] == times and all(p / 8 <= t < (p + 1) / 8 for t in times)
