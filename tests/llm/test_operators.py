"""Each operator against a plain version of itself."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, mixing, ppm, quality, rules, shards, simhash, token_counts, urls
from palimpsest.llm.components import connected_components
from palimpsest.llm.lexicon import head
from palimpsest.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def components(edges, nodes=()):
    parent = {x: x for e in edges for x in e} | {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


# components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 400)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(x, c) for x, c in components([e for e in edges if e[0] != e[1]]).items()}


# op1


def test_classifier_on_held_out_rows(spark):
    got = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert right > 0.97 > max(np.mean([r["quality"] for r in rows]), 0.5)


def test_forest_walk_is_that_of_single_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = quality.fit(x, y, trees=20)

    def one(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [one(r) for r in x])
    assert ((f.score(x) > 0.5) == (y > 0)).mean() > 0.95


def test_held_out_labels_and_other_columns_change_no_score(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = (sorted(map(tuple, x.collect())) for x in (quality.classify(docs, labels), quality.classify(other, flipped)))
    assert a == b


# op2

ITEM = "Tom walks 12 km to Leeds and then cycles 30 km back home before his dinner, how far did Tom go in all that time?"


@pytest.mark.parametrize(
    ("text", "found", "verbatim"),
    [
        (ITEM, True, True),
        (f"Some words before it. {ITEM} And some more words after it.", True, True),
        (ITEM.replace("Tom", "Ann").replace("12", "7.5").replace("30", "44").replace("Leeds", "York"), True, False),
        (ITEM.replace("dinner", "supper"), True, True),
        (ITEM.lower(), False, None),
        # two slots changed, but most windows are as in the item
        (ITEM.replace("did Tom", "did Bob").replace("12", "5"), True, True),
        (ITEM[:40], False, None),
        ("The cat sat on the mat and then cycles were sold before his eyes.", False, None),
    ],
)
def test_templates(spark, text, found, verbatim):
    got = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    if text == ITEM.lower():
        return  # names in small letters are words of their own: either answer is fine
    assert bool(got) == found
    if found:
        assert got[0]["verbatim"] == verbatim


SLOTS = "So Tom paid 12 to Ann and Tom paid 30 to Sue and Ann paid 12 to Sue and Sue paid 30 to Tom"


@pytest.mark.parametrize(
    ("values", "found"),
    [
        ({"Tom": "Max", "Ann": "Eve", "Sue": "Liz", "12": "7", "30": "9"}, True),
        ({"Tom": "Max", "Ann": "Max", "Sue": "Liz", "12": "7", "30": "9"}, False),  # two names become one
        ({"Tom": "Max", "Ann": "Eve", "Sue": "Liz", "12": "7", "30": "7"}, False),  # two numbers become one
    ],
)
def test_slots_must_map_one_to_one(spark, values, found):
    text = " ".join(values.get(w, w) for w in SLOTS.split())
    got = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, SLOTS)], "item_id long, text string")).collect()
    assert bool(got) == found and not any(r["verbatim"] for r in got)


def test_planted_passages_are_found_and_nothing_else(spark, docs, texts):
    """Brute force: documents that hold at least 0.6 of an item's words in literal five-word windows."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, t in texts.items():
        w = words(t)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, item in items.items():
            hit = {i + j for i in range(len(item) - 4) if tuple(item[i : i + 5]) in grams for j in range(5)}
            if len(hit) >= 0.6 * len(item):
                want.add((d, k))
    got = decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def test_shuffled_windows_give_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == a


def test_template_words_pair_with_raw_words(spark):
    text = "In March, Tom Baker drove 3.5 km to Rome at 1,200 kph. Then he paid $40 and 5kg of A1."
    r = spark.createDataFrame([(text,)], "t string").select(decontam.raw_words(F.col("t")), decontam.template_words(F.col("t"))).first()
    assert len(r[0]) == len(r[1])
    assert r[1] == ["in", "\x01p", "\x01p", "\x01p", "drove", "\x01n", "\x01u", "to", "\x01p", "at", "\x01n", "\x01u", "then", "he", "paid", "\x01n", "and", "5kg", "of", "a1"]


# op3


def tokens(path, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_those_of_the_tokenizer(spark, docs, texts):
    path = vocabulary("byte_bpe_50k.json")
    odd = ["a\x1cb\x1d c", "x\u00a0\u3000y \u2028 z", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "don't we'LL I'm 've", "  two  spaces \n\n lines\t\t", "١٢٣ ⅷ x²", "e\u0301 नमस्ते 你好 😀👍🏽", "\x85\x00\u200b", "it's'st 're"]
    rng = random.Random(3)
    pieces = ["a", "Z", "é", "9", "²", " ", "\n", "\t", "\x1f", "\x85", "\u2003", "'", "s", "'ll", "!", "你", "😀", "\u0301", "<|endoftext|>", "<|"]
    odd += ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(400)]
    both = list(texts.values()) + odd
    df = spark.createDataFrame(list(enumerate(both)), "doc_id long, text string")
    for terms in (10_000, 50):  # the tail does most of the work in the second
        got = {r["doc_id"]: r for r in token_counts.token_counts(df, path, terms).collect()}
        assert [got[i]["n_tokens"] for i in range(len(both))] == tokens(path, both)
        assert all(got[i]["n_bytes"] == len(t.encode()) for i, t in enumerate(both))


def test_head_keeps_its_bounds(spark):
    table = spark.createDataFrame([(f"t{i}", 1000 // (i + 1) + 1) for i in range(500)] + [("x" * 500, 10**6)], "term string, n long")
    for terms, size in ((50, 1 << 20), (1000, 100), (0, 0)):
        got = head(table, "term", "n", "n", terms, size)
        assert len(got) <= terms and sum(map(len, got)) <= size and "x" * 500 not in got
    top = head(table, "term", "n", "n", 50)
    assert set(top) == {f"t{i}" for i in range(len(top))} and top


# op4


def test_parts(spark):
    parts = [("text", "see <|image|> & [x]", None, None), ("image", None, "s3://a.png", 576), ("text", "and", None, None), ("audio", "ignored", "b.wav", 100), ("document", None, "c.pdf", None), (None, "?", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok é", None, None), ("image", None, "d.png", 4)])], "conv_id long, turn long, role string, parts array<struct<type string, text string, ref string, n_tokens long>>")
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<|start|>user<|sep|>see &lt;|image|> &amp; &#91;x]<|image|>and<|audio|><|document|>?<|end|>\n<|start|>assistant<|sep|>ok é<|image|><|end|>\n"
    assert [(a["turn"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(0, "image", "s3://a.png", 576), (0, "audio", "b.wav", 100), (0, "document", "c.pdf", None), (1, "image", "d.png", 4)]
    assert r["expanded_tokens"] == 680
    (span,) = r["loss_mask"]
    assert r["formatted"][span["start"] : span["start"] + span["length"]] == "ok é"


def test_turns_of_one_place_sort_by_their_text(spark):
    """By the text as it came: the escapes would sort otherwise."""
    df = spark.createDataFrame([(1, 0, "assistant", t) for t in ("<a", "0b", "[c", "&")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).select(chat.read_turns(F.col("formatted")), chat.read_loss_text(F.col("formatted"), F.col("loss_mask"))).first()
    assert [t["content"] for t in r[0]] == sorted(["<a", "0b", "[c", "&"]) and r[1] == "&0b<a[c"


# op5


def test_block_decisions_follow_links(spark):
    html = lambda *tags: "<html><head>" + "".join(tags) + "</head></html>"
    canonical, refresh = '<link rel="canonical" href="{}">', "<META http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://alias.net/a", html(canonical.format("http://www.example.org/es/1"))),
        (2, "http://far.net/b", html(refresh.format("http://alias.net/a"))),
        (3, "http://mixed.net/c", html(canonical.format("http://x.com/de/1"), refresh.format("http://x.com/fr/1"))),
        (4, "http://alone.net/d", "<p>no canonical link</p>"),
        (5, "http://z.com/fr/e", html(canonical.format("http://z.com/de/e"))),
        (6, "http://listed.net/f", None),
    ]
    rules_ = urls.rule_table(spark, [("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/")])
    links = spark.createDataFrame([("http://listed.net/f", "http://q.com/de/"), (None, "x"), ("http://listed.net/f", "http://listed.net/f")], "src string, dst string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules_, links).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/fr/", "allow"), 6: (None, "block")}


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        ("https://a.b/x/y.html?q", "/z", "https://a.b/z"),
        ("https://a.b/x/y.html?q", "z?r", "https://a.b/x/z?r"),
        ("https://a.b", "z", "https://a.b/z"),
        ("https://a.b/x/y", "//c.d/e", "https://c.d/e"),
        ("https://a.b/x/y", "?p=2", "https://a.b/x/y?p=2"),
        ("https://a.b/x/y/z", "../../w/./v", "https://a.b/w/v"),
        ("https://a.b/x", "../../../w", "https://a.b/w"),
        ("https://a.b/x", "#top", None),
        ("https://a.b/x", "mailto:z@a.b", None),
        ("https://a.b/x", "HTTP://c.d/E", "HTTP://c.d/E"),
    ],
)
def test_links_resolve_against_their_page(spark, base, link, want):
    assert spark.createDataFrame([(base, link)], "b string, l string").select(urls.resolve(F.col("b"), F.col("l"))).first()[0] == want


def test_aliases_share_a_verdict(spark):
    html = lambda tag: f"<html><!-- <link rel='canonical' href='http://q.com/de/no'> --><script>var s = \"<link rel='canonical' href='http://q.com/de/no'>\"</script>{tag}</html>"
    pages = [
        (1, "http://a.net/x/1", html("<link rel='canonical' href='/moved?a=1&amp;b=2'>")),
        (2, "HTTPS://A.net:443/moved?a=1&b=2#part", html("<meta http-equiv='refresh' content='0; url=http://bad.org/es/1'>")),
        (3, "http://www.a.net/x/1/?utm_source=feed", None),
        (4, "http://other.net/x", html("")),
    ]
    rules_ = urls.rule_table(spark, [("block", "bad.org", "/es/"), ("block", "com", "/de/")])
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules_).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_many_rules_join_by_host(spark, monkeypatch):
    urls_ = spark.createDataFrame([("a.b.example.org", "/es/1"), ("example.org", "/x"), ("xexample.org", "/es/1"), ("org", "")], "host string, path string")
    rules_ = urls.rule_table(spark, [("block", "example.org", "/es/"), ("allow", "org", "/"), ("block", "b.example.org", "/es/"), ("allow", "b.example.org", "/es/")])
    want = {("a.b.example.org", "/es/1", "b.example.org/es/", "allow"), ("example.org", "/x", "org/", "allow"), ("xexample.org", "/es/1", "org/", "allow")}
    assert {tuple(r) for r in urls.match(urls_, rules_).collect()} == want
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert {tuple(r) for r in urls.match(urls_, rules_).collect()} == want


# op6


def test_repeated_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(0, 60))) for _ in range(60)] + ["a " * 200, "a b c d e f g h", "x a b c d e y a b c d e z"]

    def plain(text, width=5):
        w = text.split()
        grams = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        often = Counter(grams)
        return len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(width)})

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r[0]: r[1] for r in df.select("i", rules.repeat_words(F.split(F.trim("text"), " +"))).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


def test_sketches_merge_and_bound_quantiles(spark):
    rng = np.random.default_rng(0)
    values = (rng.lognormal(5, 1, 4000)).astype(int).tolist()
    base = dict.fromkeys(rules.MEASURES, 0)
    df = spark.createDataFrame([("en", "ab"[i % 2], False, v) for i, v in enumerate(values)], "lang string, source string, base_failed boolean, word_centichars long")
    df = df.select("*", *(F.lit(0).alias(m) for m in base if m != "word_centichars"))
    whole = rules.sketch(df)
    halves = rules.sketch(df.where("source = 'a'")).union(rules.sketch(df.where("source = 'b'")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    found = rules.thresholds(whole).where("measure = 'word_centichars' and level = 2").first()
    for name, q in (("q1", 0.25), ("q3", 0.75)):
        exact = np.quantile(values, q, method="inverted_cdf")
        assert exact * 127 / 128 <= found[name] <= exact


def test_limits_come_from_the_groups(spark):
    """Nearly all limits have a spread of their own, and they differ between groups."""
    rows = rules.thresholds(rules.sketch(rules.measure(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))).collect()
    assert sum(r["q3"] - r["q1"] < r["spread"] for r in rows) < 0.1 * len(rows)
    for m in rules.MEASURES:
        assert len({(r["q1"], r["q3"]) for r in rows if r["measure"] == m and r["level"] == 0}) > 5


def test_junk_goes_and_good_text_stays(spark):
    got = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and r["n_words"] >= 10]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_a_group_of_copies_does_not_narrow_the_limits(spark):
    """Half of a group is one text: the others still stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = QUERIES["op6_quality_rules"](spark, "/root/testdata/sf0.01").where("kept").select("doc_id")
    kept = docs.join(own, "doc_id").where("lang = 'en'").withColumn("source", F.lit("s"))
    text = kept.select("text").first()[0]
    copies = spark.range(10_000, 10_000 + 2 * kept.count()).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    out = rules.apply_rules(kept.unionByName(docs.where("lang <> 'en'")).select(docs.columns).unionByName(copies))
    got = out.join(kept.select("doc_id"), "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert got > 0.97


# op7


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    slots = shards.permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert (slots != np.arange(n)).mean() > 0.9
        assert (shards.permute(np.arange(n), n, 8) != slots).mean() > 0.9


def test_shards_hold_every_text_and_resume(spark, docs, texts, tmp_path):
    tokenizer, folder = shards.Tokenizer(vocabulary("byte_bpe_multi_50k.tiktoken")), f"file://{tmp_path}/shards"
    out = shards.write_shards(docs.repartition(3, "doc_id"), tokenizer, folder, sequence=128, shard=50).collect()
    n = len(out)
    assert sorted(r["slot"] for r in out) == list(range(n))
    read = list(shards.read_slots(folder, 0, n, 128, 50))
    assert len(read) == n and all(len(x) == 128 for x in read)
    by_slot = {r["slot"]: r for r in out}
    assert all(zlib.crc32(x.tobytes()) == by_slot[i]["crc"] and by_slot[i]["offset"] == i % 50 * 256 for i, x in enumerate(read))
    assert all((a == b).all() for a, b in zip(read[70:83], shards.read_slots(folder, 70, 13, 128, 50)))
    pieces = {}
    for i, x in enumerate(read):
        r = by_slot[i]
        ends = [*r["starts"][1:], r["n_tokens"]]
        for d, a, b in zip(r["doc_ids"], r["starts"], ends):
            pieces.setdefault(d, []).append(x[a:b])
    encode = tokenizer.load().encode_ordinary
    for d, t in texts.items():
        want = [*encode(t), tokenizer.end]
        assert sum(map(len, pieces[d])) == len(want)
        assert Counter(np.concatenate(pieces[d]).tolist()) == Counter(want)
        if len(pieces[d]) == 1:
            assert pieces[d][0].tolist() == want
    assert sum(r["n_tokens"] for r in out) == sum(len(encode(t)) + 1 for t in texts.values())


# op8


def test_mix(spark, docs):
    rows = mixing.plan(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(x[0]["target"] for x in by.values()) - 1.5 * total) < 1e-6 * total
    names = sorted(by)
    level = max(x[0]["target"] / (3, 1, 2)[i % 3] for i, x in enumerate(by[n] for n in names))
    for i, name in enumerate(names):
        x = by[name]
        size, target = x[0]["source_size"], x[0]["target"]
        assert size == sum(r["size"] for r in x)
        assert target <= 2 * size + 1e-9
        assert abs(target - min(2 * size, level * (3, 1, 2)[i % 3])) < 1e-6 * total
        assert abs(sum(r["taken"] for r in x) - target) <= max(r["size"] for r in x)
        assert all(r["taken"] <= 2 * r["size"] for r in x)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_reading_times_invert_the_schedule(spark, schedule):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(mixing.reading_time(F.col("s"), mixing._segments(schedule))).collect()]
    t = np.linspace(0, 1, 100_001)
    w = np.interp(t, *zip(*schedule))
    area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
    assert np.allclose(np.interp(got, t, area / area[-1]), shares, atol=1e-6)


def test_mixed_documents_come_in_reading_order(spark, docs):
    plan = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    parts = mixing.mixed(docs, partitions=5).select("doc_id", F.spark_partition_id()).collect()
    assert Counter(r[0] for r in parts) == Counter({d: r["copies"] for d, r in plan.items() if r["copies"]})
    for r in parts:
        assert any(min(int(x * 5), 4) == r[1] for x in plan[r[0]]["positions"])


# op9


def test_fingerprints(texts):
    import xxhash

    for t in [*list(texts.values())[:30], "", "A b", "one two three four", "One  two\tthree four FIVE é"]:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(t.encode()) == want


def cluster(seed, n=400):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 8)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)[:n]


# op10


def test_scores(spark, docs, texts):
    import math

    got = {r["doc_id"]: r for r in QUERIES["op10_ppm"](spark, SF).collect()}
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1}
    words = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    counts = Counter(w for d in train for w in words[d])
    total, log = sum(counts.values()), math.log10
    trie = ppm.Trie()
    for d in train:
        trie.learn(texts[d].encode().lower())
    for n, d in enumerate(texts):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (d not in train, len(words[d]), total)
        assert r["n_known"] == sum(w in counts for w in words[d])
        assert abs(r["base_score"] - sum(log((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words[d])) < 1e-6
        if n < 12:
            assert abs(r["score"] - trie.score(texts[d].encode().lower(), learn=False)) < 1e-3


def test_rare_words_join_exactly(spark, docs):
    a, b = ({r["doc_id"]: r for r in ppm.score(docs, docs.where("doc_id % 2 = 0"), head_terms=k).collect()} for k in (10_000, 20))
    assert all(abs(a[d]["base_score"] - b[d]["base_score"]) < 1e-6 and a[d]["n_known"] == b[d]["n_known"] for d in a)


def model_of(texts, trie=None):
    """A model of all contexts of some texts, or of those that a trie has."""
    code, n = np.unique(np.concatenate([c for c, _ in ppm.windows(texts)]), return_counts=True)
    levels = []
    for k in range(ppm.ORDER + 1):
        low, where = np.unique(code & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        count = np.bincount(where, n)
        kept = np.array([trie is None or int(c >> 8).to_bytes(k, "big") in trie.counts for c in low])
        levels.append((low[kept], count[kept]))
    return ppm.build(levels)


ODD = [b"", b"abracadabra " * 9, bytes(range(255)), b"\x00\xfe", "ünï ☃ text".encode(), b"never seen before: zq"]


def test_model_is_the_trie(texts):
    train = [t.encode().lower() for t in list(texts.values())[:12]]
    trie = ppm.Trie()
    for t in train:
        trie.learn(t)
    some = train[:2] + ODD
    want = [trie.score(t, learn=False) for t in some]
    assert np.allclose(model_of(train).score(some), want, atol=1e-3)
    # the rarest contexts gone, as under the bound
    for c in [c for c, seen in trie.counts.items() if len(c) >= 2 and sum(seen.values()) < 5]:
        del trie.counts[c]
    want = [trie.score(t, learn=False) for t in some]
    assert np.allclose(model_of(train, trie).score(some), want, atol=1e-3)


def test_probabilities_sum_to_one():
    m = model_of([b"abracadabra " * 9, b"abacus"])
    for context in (b"abra", b"zzzz", b"\xff\xff\xff\xff", b"zzza", b"cadb"):
        code = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert abs((10.0 ** m.log10(code)).sum() - 1) < 1e-4


def test_windows_of_any_size_give_the_same():
    m = model_of([b"abracadabra " * 9])
    whole = m.score(ODD)
    for size in (1, 7, 64):
        total = np.zeros(len(ODD))
        for code, owner in ppm.windows(ODD, size):
            total += np.bincount(owner, m.log10(code), len(ODD))
        assert np.allclose(total, whole, atol=1e-6)


def test_trie_bound(spark, docs):
    for bound in (0, 3000, 10**6):
        m = ppm.train_model(docs, bound)
        held = m.pairs.keys[m.pairs.keys >= 0]
        assert ((held >> 48) >= 2).sum() <= bound and ((held >> 48) == 1).sum() > 100
        assert np.isfinite(m.score(ODD)).all()
    assert ((held >> 48) == 4).sum() > 10_000


def test_hash_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 50, 5000))
    t = ppm.Table(keys[::2], [np.arange(2500, dtype=float)])
    at = t.find(keys)
    assert (t.columns[0][at[::2]] == np.arange(len(at[::2]))).all() and (at[1::2] == -1).all()


def test_adaptive(spark):
    got = {r["doc_id"]: r["score"] for r in ppm.adaptive(spark.createDataFrame([(1, "abababababababab"), (2, "qwertzuiopasdfgh"), (3, None)], "doc_id long, text string")).collect()}
    assert got[1] > got[2] and got[3] < 0


def test_windows_have_consecutive_slots(spark, docs, texts, tmp_path):
    """Slots follow the windows in order, and are permuted inside them."""
    tokenizer, folder = shards.Tokenizer(vocabulary("byte_bpe_multi_50k.tiktoken")), f"{tmp_path}/shards"
    window = F.format_string("w%02d", F.col("doc_id") % 7)
    out = sorted(shards.write_shards(docs.repartition(3, "doc_id").sortWithinPartitions(window), tokenizer, folder, sequence=64, shard=50, window=window).collect())
    of = [{d % 7 for d in r["doc_ids"]} for r in out]
    assert [r["slot"] for r in out] == list(range(len(out))) and all(len(x) == 1 for x in of)
    order = [x.pop() for x in of]
    assert order == sorted(order) and len(set(order)) == 7
    first = [r["doc_ids"][0] for r, w in zip(out, order) if w == 0]
    assert first != sorted(first)
    assert len(list(shards.read_slots(folder, 0, len(out), 64, 50))) == len(out)


@pytest.mark.parametrize("same_text", [False, True])
def test_no_copy_is_lost_where_rows_share_an_id(spark, same_text):
    rows = [(i // 3 if i % 2 else None, "one two three four" if same_text else f"text {i} of many words " * (1 + i % 4), f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df)
    want = {(r[0], r[1]): r[2] for r in plan.groupBy("doc_id", "text_hash").agg(F.sum("copies")).collect() if r[2]}
    got = mixing.mixed(df, partitions=3).groupBy("doc_id", F.xxhash64("text")).count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == want


def test_texts_that_share_an_id_are_told_apart(spark):
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, words), (1, other), (2, words), (3, other + " more"), (1, words), (4, "alone in the world of texts"), (None, words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.length("text"))
    assert sorted((r[0], r[1]) for r in simhash.representatives(df).where("doc_id is not null").collect()) == sorted([(1, words), (1, other), (4, rows[5][1])])
    bench = spark.createDataFrame([(9, words)], "item_id long, text string")
    assert sorted((r[0], r[1]) for r in decontam.keep_clean(df, bench).where("doc_id is not null").collect()) == sorted([(1, other), (3, rows[3][1]), (4, rows[5][1])])


@pytest.mark.parametrize(("text", "found"), [("Yes, he said so, and yes again.", False), ("Yes!", True), ("yes", True), ("Yes no", False)])
def test_an_item_of_one_word_must_be_all_of_a_text(spark, text, found):
    got = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, "Yes")], "item_id long, text string")).collect()
    assert bool(got) == found


def test_slots_are_compared_over_the_whole_item(spark):
    item = "and when Tom came then Tom saw that Tom was out so Tom left and after this Tom sat while Tom thought that Tom was not so well"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    halves = item.split(" and after ")
    texts = [f"{halves[0].replace('Tom', a)} and very soon after {halves[1].replace('Tom', b)}" for a, b in (("Ann", "Bob"), ("Ann", "Ann"))]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert [r["doc_id"] for r in got] == [1] and not got[0]["verbatim"]


def test_nouns_of_german_texts_are_no_names(spark):
    got = spark.createDataFrame([("Und dann sah der Hund die Katze mit dem Ball im Garten und der Mann rief.",), ("And then Tom saw the cat of Ann in the garden.",)], "t string").select(decontam.template_words(F.col("t"))).collect()
    assert "hund" in got[0][0] and decontam.NAME not in got[0][0]
    assert got[1][0].count(decontam.NAME) == 2
