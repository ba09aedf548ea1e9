"""Benchmark items dense in numbers and names."""

import pytest

from palimpsest.llm import decontam

ITEM = "Compute the sum of these numbers: 3 5 7 9 11 13 15 17 19 21 23 25"
OTHER = "Compute the sum of these numbers: 4 6 8 2 12 14 16 18 1 22 24 26"


@pytest.mark.parametrize(
    ("text", "found", "verbatim"),
    [
        (f"See this. {ITEM} and so on", True, True),
        (ITEM.split(": ")[1] + " are odd", True, True),  # two thirds of its words, all of them numbers
        (OTHER, True, False),
        (OTHER.replace("26", "4"), False, None),  # two numbers become one
        (OTHER.split(": ")[1], False, None),  # other numbers say nothing
    ],
)
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_items_of_numbers(spark, monkeypatch, text, found, verbatim, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", broadcast)
    docs = spark.createDataFrame([(1, text), (None, ITEM), (3, "nothing of it 1 2 3 4 5 6")], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["verbatim"]) for r in got] == ([(1, verbatim)] if found else [])


NAMES = "So Tom paid Ann and then Sue met Bob and Eve with a dog in Leeds before Max sold it to Liz in York"


def test_copies_in_other_letter_case(spark):
    texts = [NAMES.lower(), NAMES.upper(), NAMES.title(), NAMES.lower().replace("tom", "max").replace("and", "or")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(7, NAMES)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["verbatim"]) for r in got) == [(0, True), (1, True), (2, True)]
