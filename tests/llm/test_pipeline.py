import corpus_pipeline
from palimpsest.llm import decontam, mixing, quality
from tests.llm.test_jaccard import classes


def test_stages_take_effect_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        seen[name] = before, after = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = after
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality"]
    scores = quality.classify(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(after) == ids(scores.where("score >= 0.5")) < ids(before)
    before, after = seen["near-duplicates"]
    want = classes({r["doc_id"]: r["text"] for r in before.collect()})
    assert {d for d, c in want.items() if d == c} <= ids(after) < ids(before)
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == ids(decontam.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet"))) != set()
    before, after = seen["mixing"]
    assert after.count() > before.count() and ids(after) <= ids(before)
    before, after = seen["token output"]
    assert {d for r in after.select("doc_ids").collect() for d in r[0]} == ids(before)
    # slots follow the ranges of reading time that the mix wrote
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = {r["doc_id"]: min(int(r["positions"][0] * n), n - 1) for r in mixing.plan(seen["mixing"][0]).where("copies = 1").collect()}
    order = [times[d] for r in after.orderBy("slot").select("doc_ids").collect() for d in r[0] if d in times]
    assert order == sorted(order) and len(set(order)) > 1


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
