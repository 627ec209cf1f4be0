"""The pipeline's stages: columns, decisions, and what each keeps."""

import random

import corpus_pipeline
from llm_words import WORDS, prose
from pyspark.sql import functions as F

from loomlog.llm import common, decontaminate, near_dedup, quality


def test_stages_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    model = quality.train(docs, common.table(spark, d, "labels"))
    scores = {r.doc_id: r[1] for r in quality.scored(docs.select("doc_id", "text"), model).select("doc_id", quality.SCORE).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after = stage(spark, docs, d)
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(before)
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        after = common.materialise(after, "stage")
        left = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality":
            assert left == {i for i in before if scores[i] >= 0.3}
        elif name == "exact_dedup":
            low = lambda t: t.encode().lower()
            top = {}
            for i, t in before.items():
                top[low(t)] = max(i, top.get(low(t), -1))
            assert left == set(top.values())
        elif name == "near_dedup":
            classes = {r.doc_id: r.class_id for r in near_dedup.links(near_dedup._rows(docs)).collect()}
            assert left == set(classes.values())
        else:
            rows = common.with_row_id(docs, "rid").select("rid", "doc_id", "text")
            bad = decontaminate.contaminated(rows.select("rid", "text"), common.table(spark, d, "benchmark")).join(rows, "rid")
            assert left == set(before) - {r.doc_id for r in bad.collect()}
        docs = after


def test_pipeline_on_odd_rows(spark, tmp_path, odd, clashing):
    rng = random.Random(1)
    d = f"file://{tmp_path}/sf"
    base = prose(rng, 120)
    near = base.replace(base.split()[60], WORDS[3], 1)
    item = prose(rng, 30)
    extra = [(100, base), (101, base.lower()), (102, near), (103, f"{prose(rng, 50)} {item} {prose(rng, 50)}"), (104, prose(rng, 80))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], odd.schema)
    more = [c for c in clashing.columns if c not in odd.columns]
    clashing.unionByName(rows.withColumns({c: F.lit(7) for c in more})).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = common.table(spark, d, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, d), "odd")
        assert set(docs.columns) == set(clashing.columns)
    left = {r.doc_id for r in docs.collect()}
    assert 104 in left and 103 not in left and len(left & {100, 101, 102}) == 1
    pieces = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left


def test_pipeline_on_an_empty_table(spark, tmp_path, empty):
    d = f"file://{tmp_path}/sf"
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
