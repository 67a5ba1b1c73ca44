import numpy as np
from pyspark.sql import functions as F

from basketlab.llm import quality
from basketlab.llm.queries import QUERIES, held_out


def test_risk_separates_without_negative_labels():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1, 0.5, (3000, 4)), rng.normal(-1, 0.5, (600, 4))
    model = quality.fit_positive_unlabelled(good[:1500], np.concatenate([good[1500:], bad]), 0.7, steps=300)
    assert (model.score(good) >= 0.5).mean() > 0.97 and (model.score(bad) >= 0.5).mean() < 0.03


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op6_quality_scores"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_labels_of_held_out_rows_do_not_count(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, x, may_train=~held_out(F.col("__id"))) for x in (labels, flipped))
    assert all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights))


def test_edges(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = docs_of([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 100000)])
    assert quality.fit(rows, none) is None
    scored = quality.score(rows, None).collect()
    assert [r.score for r in scored] == [0.5] * 5 and [r.predicted for r in scored] == [1] * 5
    labels = spark.createDataFrame([(3, 1, 0), (1, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(rows, labels)
    got = quality.score(rows, model)
    assert got.columns == [*rows.columns, "score", "predicted"]
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality.score(docs_of([]), model).count() == 0
