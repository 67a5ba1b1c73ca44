import math

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from basketlab.operators import ranking

SCORES = [0.1, 0.9, 0.5, 0.7]


def run(spark, true, k=2, order=ranking.BEST_FIRST):
    truth = spark.createDataFrame([(1, i) for i in true], "user_id long, item long")
    scores = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate(SCORES)], "user_id long, item long, score double"
    )
    r = ranking.metrics(truth, scores, k, order).first()
    return r.precision_at_k, r.recall_at_k, r.ndcg_at_k, r.map_at_k, r.hit_rate_at_k


@pytest.mark.parametrize("order", [ranking.BEST_FIRST, ranking.WORST_FIRST])
def test_all_relevant(spark, order):
    assert run(spark, [1, 3], order=order) == pytest.approx((1, 1, 1, 1, 1))


def test_order_matters_with_one_relevant(spark):
    assert run(spark, [1]) == pytest.approx((0.5, 1, 1, 1, 1))
    worst = run(spark, [1], order=ranking.WORST_FIRST)
    assert worst == pytest.approx((0.5, 1, 1 / math.log2(3), 0.5, 1))


def test_user_without_hits_and_no_users(spark):
    assert run(spark, [0]) == (0, 0, 0, 0, 0)
    empty = spark.createDataFrame([], "user_id long, item long")
    scores = spark.createDataFrame([], "user_id long, item long, score double")
    got = ranking.metrics(empty, scores).first()
    assert got.n_users == 0 and got.precision_at_k == 0.0


def test_against_ml_evaluator(spark, ws):
    counts = ws.aisle_counts.withColumnRenamed("value", "score")
    truth = ws.user_lines.where("order_id % 3 = 0").select("user_id", F.col("aisle_id").alias("item"))
    ours = ranking.metrics(truth, counts, 5).first()
    lists = (
        ranking.top_per_group(counts, ["user_id"], [F.desc("score"), F.asc("item")], 5)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item").cast("double").alias("item"))))["item"].alias("prediction"))
    )
    labels = truth.distinct().groupBy("user_id").agg(F.collect_list(F.col("item").cast("double")).alias("label"))
    joined = labels.join(lists, "user_id")
    for ml, mine in (("precisionAtK", ours.precision_at_k), ("recallAtK", ours.recall_at_k),
                     ("ndcgAtK", ours.ndcg_at_k), ("meanAveragePrecisionAtK", ours.map_at_k)):
        theirs = RankingEvaluator(metricName=ml, k=5).evaluate(joined)
        assert mine == pytest.approx(theirs), ml
