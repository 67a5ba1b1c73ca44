import pytest
from helpers import values

from basketlab.operators import recommend

RULE = (
    "antecedents array<long>, consequents array<long>, anchor long, confidence double, "
    "lift double, support double, combined_score double, cluster int"
)


def rule(spark, *rows):
    return spark.createDataFrame(
        [(list(a), list(c), a[0], conf, lift, 0.1, score, 0) for a, c, conf, lift, score in rows], RULE
    )


def test_best_rule_per_consequent_and_weights(spark):
    rules = rule(
        spark,
        ((1,), (3,), 0.5, 1.0, 3.0),
        ((2,), (3,), 0.9, 2.0, 9.0),
        ((1, 2), (4, 1), 0.2, 1.0, 1.0),
        ((9,), (5,), 0.9, 9.0, 9.0),
    ).drop("cluster")
    arrays = spark.createDataFrame([(7, [1, 2, 4]), (8, [1])], "user_id long, items array<long>")
    clusters = spark.createDataFrame([(7, 2), (8, 4)], "user_id long, cluster int")
    out = recommend.by_rules(arrays, clusters, rules)
    got = {(r.user_id, r["item"]): r for r in out.collect()}
    assert set(got) == {(7, 3), (7, 4), (7, 1), (8, 3)}
    assert got[7, 3].score == pytest.approx(0.9 * 0.3 + 2.0 * 0.8)  # segment 2
    assert got[8, 3].score == pytest.approx(0.5 * 0.5 + 1.0 * 0.5)  # any other segment
    assert not got[7, 3].previously_bought and got[7, 4].previously_bought
    assert [got[7, i]["rank"] for i in (3, 1, 4)] == [1, 2, 3]  # equal scores: lower id first


def test_bought_together_keeps_best_or_last(spark):
    rules = rule(
        spark,
        ((1,), (3,), 0.5, 1.0, 3.0),
        ((1, 2), (3,), 0.9, 2.0, 9.0),
        ((1,), (4,), 0.1, 1.0, 5.0),
    )
    best = recommend.bought_together(rules).where("product = 1")
    assert values(best, "item", "score", "rank") == [(3, 9.0, 1), (4, 5.0, 2)]
    last = recommend.bought_together(rules, keep="last").where("product = 1")
    assert values(last, "item", "score", "rank") == [(3, 3.0, 2), (4, 5.0, 1)]
    asked = spark.createDataFrame([(0, 2)], "cluster int, product long")
    assert values(recommend.bought_together(rules, requests=asked), "product", "item") == [(2, 3)]


def test_blend(spark):
    rules = spark.createDataFrame(
        [(1, 10, 2.0, 0.5, 1.0), (1, 12, 1.0, 0.5, 1.0)],
        "user_id long, aisle_id long, score double, confidence double, lift double",
    )
    svd = spark.createDataFrame(
        [(1, 11, 0.8), (1, 12, 0.5), (1, 12, 0.4)], "user_id long, aisle_id long, score double"
    )
    out = recommend.blend(rules, svd)
    got = {r.aisle_id: (r.combined_score, r.sources) for r in out.collect()}
    assert got == {10: (2.0, ["MBA"]), 11: (0.8, ["SVD"]), 12: (0.75, ["MBA", "SVD"])}


def test_aisle_products_fill_from_lowest_ids(spark):
    products = spark.createDataFrame(
        [(i, f"p{i}", 1) for i in range(8)] + [(20, "q", 2)],
        "product_id long, product_name string, aisle_id long",
    )
    lines = spark.createDataFrame(
        [(1, 1, 6), (1, 1, 6), (1, 1, 0), (2, 1, 7)] + [(3, 1, p) for p in (4, 5, 6, 7)],
        "user_id long, aisle_id long, product_id long",
    )
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 2)], "user_id long, aisle_id long")
    out = recommend.aisle_products(lines, products, asked)
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault((r.user_id, r.aisle_id), []).append((r.product_id, r.score))
    assert got == {
        (1, 1): [(6, 4), (0, 2), (1, 1)],
        (2, 1): [(7, 2), (0, 1), (1, 1)],
        (3, 1): [(4, 2), (5, 2), (6, 2)],
        (3, 2): [(20, 1)],
    }


def test_triggered_rules_need_all_antecedents_and_any_consequent(spark):
    rules = rule(spark, ((1, 2), (3, 4), 0.5, 1.0, 1.0), ((1,), (5,), 0.5, 1.0, 1.0))
    arrays = spark.createDataFrame(
        [(1, 10, [1, 2, 4]), (1, 11, [1, 3]), (1, 12, [1, 2, 3]), (2, 13, [1, 5])],
        "user_id long, order_id long, items array<long>",
    )
    hits = recommend.triggered_rules(arrays, rules)
    assert values(hits, "order_id") == [(10,), (12,), (13,)]
    assert values(recommend.rule_summary(hits)) == [(1, 1), (2, 1)]


def test_user_checks_and_leftovers(spark):
    orders = spark.createDataFrame([(1, 7)], "order_id long, user_id long")
    typed = spark.createDataFrame([("7",), ("999999",), ("abc",)], "typed string")
    got = values(recommend.validate_user_ids(typed, orders), "typed", "status")
    assert got == [("7", "ok"), ("999999", "unknown_user"), ("abc", "not_a_number")]
    aisles = spark.createDataFrame([(1,), (2,), (3,)], "aisle_id long")
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    listed = spark.createDataFrame([(7, 2), (7, 3)], "user_id long, aisle_id long")
    got = values(recommend.other_aisles(users, aisles, listed))
    assert got == [(7, 1), (8, 1), (8, 2), (8, 3)]


def test_names_default_and_fallback_list(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "aisle_id long, aisle string")
    assert values(df.select(recommend.name_or("aisle", "Aisle", "aisle_id"))) == [("Aisle 2",), ("x",)]
    own = spark.createDataFrame([(1, 5)], "user_id long, item long")
    base = spark.createDataFrame([(1, 6), (2, 7)], "user_id long, item long")
    got = values(recommend.cluster_first(own, base))
    assert got == [(1, 5, True), (2, 7, False)]
