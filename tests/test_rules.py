import random
from itertools import combinations

import pytest
from helpers import values

from basketlab.operators import baskets, rules_eval

LONG = "order_id long, item string"


def long_rows(spark, *texts):
    return spark.createDataFrame([(i, x) for i, t in enumerate(texts) for x in t], LONG)


def brute_itemsets(texts, min_support):
    items = sorted(set("".join(texts)))
    out = {}
    for size in range(1, len(items) + 1):
        for combo in combinations(items, size):
            freq = sum(set(combo) <= set(t) for t in texts)
            if freq and freq / len(texts) >= min_support:
                out[combo] = freq
    return out


def test_multi_item_consequents(spark):
    found = baskets.frequent_itemsets(long_rows(spark, "abc", "ab", "ac", "abc"), 0.5)
    sets = {"".join(r["items"]): r.freq for r in found.collect()}
    assert sets == {"a": 4, "b": 3, "c": 3, "ab": 3, "ac": 3, "bc": 2, "abc": 2}
    rules = baskets.rules_of(found, 0.0).collect()
    assert len(rules) == 12
    bc_a = next(r for r in rules if r.antecedents == ["b", "c"])
    assert bc_a.consequents == ["a"] and bc_a.confidence == 1.0 and bc_a.conviction is None
    assert all(not set(r.antecedents) & set(r.consequents) for r in rules)


@pytest.mark.parametrize("seed", range(3))
def test_itemsets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(c for c in "abcdef" if rng.random() < 0.5) for _ in range(40)]
    texts = [t for t in texts if t]
    for support in (0.1, 0.3, 7 / len(texts)):
        found = baskets.frequent_itemsets(long_rows(spark, *texts), support).collect()
        assert {tuple(r["items"]): r.freq for r in found} == brute_itemsets(texts, support)


def test_groups_are_mined_separately(spark):
    one, two = long_rows(spark, "ab", "ab", "a"), long_rows(spark, "xy", "x", "y")
    both = one.selectExpr("1 AS cluster", "*").unionByName(two.selectExpr("2 AS cluster", "order_id + 10 AS order_id", "item"))
    found = baskets.frequent_itemsets(both, 0.5, "cluster").collect()
    sets = {(r.cluster, "".join(r["items"])): r.freq for r in found}
    assert sets == {(1, "a"): 3, (1, "b"): 2, (1, "ab"): 2, (2, "x"): 2, (2, "y"): 2}


def test_no_frequent_itemset_gives_empty_tables(spark):
    found = baskets.frequent_itemsets(long_rows(spark, "a", "b", "c"), 0.9)
    assert found.count() == 0 and baskets.rules_of(found, 0.0).count() == 0


RULE = (
    "antecedents array<string>, consequents array<string>, anchor string, confidence double, "
    "lift double, support double"
)


def test_any_consequent_counts_and_error(spark):
    rules = spark.createDataFrame([(["a"], ["b", "c"], "a", 0.5, 1.0, 0.1)], RULE)
    counts = rules_eval.rule_counts(rules, long_rows(spark, "ab", "a", "c", "d"))
    got = rules_eval.metrics(counts).first()
    cells = (got.true_positives, got.false_positives, got.false_negatives, got.true_negatives)
    assert cells == (1, 1, 1, 1) and got.accuracy == 0.5 and got.f1_score == 0.5
    assert rules_eval.rmse(counts).first().mse == 0.0


def test_rule_on_absent_items_and_empty_test_set(spark):
    rules = spark.createDataFrame([(["q"], ["z"], "q", 0.5, 1.0, 0.1)], RULE)
    got = rules_eval.metrics(rules_eval.rule_counts(rules, long_rows(spark, "ab", "a"))).first()
    assert got.true_negatives == 2 and got.accuracy == 1.0 and got.precision == 0.0
    none = spark.createDataFrame([], LONG)
    got = rules_eval.metrics(rules_eval.rule_counts(rules, none)).first()
    assert got.accuracy is None and got.true_negatives == 0
    assert rules_eval.rmse(rules_eval.rule_counts(rules, none)).first().mse is None


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(c for c in "abcde" if rng.random() < 0.5) or "a" for _ in range(60)]
    rows = long_rows(spark, *texts)
    rules = baskets.rules_of(baskets.frequent_itemsets(rows, 0.05), 0.0)
    for r in rules_eval.rule_counts(rules, rows).collect():
        ante, cons = set(r.antecedents), set(r.consequents)
        matched = [t for t in texts if ante <= set(t)]
        hit = [t for t in texts if cons & set(t)]
        assert (r.matched, r.hit, r.n_orders) == (len(matched), len(hit), len(texts))
        assert r.both == sum(bool(cons & set(t)) for t in matched)


def plain_counts(texts, ante, cons):
    matched = [t for t in texts if set(ante) <= set(t)]
    return len(matched), sum(bool(set(cons) & set(t)) for t in matched), sum(bool(set(cons) & set(t)) for t in texts)


def test_many_rules_over_few_sides(spark, monkeypatch):
    """A hundred thousand rules from 320 antecedents and 320 consequents; several trees."""
    rng = random.Random(6)
    letters = "abcdefghijkl"
    texts = ["".join(c for c in letters if rng.random() < 0.4) or "a" for _ in range(200)]
    left = [tuple(c for c in letters[:6] if rng.random() < 0.6) or ("a",) for _ in range(320)]
    right = [tuple(c for c in letters[4:10] if rng.random() < 0.5) or ("h",) for _ in range(320)]
    keys = sorted({(a, c) for a in left for c in right})
    table = spark.createDataFrame([(list(a), list(c), a[0], 0.5, 1.0, 0.1, k) for k, (a, c) in enumerate(keys)], RULE + ", k long")
    table = table.crossJoin(spark.range(-(-100_000 // len(keys))).withColumnRenamed("id", "copy"))
    monkeypatch.setattr(rules_eval, "TREE_SETS", 300)
    got = rules_eval.rule_counts(table, long_rows(spark, *texts)).select("k", "matched", "both", "hit")
    rows = got.groupBy("k", "matched", "both", "hit").count().collect()
    assert sum(r["count"] for r in rows) >= 100_000 and len(rows) == len(keys)
    for r in rng.sample(rows, 400):
        assert (r.matched, r.both, r.hit) == plain_counts(texts, *keys[r.k])


def test_long_rules_and_groups(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnop"
    texts = ["".join(c for c in letters if rng.random() < 0.6) or "a" for _ in range(80)]
    sides = [("ab", letters[2:]), ("abc", "bcd"), ("q", "a"), ("a", "q"), ("ba", "dc")]
    rows = [(c, list(a), list(b), a[0], 0.5, 1.0, 0.1) for c in (1, 2) for a, b in sides]
    table = spark.createDataFrame(rows, "cluster int, " + RULE)
    half = len(texts) // 2
    data = long_rows(spark, *texts).selectExpr(f"IF(order_id < {half}, 1, 2) AS cluster", "*")
    for r in rules_eval.rule_counts(table, data, "cluster").collect():
        own = texts[:half] if r.cluster == 1 else texts[half:]
        want = plain_counts(own, r.antecedents, r.consequents)
        assert (r.matched, r.both, r.hit, r.n_orders) == (*want, len(own))


def test_holdout_is_disjoint_and_whole(ws):
    model = ws.department_rules
    train = model.itemsets.first().n_baskets
    test = model.test.select("order_id").distinct().count()
    whole = ws.user_lines.select("order_id").distinct().count()
    assert train + test == whole and 0.15 < test / whole < 0.25
    assert values(model.rules.where("support > antecedent_support")) == []


def test_groups_are_mined_together_and_equal_orders_once(spark):
    """Sets of any size equal brute force, and more groups take no more jobs."""
    draw = random.Random(8)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    taken = []
    for groups in (2, 16):
        orders = {(g, g * 100 + o): frozenset(draw.sample("abcdef", draw.randrange(1, 6))) for g in range(groups) for o in range(30)}
        rows = spark.createDataFrame([(g, o, x) for (g, o), items in orders.items() for x in items], "cluster int, order_id long, item string")
        begun = jobs()
        found = baskets.frequent_itemsets(rows, 0.2, "cluster")
        got = {(r.cluster, tuple(r["items"])): (r.freq, r.n_baskets) for r in found.collect()}
        taken.append(jobs() - begun)
        want = {}
        for g in range(groups):
            held = [x for (k, _), x in orders.items() if k == g]
            for size in range(1, 7):
                for items in combinations("abcdef", size):
                    n = sum(set(items) <= x for x in held)
                    if n / 30 >= 0.2:
                        want[g, items] = (n, 30)
        assert got == want and max(len(items) for _, items in got) > 2
    assert taken[1] <= taken[0] + 12
