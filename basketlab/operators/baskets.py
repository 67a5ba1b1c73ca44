"""Baskets, frequent itemsets and association rules, overall or per segment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.functions.columns import is_train
from basketlab.functions.topk import top_per_group
from basketlab.operators.rules_eval import set_counts
from basketlab.session import cut

# Weights of the combined score of a rule.
CONFIDENCE_WEIGHT = 0.7
LIFT_WEIGHT = 0.3

_ALL = "_all"


def user_lines(
    lines: DataFrame, orders: DataFrame, products: DataFrame, *order_cols: str
) -> DataFrame:
    """Each order line with its user and product attributes (and ``order_cols`` of its order).

    Joins carry no broadcast hints: Spark broadcasts products only when their measured size
    allows it and splits skewed partitions otherwise.
    """
    return (
        lines.select("order_id", "product_id")
        .join(orders.select("order_id", "user_id", *order_cols), "order_id")
        .join(products, "product_id")
    )


def baskets(user_lines: DataFrame, item_col: str) -> DataFrame:
    """Distinct (order_id, item)."""
    return user_lines.select("order_id", F.col(item_col).alias("item")).distinct()


def cluster_baskets(
    user_lines: DataFrame, user_clusters: DataFrame, item_col: str, top_n: int | None = 1500
) -> DataFrame:
    """Distinct (cluster, order_id, item), only the ``top_n`` items in most baskets per cluster."""
    rows = (
        user_lines.join(user_clusters.select("user_id", "cluster"), "user_id")
        .select("cluster", "order_id", F.col(item_col).alias("item"))
        .distinct()
    )
    if top_n is None:
        return rows
    counts = rows.groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("item")]
    top = top_per_group(counts, ["cluster"], order, top_n)
    return rows.join(top.select("cluster", "item"), ["cluster", "item"], "left_semi").select(
        "cluster", "order_id", "item"
    )


def basket_arrays(baskets: DataFrame, *group: str) -> DataFrame:
    """One sorted array per order. Keep items to a bounded set (a dimension, the top N or the
    frequent items) before calling this."""
    return baskets.groupBy(*group, "order_id").agg(F.sort_array(F.collect_set("item")).alias("items"))


@dataclass(frozen=True)
class RuleModel:
    itemsets: DataFrame
    rules: DataFrame
    test: DataFrame


def _grouped(df: DataFrame, group_col: str | None) -> tuple[DataFrame, str]:
    if group_col is None:
        return df.withColumn(_ALL, F.lit(0)), _ALL
    return df, group_col


def _no_itemsets(rows: DataFrame, g: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (
        rows.limit(0)
        .select(
            g, F.array("item").alias("items"), zero.alias("freq"), zero.alias("n_baskets"),
            F.lit(0.0).alias("support"), F.col("item").alias("anchor"),
        )
        .drop(_ALL)
    )


def frequent_itemsets(
    baskets: DataFrame, min_support: float, group_col: str | None = None, min_count: int = 1
) -> DataFrame:
    """Itemsets of any length with freq / number of baskets >= ``min_support`` and freq >= ``min_count``.

    Columns: items (sorted), freq, n_baskets, support, anchor (the rarest member), and the
    group column. Items that are not frequent alone are left out before arrays are built, so
    an array never exceeds the number of frequent items (at most mean basket size /
    min_support). Orders with the same array are counted as one row. Sets grow by one item a
    pass, all groups together: a set is counted when all its parts are frequent.
    """
    rows, g = _grouped(baskets, group_col)
    sizes = rows.select(g, "order_id").distinct().groupBy(g).agg(F.count(F.lit(1)).alias("n"))
    totals = {r[g]: r["n"] for r in sizes.collect()}  # one row per group
    if not totals:
        return _no_itemsets(rows, g)
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col(g)]
    singles = (
        rows.groupBy(g, "item")
        .agg(F.count(F.lit(1)).alias("freq"))
        .where((F.col("freq") / total >= min_support) & (F.col("freq") >= min_count))
    )
    kept = rows.join(singles.select(g, "item"), [g, "item"], "left_semi")
    arrays = cut(basket_arrays(kept, g).groupBy(g, "items").agg(F.count(F.lit(1)).alias("times")))

    def frequent(counts: DataFrame) -> DataFrame:
        found = counts.select(g, "items", F.col("n").alias("freq"), total.cast("long").alias("n_baskets"))
        found = found.withColumn("support", F.col("freq") / F.col("n_baskets"))
        return cut(found.where((F.col("support") >= min_support) & (F.col("freq") >= min_count)))

    parts = [frequent(_counts_up_to_two(arrays, 1, g))]
    while not parts[-1].isEmpty():
        size = len(parts) + 1
        if size == 2:
            counts = _counts_up_to_two(arrays, 2, g)
        else:
            counts = set_counts(_grown(parts[-1], size, g), arrays.where(F.size("items") >= size), g, "times")
        parts.append(frequent(counts))
    found = reduce(DataFrame.unionByName, parts[:-1] or parts)
    alone = found.where(F.size("items") == 1).select(
        g, F.col("items")[0].alias("item"), F.col("freq").alias("_f")
    )
    rarest = (
        found.select(g, "items", F.explode("items").alias("item"))
        .join(alone, [g, "item"])
        .groupBy(g, "items")
        .agg(F.min(F.struct("_f", "item")).getField("item").alias("anchor"))
    )
    return found.join(rarest, [g, "items"]).drop(_ALL)


def _counts_up_to_two(arrays: DataFrame, size: int, g: str) -> DataFrame:
    """(group, items, n) of all sets of one item, or of two, that some order holds."""
    items = F.col("items")
    sets = F.transform(items, lambda x: F.array(x))
    if size == 2:
        later = lambda i: F.slice(items, i + 2, F.size(items))
        sets = F.flatten(F.transform(items, lambda x, i: F.transform(later(i), lambda y: F.array(x, y))))
    return arrays.select(g, F.explode(sets).alias("items"), "times").groupBy(g, "items").agg(F.sum("times").alias("n"))


def _grown(last: DataFrame, size: int, g: str) -> DataFrame:
    """(group, items): sets of ``size`` sorted items all of whose parts of one item less are in ``last``."""
    keyed = last.select(
        g, F.slice("items", 1, size - 2).alias("front"), F.element_at("items", -1).alias("end"), "items"
    )
    other = keyed.select(g, "front", F.col("end").alias("next"))
    grown = (
        keyed.join(other, [g, "front"])
        .where(F.col("end") < F.col("next"))
        .select(g, F.concat("items", F.array("next")).alias("items"))
    )
    # Without their last or their last but one item they are in ``last`` by the join.
    without = F.explode(F.sequence(F.lit(0), F.lit(size - 3))).alias("gone")
    part = F.filter("items", lambda x, i: i != F.col("gone"))
    known = last.select(g, F.col("items").alias("part"))
    return (
        grown.select(g, "items", without)
        .select(g, "items", part.alias("part"))
        .join(known, [g, "part"])
        .groupBy(g, "items")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == size - 2)
        .select(g, "items")
    )


def rules_of(itemsets: DataFrame, min_lift: float, group_col: str | None = None) -> DataFrame:
    """Every split of every itemset into antecedents -> consequents with lift >= ``min_lift``.

    A split is a bit mask over the sorted itemset. Both sides are frequent themselves, so
    their supports come from two equi-joins on the item array.
    """
    sets, g = _grouped(itemsets, group_col)
    many = sets.where(F.size("items") > 1)
    last = F.pow(F.lit(2.0), F.size("items")).cast("long") - 2
    split = many.select(
        g, "items", "support", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("mask")
    )

    def side(bit: int):
        return F.filter(
            "items",
            lambda x, i: (F.col("mask").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0)
            == F.lit(bool(bit)),
        )

    split = split.select(g, side(1).alias("antecedents"), side(0).alias("consequents"), "support")
    left = sets.select(
        g,
        F.col("items").alias("antecedents"),
        F.col("support").alias("antecedent_support"),
        "anchor",
    )
    right = sets.select(
        g, F.col("items").alias("consequents"), F.col("support").alias("consequent_support")
    )
    confidence = F.col("support") / F.col("antecedent_support")
    sides = F.col("antecedent_support") * F.col("consequent_support")
    score = F.col("confidence") * CONFIDENCE_WEIGHT + F.col("lift") * LIFT_WEIGHT
    return (
        split.join(left, [g, "antecedents"])
        .join(right, [g, "consequents"])
        .withColumn("confidence", confidence)
        .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
        .where(F.col("lift") >= min_lift)
        .withColumn("leverage", F.col("support") - sides)
        .withColumn(
            "conviction",
            F.when(
                F.col("confidence") < 1,
                (1 - F.col("consequent_support")) / (1 - F.col("confidence")),
            ),
        )
        .withColumn("combined_score", score)
        .drop(_ALL)
    )


def fit_rules(
    baskets: DataFrame,
    min_support: float = 0.1,
    min_lift: float = 1.2,
    test_size: float = 0.2,
    seed: int = 42,
    group_col: str | None = None,
    min_count: int = 1,
) -> RuleModel:
    """Hold out a share of the orders, mine the rest, derive rules.

    The baskets are the result of the one large join, so they are written once and reused.
    """
    baskets = cut(baskets)
    mask = is_train("order_id", test_size, seed)
    itemsets = cut(frequent_itemsets(baskets.where(mask), min_support, group_col, min_count))
    rules = cut(rules_of(itemsets, min_lift, group_col))
    return RuleModel(itemsets, rules, baskets.where(~mask))
