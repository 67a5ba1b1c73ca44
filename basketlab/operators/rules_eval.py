"""Holdout evaluation of rules without pairing every rule with every order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.columns import contains_all, ratio
from basketlab.session import cut

_ALL = "_all"
# Item sets sent to the tasks at once, as one prefix tree; more sets take more passes.
TREE_SETS = 100_000
# Rules over more items than this are counted one by one: the subsets of their items are too many.
LONGEST = 12
RULE_KEY = ["antecedents", "consequents"]


def match_rules(sets: DataFrame, rules: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``sets`` (with an ``items`` array) joined to the rules whose antecedents they hold.

    The join key is one item, the rarest antecedent of the rule, so only rules that can match
    are ever looked at; the full containment test follows inside the same stage.
    """
    keyed = sets.withColumn("anchor", F.explode("items"))
    return (
        keyed.join(rules, [*(on or []), "anchor"])
        .where(contains_all(F.col("items"), F.col("antecedents")))
        .drop("anchor")
    )


def rule_counts(rules: DataFrame, baskets: DataFrame, group_col: str | None = None) -> DataFrame:
    """Each rule with matched (orders holding all antecedents), both (of these, orders holding
    any consequent), hit (orders holding any consequent) and n_orders.

    Orders are counted per distinct item set, never per rule: "any of C" is the alternating sum of
    "all of S" over the subsets S of C, and "all of A and any of C" that of "all of A and S".
    """
    g = group_col or _ALL
    if group_col is None:
        rules = rules.withColumn(_ALL, F.lit(0))
        baskets = baskets.withColumn(_ALL, F.lit(0))
    arrays = _order_arrays(rules, baskets, g)
    size = F.size(F.array_union(*RULE_KEY))
    sides = rules.select(g, *RULE_KEY)
    parts = [_tree_counts(sides.where(size <= LONGEST), arrays, g)]
    if (rules.select(F.max(size)).first()[0] or 0) > LONGEST:
        parts.append(_direct_counts(rules.where(size > LONGEST), arrays, g))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    zero = F.lit(0).cast("long")
    out = rules.join(counts, [g, *RULE_KEY], "left")
    orders = baskets.select(g, "order_id").distinct()
    if group_col is None:
        out = out.withColumn("n_orders", orders.agg(F.count(F.lit(1))).scalar())
    else:
        totals = orders.groupBy(g).agg(F.count(F.lit(1)).alias("n_orders"))
        out = out.join(totals, g, "left")
    measures = ("matched", "both", "hit", "n_orders")
    return out.withColumns({c: F.coalesce(c, zero) for c in measures}).drop(_ALL)


def _order_arrays(rules: DataFrame, baskets: DataFrame, g: str) -> DataFrame:
    """(group, order_id, items): the items of each order that some rule mentions."""
    used = rules.select(g, F.explode(F.array_union(*RULE_KEY)).alias("item")).distinct()
    return (
        baskets.join(used, [g, "item"], "left_semi")
        .groupBy(g, "order_id")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _subsets(items: Column) -> Column:
    """All subsets that are not empty, each in the order of ``items``."""
    last = F.pow(F.lit(2.0), F.size(items)).cast("long") - 1
    picks = lambda mask: F.filter(
        items, lambda x, i: mask.bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0
    )
    return F.when(last > 0, F.transform(F.sequence(F.lit(1).cast("long"), last), picks))


def set_counts(sets: DataFrame, arrays: DataFrame, g: str, weight: str | None = None) -> DataFrame:
    """(group, items, n): orders of the group that hold all items of each set; only sets some order holds.

    ``weight``: the column of ``arrays`` with the number of orders a row stands for.

    The sets form a prefix tree per group over sorted items. Each order walks it once: a node is
    reached when the order holds its path, so one step counts a set for every set that begins with it.
    A tree of ``TREE_SETS`` sets is sent to the tasks; counts, not matches, are shuffled.
    """
    sets = cut(sets.withColumn("_set", F.monotonically_increasing_id()))
    passes = max(1, -(-sets.count() // TREE_SETS))
    context = sets.sparkSession.sparkContext
    found = None
    for k in range(passes):
        part = sets.where(F.pmod("_set", F.lit(passes)) == k).toArrow()
        sent = context.broadcast(list(zip(*(part[c].to_pylist() for c in (g, "items", "_set")))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trees: dict = {}
            for key, items, number in sent.value:
                node = trees.setdefault(key, [None, {}])
                for item in items:
                    node = node[1].setdefault(item, [None, {}])
                node[0] = number
            counts: dict[int, int] = {}

            def walk(children: dict, items: list, times: int) -> None:
                for at, item in enumerate(items, 1):
                    node = children.get(item)
                    if node:
                        if node[0] is not None:
                            counts[node[0]] = counts.get(node[0], 0) + times
                        if node[1]:
                            walk(node[1], items[at:], times)

            for batch in batches:
                times = batch[weight].to_pylist() if weight else repeat(1)
                for key, items, n in zip(batch[g].to_pylist(), batch["items"].to_pylist(), times):
                    if key in trees:
                        walk(trees[key][1], items, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["_set", "n"]
            )

        rows = arrays.select(g, "items", *([weight] if weight else []))
        counted = rows.mapInArrow(run, "_set long, n long").groupBy("_set").agg(F.sum("n").alias("n"))
        found = counted if found is None else found.unionAll(counted)
    return sets.join(found, "_set").select(g, "items", "n")


def _tree_counts(sides: DataFrame, arrays: DataFrame, g: str) -> DataFrame:
    both = F.array_sort(F.array_union(*RULE_KEY))
    unions = sides.select(g, both.alias("all")).distinct()
    sets = unions.select(g, F.explode(_subsets(F.col("all"))).alias("items")).distinct()
    n = cut(set_counts(sets, arrays, g))

    def alternating(rows: DataFrame, keys: list[str], joined: Column, name: str) -> DataFrame:
        """Orders that hold some item of the consequents, and ``joined`` with it."""
        terms = rows.select(g, *keys, F.explode(_subsets(F.array_distinct("consequents"))).alias("s"))
        terms = terms.select(g, *keys, F.pmod(F.size("s"), F.lit(2)).alias("odd"), F.array_sort(joined).alias("items"))
        sign = F.when(F.col("odd") == 1, F.col("n")).otherwise(-F.col("n"))
        return terms.join(n, [g, "items"]).groupBy(g, *keys).agg(F.sum(sign).alias(name))

    pairs = alternating(sides.distinct(), RULE_KEY, F.array_union("antecedents", "s"), "both")
    hits = alternating(sides.select(g, "consequents").distinct(), ["consequents"], F.col("s"), "hit")
    fronts = n.select(g, F.col("items").alias("_front"), F.col("n").alias("matched"))
    front = F.array_sort(F.array_distinct("antecedents"))
    return (
        sides.distinct()
        .withColumn("_front", front)
        .join(fronts, [g, "_front"], "left")
        .join(hits, [g, "consequents"], "left")
        .join(pairs, [g, *RULE_KEY], "left")
        .select(g, *RULE_KEY, "matched", "both", "hit")
    )


def _direct_counts(rules: DataFrame, arrays: DataFrame, g: str) -> DataFrame:
    # One (item -> rule) table for both questions: the anchor asks "are all antecedents here?",
    # each consequent asks "is any consequent here?", counted at the smallest one present.
    sides = rules.select(g, *RULE_KEY, "anchor")
    roles = sides.select(g, *RULE_KEY, F.col("anchor").alias("item"), F.lit(True).alias("is_anchor")).unionByName(
        sides.select(g, *RULE_KEY, F.explode("consequents").alias("item"), F.lit(False).alias("is_anchor"))
    )
    items, cons = F.col("items"), F.col("consequents")
    matched = F.col("is_anchor") & contains_all(items, F.col("antecedents"))
    first = F.array_min(F.array_intersect(cons, items)) == F.col("item")
    return (
        arrays.withColumn("item", F.explode("items"))
        .join(roles, [g, "item"])
        .groupBy(g, *RULE_KEY)
        .agg(
            F.count(F.when(matched, 1)).alias("matched"),
            F.count(F.when(matched & F.arrays_overlap(cons, items), 1)).alias("both"),
            F.count(F.when(~F.col("is_anchor") & first, 1)).alias("hit"),
        )
    )


def _cells() -> dict[str, Column]:
    matched, both, hit, n = (F.col(c) for c in ("matched", "both", "hit", "n_orders"))
    return {
        "true_positives": both,
        "false_positives": matched - both,
        "false_negatives": hit - both,
        "true_negatives": n - matched - hit + both,
    }


def confusion(counts: DataFrame, group_col: str | None = None) -> DataFrame:
    """TP / FP / FN / TN over all (rule, order) pairs."""
    keys = [group_col] if group_col else []
    return counts.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in _cells().items()]
    )


def classification(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """accuracy, precision, recall and F1; null when nothing was predicted at all."""
    total = tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    measures = {
        "accuracy": ratio(tp + tn, total),
        "precision": precision,
        "recall": recall,
        "f1_score": f1,
    }
    return [F.when(total > 0, m).alias(n) for n, m in measures.items()]


def metrics(counts: DataFrame, group_col: str | None = None) -> DataFrame:
    """Confusion cells, their ratios, number of rules and mean confidence / lift / support."""
    keys = [group_col] if group_col else []
    cells = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in _cells().items()]
    summed = counts.groupBy(*keys).agg(
        *cells,
        F.count(F.lit(1)).alias("total_rules"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("lift").alias("avg_lift"),
        F.avg("support").alias("avg_support"),
    )
    tp, fp, fn, tn = (F.col(c) for c in _cells())
    return summed.select("*", *classification(tp, fp, fn, tn))


def rmse(counts: DataFrame, group_col: str | None = None) -> DataFrame:
    """Squared gap between confidence and the share seen, summed over rules, over all matches."""
    keys = [group_col] if group_col else []
    seen = F.try_divide(F.col("both").cast("double"), F.col("matched").cast("double"))
    summed = counts.groupBy(*keys).agg(
        F.sum(F.pow(F.col("confidence") - seen, 2)).alias("_error"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched_orders"),
    )
    mse = F.try_divide(F.col("_error"), F.col("matched_orders").cast("double"))
    return summed.select(*keys, "matched_orders", mse.alias("mse"), F.sqrt(mse).alias("rmse"))
