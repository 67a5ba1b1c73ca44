"""Top-k ranking metrics, averaged over users with at least one relevant item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.functions.topk import top_per_group

BEST_FIRST = "best_first"
WORST_FIRST = "worst_first"
MEASURES = ("precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k", "hit_rate_at_k")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def from_hits(
    hits: DataFrame, k: int = 5, order: str = BEST_FIRST, group_col: str | None = None
) -> DataFrame:
    """``hits``: one row per user with ``hits`` (array of 0/1 for the top k, best first) and
    ``n_true``. ``worst_first`` counts positions from the lowest-scored of the top k."""
    seq = F.col("hits") if order == BEST_FIRST else F.reverse(F.col("hits"))
    found = _total(F.transform(F.col("hits"), lambda h: h.cast("double")))
    gain = _total(F.transform(seq, lambda h, i: h / F.log2(i + F.lit(2.0))))
    ideal_length = F.least(F.col("n_true"), F.lit(k)).cast("int")
    ideal = _total(
        F.transform(F.sequence(F.lit(1), ideal_length), lambda p: 1 / F.log2(p + F.lit(1.0)))
    )
    running = _total(
        F.transform(
            seq,
            lambda h, i: h
            * F.aggregate(F.slice(seq, 1, i + 1), F.lit(0.0), lambda a, x: a + x)
            / (i + F.lit(1.0)),
        )
    )
    per_user = {
        "precision_at_k": found / F.lit(float(k)),
        "recall_at_k": found / F.col("n_true"),
        "ndcg_at_k": gain / ideal,
        "map_at_k": running / ideal_length,
        "hit_rate_at_k": F.when(found > 0, 1.0).otherwise(0.0),
    }
    keys = [group_col] if group_col else []
    scored = hits.where(F.col("n_true") > 0).select(
        *keys, *[m.alias(n) for n, m in per_user.items()]
    )
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_users"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEASURES],
    )


def hits_of(
    truth: DataFrame, scores: DataFrame, k: int = 5, group_col: str | None = None
) -> DataFrame:
    """``truth``: (user_id, item). ``scores``: (user_id, item, score), ties to the lower item."""
    keys = [*([group_col] if group_col else []), "user_id"]
    truth = truth.select(*keys, "item").distinct()
    top = top_per_group(scores, keys, [F.desc("score"), F.asc("item")], k)
    marked = top.join(truth.withColumn("_true", F.lit(1)), [*keys, "item"], "left")
    lists = marked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.coalesce("_true", F.lit(0)).alias("hit"))))
        .getField("hit")
        .alias("hits")  # at most k entries
    )
    sizes = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true"))
    empty = F.array().cast("array<int>")
    return sizes.join(lists, keys, "left").withColumn("hits", F.coalesce("hits", empty))


def metrics(
    truth: DataFrame,
    scores: DataFrame,
    k: int = 5,
    order: str = BEST_FIRST,
    group_col: str | None = None,
) -> DataFrame:
    return from_hits(hits_of(truth, scores, k, group_col), k, order, group_col)
