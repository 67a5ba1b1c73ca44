"""Cleaning of orders: samples and the two repairs of days_since_prior_order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.functions.position import nth_smallest

DAYS = "days_since_prior_order"


def sample_first(orders: DataFrame, fraction: float = 1.0) -> DataFrame:
    """The first ``int(rows * fraction)`` orders by order_id, a key (1.0 keeps the table as it is).

    The last id to keep is found by its rank; the table is filtered, never sorted.
    """
    if fraction >= 1.0:
        return orders
    keep = orders.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction))).first()[0]
    last = nth_smallest(orders, "order_id", keep)
    return orders.where(F.lit(False) if last is None else F.col("order_id") <= last)


def lines_of(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines whose order is kept."""
    return lines.join(orders.select("order_id"), "order_id", "left_semi")


def days_per_user(orders: DataFrame) -> DataFrame:
    """Missing gaps become 0, except for users who have a 0 already: theirs stay missing.

    The per-user flag is aggregated (partial sums before the shuffle) and joined back, so a
    user with very many orders is split by the join instead of sorted in one window.
    """
    flags = orders.groupBy("user_id").agg(
        F.coalesce(F.max(F.col(DAYS) == 0), F.lit(False)).alias("_has_zero")
    )
    fixed = F.when(F.col("_has_zero"), F.col(DAYS)).otherwise(F.coalesce(DAYS, F.lit(0.0)))
    return orders.join(flags, "user_id").withColumn(DAYS, fixed).select(*orders.columns)


def _any_zero(orders: DataFrame):
    return F.coalesce(F.max(F.col(DAYS) == 0), F.lit(False))


def orders_global(orders: DataFrame) -> DataFrame:
    """If any order has gap 0, rows without a gap are dropped; otherwise they get gap 0."""
    drop_missing = orders.agg(_any_zero(orders)).scalar()
    return orders.where(F.col(DAYS).isNotNull() | ~drop_missing).withColumn(
        DAYS, F.coalesce(DAYS, F.lit(0.0))
    )


def orders_global_report(orders: DataFrame) -> DataFrame:
    """Rows before, removed and after :func:`orders_global`, in one pass."""
    facts = orders.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count(DAYS).alias("_known"),
        _any_zero(orders).alias("_zero"),
    )
    removed = F.when(F.col("_zero"), F.col("original_rows") - F.col("_known")).otherwise(F.lit(0))
    return facts.select(
        "original_rows",
        removed.cast("long").alias("removed_rows"),
        (F.col("original_rows") - removed).cast("long").alias("final_rows"),
    )
