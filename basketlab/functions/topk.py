"""Top-k per group without moving a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rank"
) -> DataFrame:
    """Rows of ``df`` with rank 1..n inside each group. ``order`` must be a total order.

    Spark trims each map task to n rows per group before the shuffle (window group limit; the
    session raises its threshold, see ``session.SKEW``), so a hot group sends n rows per task.
    """
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(whole)).where(F.col(rank_col) <= n)
