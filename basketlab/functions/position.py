"""Row positions that stay parallel whatever the size of a group.

The largest group is measured first. Where one task can sort it, rows are numbered by a window over
the key. Otherwise rows are ranged by (key, order, id), so a key with very many rows spans several
ranges and one with few shares a range, numbered inside (range, key) and shifted by the counts of the
ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.session import cut

# Rows of the largest group that a window in one task still numbers.
WINDOW_ROWS = 1_000_000
# Rows that are sorted to pick one by rank; accuracy of the sketch that brackets a rank.
SORTED_ROWS, SKETCH = 10_000, 1_000
_BEFORE = (Window.unboundedPreceding, -1)


def _ranged(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` written in ranges of the columns (nulls first), with the range's number."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(partitions, *columns).withColumn("_range", F.spark_partition_id()))


def global_position(df: DataFrame, id_col: str, name: str = "position") -> DataFrame:
    """0-based position of every row in ascending order of a unique id.

    Only the counts per range (one row per shuffle partition) meet in one task.
    """
    ranged = _ranged(df, id_col)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(*_BEFORE)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(id_col)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long"))
        .select(*df.columns, name)
    )


def nth_smallest(df: DataFrame, id_col: str, n: int) -> int | None:
    """The ``n``-th smallest of unique, whole ids (from 1), without sorting them.

    A mergeable sketch brackets the rank, the rows below are counted, and the bracket is narrowed the
    same way until it is small enough to be sorted. Nulls do not count.
    """
    low, high, rank = None, None, n
    rows = df.select(F.col(id_col).cast("long").alias("x")).where("x is not null")
    while True:
        inside = rows if low is None else rows.where(F.col("x").between(low, high))
        count = inside.count()
        if rank < 1 or rank > count:
            return None
        if count <= SORTED_ROWS:
            return inside.orderBy("x").limit(rank).agg(F.max("x")).first()[0]
        share = [max(0.0, (rank - 1) / count - 2 / SKETCH), min(1.0, rank / count + 2 / SKETCH)]
        start, end = inside.agg(F.percentile_approx("x", share, SKETCH)).first()[0]
        if start == end:
            return start
        below = inside.where(F.col("x") < start).count()
        if not below < rank <= below + inside.where(F.col("x").between(start, end)).count():
            raise RuntimeError("the sketch missed its bound")
        low, high, rank = start, end, rank - below


def number_in_group(df: DataFrame, key: str, order: str, id_col: str) -> DataFrame:
    """Add ``number`` (1..n by order, id; nulls first), ``previous`` (order value one row earlier), ``total``."""
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        own = Window.partitionBy(key).orderBy(order, id_col)
        return df.select(
            *df.columns,
            F.row_number().over(own).alias("number"),
            F.lag(order).over(own).alias("previous"),
            F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        )
    ranged = _ranged(df, key, order, id_col)
    # Nulls come first, so the last value of a range is its greatest (null if all are).
    parts = ranged.groupBy(key, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last")
    )
    by_range = Window.partitionBy(key).orderBy("_range")
    parts = parts.select(
        F.col(key).alias("_key"),
        F.col("_range").alias("_at"),
        F.coalesce(F.sum("_n").over(by_range.rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"),
        F.lag("_last").over(by_range).alias("_earlier"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_total"),
    )
    inside = Window.partitionBy("_range", key).orderBy(order, id_col)
    rows = ranged.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_lag", F.lag(order).over(inside)
    )
    same = (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(parts, same).select(
        *df.columns,
        (F.col("_before") + F.col("_row")).cast("int").alias("number"),
        F.when(F.col("_row") == 1, F.col("_earlier")).otherwise(F.col("_lag")).alias("previous"),
        F.col("_total").alias("total"),
    )
