"""Five profiling reports over any set of named tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.session import local_table

QUARTILES = (0.25, 0.5, 0.75)
# Sketch accuracy: the rank error of a bracket is at most rows / accuracy. It grows with the
# table, so that a bracket never holds more than about eight million rows.
ACCURACY = 10_000
ROWS_PER_RANK = 1_000_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
            )
            for name, df in tables.items()
        ]
    )


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def _per_column(name: str, df: DataFrame, measure: str, expr) -> DataFrame:
    """One aggregate per column in one pass, turned into (table, column, dtype, measure) rows."""
    wide = df.agg(*[expr(c).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("dtype"),
                F.col(c).cast("long").alias(measure),
            )
            for c in df.columns
        ]
    )
    return wide.select(F.lit(name).alias("table_name"), F.explode(cells).alias("c")).select(
        "table_name", "c.*"
    )


def info(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_per_column(n, df, "non_null", F.count) for n, df in tables.items()])


def nulls(tables: dict[str, DataFrame]) -> DataFrame:
    def missing(c: str):
        return F.count(F.when(F.col(c).isNull(), 1))

    return _union(
        [_per_column(n, df, "null_count", missing).drop("dtype") for n, df in tables.items()]
    )


def describe(name: str, df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear interpolation) and max of numeric columns.

    Exact quartiles without sorting a column: a mergeable sketch brackets each target rank,
    then only values inside the bracket (about 8 * rows / accuracy of them) are counted and
    ranked. A column with at most ``accuracy`` rows is its own bracket. The first pass
    returns one row.
    """
    if accuracy is None:
        accuracy = max(ACCURACY, df.count() // ROWS_PER_RANK)
    columns = "table_name string,column_name string,n long,mean double,std double,lo double,"
    columns += "p25 double,p50 double,p75 double,hi double"
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return local_table(df.sparkSession, [], columns)
    step = 4.0 / accuracy
    probes = [max(0.0, q - step) for q in QUARTILES] + [min(1.0, q + step) for q in QUARTILES]
    first = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("lo"),
                F.max(c).cast("double").alias("hi"),
                F.percentile_approx(F.col(c).cast("double"), probes, accuracy).alias("probes"),
            ).alias(c)
            for c in numeric
        ]
    ).first()
    spark = df.sparkSession
    brackets, stats = [], []
    for c in numeric:
        s = first[c]
        stats.append((c, s.n, s.mean, s.std, s.lo, s.hi))
        if not s.n:
            continue
        for i, q in enumerate(QUARTILES):
            small = s.n <= accuracy
            low = s.lo if small or q <= step else s.probes[i]
            high = s.hi if small or q + step >= 1 else s.probes[i + len(QUARTILES)]
            brackets.append((c, q, float(low), float(high), q * (s.n - 1)))
    if not brackets:
        rows = [(name, c, n, mean, std, lo, None, None, None, hi) for c, n, mean, std, lo, hi in stats]
        return local_table(spark, rows, columns)
    quartiles = _quartiles(df, brackets)
    table = local_table(
        spark, stats, "column_name string,n long,mean double,std double,lo double,hi double"
    )
    return table.join(quartiles, "column_name", "left").select(
        F.lit(name).alias("table_name"), "column_name", "n", "mean", "std", "lo",
        "p25", "p50", "p75", "hi",
    )


def _quartiles(df: DataFrame, brackets: list[tuple]) -> DataFrame:
    """Exact value at each bracket's fractional rank."""
    below = df.agg(
        *[
            F.count(F.when(F.col(c).cast("double") < low, 1)).alias(f"b{i}")
            for i, (c, _, low, _, _) in enumerate(brackets)
        ]
    )
    inside = F.filter(
        F.array(
            *[
                F.when(
                    F.col(c).cast("double").between(low, high),
                    F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")),
                )
                for i, (c, _, low, high, _) in enumerate(brackets)
            ]
        ),
        lambda s: s.isNotNull(),
    )
    counted = (
        df.select(F.explode(inside).alias("s")).groupBy("s.i", "s.v").agg(F.count("*").alias("m"))
    )
    spark = df.sparkSession
    targets = local_table(
        spark,
        [(i, c, q, rank) for i, (c, q, _, _, rank) in enumerate(brackets)],
        "i int,column_name string,q double,target double",
    )
    offsets = below.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("below"))
                    for i in range(len(brackets))
                ]
            )
        ).alias("o")
    ).select("o.*")
    run = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.withColumn("cum", F.sum("m").over(run))
        .join(F.broadcast(targets.join(offsets, "i")), "i")  # three rows per numeric column
        .withColumn("end", F.col("below") + F.col("cum") - 1)
        .withColumn("start", F.col("end") - F.col("m") + 1)
    )

    def at(rank):
        return F.max(F.when((F.col("start") <= rank) & (F.col("end") >= rank), F.col("v")))

    low = at(F.floor("target"))
    high = at(F.ceil("target"))
    weight = F.max(F.col("target") - F.floor("target"))
    value = low + (high - low) * weight
    missed = F.raise_error(F.lit("a bracket missed its rank; pass a higher accuracy"))
    per = ranked.groupBy("column_name", "q").agg(F.coalesce(value, missed.cast("double")).alias("value"))

    def quartile(q: float, label: str):
        return F.max(F.when(F.col("q") == q, F.col("value"))).alias(label)

    return per.groupBy("column_name").agg(
        *[quartile(q, label) for q, label in zip(QUARTILES, ("p25", "p50", "p75"))]
    )
