"""Customer segments: recency / frequency / monetary features, scaling, k-means."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlab.operators import lloyd
from basketlab.session import cut, local_table

FEATURES = ("recency", "frequency", "monetary")

# Segment texts by segment number, long form and card form.
DESCRIPTIONS = {
    0: "Super Frequent Customers - Recent small purchases, very high frequency",
    1: "Inactive/At Risk Customers - Not recent, low frequency and spending",
    2: "VIP/Big Spenders - Medium recency, high frequency and spending",
    3: "Growing Customers - Recent purchases, moderate frequency and spending",
    4: "New/Sporadic Customers - Very recent but low frequency and spending",
}
CARD_DESCRIPTIONS = {
    0: "Super Frequent Customer",
    1: "Inactive/At Risk Customer",
    2: "VIP/Big Spender",
    3: "Growing Customer",
    4: "New/Sporadic Customer",
}


def rfm(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per user: longest gap between orders, number of orders, number of lines.

    ``orders`` is the raw table: after the per-user repair of the gap its maximum is the
    maximum known gap, or 0 when no gap is known, so the repair needs no pass of its own.
    Lines are counted per order before they meet the orders.
    """
    behaviour = orders.groupBy("user_id").agg(
        F.coalesce(F.max("days_since_prior_order"), F.lit(0.0)).alias("recency"),
        F.max("order_number").cast("long").alias("frequency"),
    )
    sizes = lines.groupBy("order_id").agg(F.count("product_id").alias("_n"))
    spend = (
        sizes.join(orders.select("order_id", "user_id"), "order_id")
        .groupBy("user_id")
        .agg(F.sum("_n").alias("monetary"))
    )
    return behaviour.join(spend, "user_id")


def scale(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(x - mean) / population standard deviation as ``<name>_scaled``; spread 0 divides by 1."""
    moments = features.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        )
    ).scalar()

    def scaled(c: str) -> Column:
        spread = F.when(F.col(f"_m.{c}_std") == 0, F.lit(1.0)).otherwise(F.col(f"_m.{c}_std"))
        return ((F.col(c) - F.col(f"_m.{c}_mean")) / spread).alias(f"{c}_scaled")

    with_moments = features.withColumn("_m", moments)
    return with_moments.select(*features.columns, *[scaled(c) for c in columns])


def assign(
    scaled: DataFrame, centroids: list[tuple[float, ...]], columns: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Nearest centroid by squared distance, ties to the lower number; no join involved."""

    def distance(centre: tuple[float, ...]) -> Column:
        parts = [
            (F.col(f"{c}_scaled") - F.lit(float(x))) * (F.col(f"{c}_scaled") - F.lit(float(x)))
            for c, x in zip(columns, centre)
        ]
        return reduce(add, parts)

    choices = F.array(
        *[
            F.struct(distance(c).alias("d"), F.lit(i).alias("cluster"))
            for i, c in enumerate(centroids)
        ]
    )
    return scaled.withColumn("cluster", F.array_min(choices).getField("cluster"))


def _names(columns: tuple[str, ...]) -> list[str]:
    return [f"{c}_scaled" for c in columns]


def elbow(
    scaled: DataFrame,
    ks: range = range(2, 10),
    n_init: int = 10,
    seed: int = 42,
    columns: tuple[str, ...] = FEATURES,
    id_col: str = "user_id",
) -> DataFrame:
    """(k, wcss) for each k, the best of ``n_init`` restarts."""
    best = lloyd.fit_all(scaled, _names(columns), id_col, ks, n_init, seed)
    return local_table(scaled.sparkSession, [(k, cost) for k, (cost, _) in best.items()], "k int,wcss double")


def fit(
    scaled: DataFrame,
    k: int = 4,
    n_init: int = 10,
    seed: int = 42,
    columns: tuple[str, ...] = FEATURES,
    id_col: str = "user_id",
) -> DataFrame:
    """Input rows plus ``cluster``, numbered so that the segment texts fit."""
    rows = cut(scaled)
    best = lloyd.fit_all(rows, _names(columns), id_col, range(k, k + 1), n_init, seed)
    if not best:
        return rows.withColumn("cluster", F.lit(0))
    labelled = rows.withColumn("_raw", lloyd.nearest(_names(columns), best[k][1]))
    means = labelled.groupBy("_raw").agg(*[F.avg(c).alias(c) for c in columns]).collect()
    numbers = canonical_numbers({m["_raw"]: {c: m[c] for c in columns} for m in means})
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(numbers.items())])
    return labelled.withColumn("cluster", mapping[F.col("_raw")]).drop("_raw")


def canonical_numbers(means: dict[int, dict[str, float]]) -> dict[int, int]:
    """Raw label -> 2 for the biggest spenders, then 1 for the least recent of the others,
    then 0 for the most frequent, and 3, 4, ... for the rest by spending."""
    left = dict(means)
    numbers: dict[int, int] = {}
    for number, feature in ((2, "monetary"), (1, "recency"), (0, "frequency")):
        if left:
            raw = max(left, key=lambda r: (left[r][feature], -r))
            numbers[raw] = number
            del left[raw]
    rest = sorted(left, key=lambda r: (-left[r]["monetary"], r))
    numbers.update({raw: 3 + i for i, raw in enumerate(rest)})
    return numbers


def description(cluster: str = "cluster", texts: dict[int, str] | None = None) -> Column:
    pairs = chain.from_iterable((texts or DESCRIPTIONS).items())
    return F.create_map(*[F.lit(x) for x in pairs])[F.col(cluster)]


def means(labelled: DataFrame) -> DataFrame:
    """Mean of every feature (and of user_id, as a frame-wide mean gives) per segment."""
    return labelled.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in ("user_id", *FEATURES)]
    )


def stats(labelled: DataFrame) -> DataFrame:
    """Rounded means, number of users and description per segment."""
    return (
        labelled.groupBy("cluster")
        .agg(
            *[F.round(F.avg(c), 2).alias(c) for c in FEATURES],
            F.count("user_id").alias("n_users"),
        )
        .withColumn("description", description())
    )
