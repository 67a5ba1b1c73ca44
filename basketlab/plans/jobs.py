"""Batch jobs over stored retail tables: load, clean, segment, train, serve.

Each job reads parquet tables, writes parquet tables, and can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.operators import baskets, clean, factor, rules_eval, segment
from basketlab.sources import store, tables


def load(spark: SparkSession, csv_folder: str, out: str) -> None:
    """CSV files to typed tables."""
    tables.write(tables.read(spark, csv_folder, "csv"), out)


def clean_orders(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Write the cleaned orders next to (never over) the tables read; return the row report."""
    if out.rstrip("/") == folder.rstrip("/"):
        raise ValueError("the output folder must differ from the input folder")
    orders = tables.read(spark, folder).orders
    tables.write_sorted(clean.orders_global(orders), f"{out}/orders_cleaned")
    return clean.orders_global_report(orders)


def segment_users(
    spark: SparkSession, folder: str, out: str, k: int = 4, n_init: int = 10, fraction: float = 1.0
) -> None:
    """Repaired orders, their lines, users with their segment, segment statistics."""
    retail = tables.read(spark, folder)
    orders = clean.sample_first(retail.orders, fraction)
    lines = retail.order_products
    if fraction < 1.0:
        lines = clean.lines_of(lines, orders)
    labelled = segment.fit(segment.scale(segment.rfm(orders, lines)), k, n_init)
    users = labelled.select("user_id", *segment.FEATURES, "cluster")
    tables.write_table(users, f"{out}/user_clusters")
    saved = spark.read.parquet(f"{out}/user_clusters")
    tables.write_table(segment.stats(saved), f"{out}/cluster_statistics")
    tables.write_sorted(clean.days_per_user(orders), f"{out}/clean_orders")
    tables.write_sorted(lines, f"{out}/clean_order_products")


def _lines(spark: SparkSession, folder: str, cleaned: str) -> tuple[tables.Retail, DataFrame]:
    retail = tables.read(spark, folder)
    orders = spark.read.parquet(f"{cleaned}/orders_cleaned")
    return retail, baskets.user_lines(retail.order_products, orders, retail.products)


def _save_rules(model: baskets.RuleModel, names: DataFrame, out: str, group: str | None, params: dict) -> None:
    counts = rules_eval.rule_counts(model.rules, model.test, group)
    metrics = rules_eval.metrics(counts, group)
    errors = rules_eval.rmse(counts, group)
    joined = metrics.join(errors, group) if group else metrics.select(
        "*", errors.select(F.struct("mse", "rmse")).scalar().alias("e")
    ).select("*", "e.*").drop("e")
    parts = {"rules": model.rules, "test": model.test, "metrics": joined, "names": names}
    store.save(parts, out, params)


def train_rules(
    spark: SparkSession, folder: str, cleaned: str, out: str,
    min_support: float = 0.05, min_lift: float = 1.0, test_size: float = 0.2, seed: int = 42,
) -> None:
    """Rules between aisles, with holdout metrics."""
    retail, lines = _lines(spark, folder, cleaned)
    params = {"min_support": min_support, "min_lift": min_lift, "test_size": test_size, "seed": seed}
    model = baskets.fit_rules(baskets.baskets(lines, "aisle_id"), **params)
    _save_rules(model, retail.aisles, out, None, params)


def train_segment_rules(
    spark: SparkSession, folder: str, cleaned: str, segments: str, out: str,
    min_support: float = 0.01, min_lift: float = 1.5, test_size: float = 0.2, seed: int = 42,
    top_n: int = 1500, item_col: str = "product_id",
) -> None:
    """Rules between products, one rule base per segment."""
    retail, lines = _lines(spark, folder, cleaned)
    users = spark.read.parquet(f"{segments}/user_clusters")
    params = {"min_support": min_support, "min_lift": min_lift, "test_size": test_size, "seed": seed}
    rows = baskets.cluster_baskets(lines, users, item_col, top_n)
    model = baskets.fit_rules(rows, **params, group_col="cluster")
    names = retail.products.select("product_id", "product_name")
    _save_rules(model, names, out, "cluster", params)


def _save_svd(model: factor.SvdModel, names: DataFrame, out: str, params: dict) -> None:
    parts = {
        "factors": model.factors,
        "interactions": model.interactions,
        "user_factors": factor.user_factors(model),
        "metrics": factor.evaluate(model),
        "explained_variance": factor.explained_variance(model),
        "names": names,
    }
    store.save(parts, out, {**params, "group_col": model.group_col})


def load_svd(spark: SparkSession, folder: str) -> factor.SvdModel:
    parts, params = store.load(spark, folder)
    return factor.SvdModel(
        parts["factors"], parts["interactions"], params["group_col"], params["test_size"], params["seed"]
    )


def train_svd(
    spark: SparkSession, folder: str, cleaned: str, out: str,
    n_components: int = 80, test_size: float = 0.2, seed: int = 42,
) -> None:
    """Factors of the user x aisle counts."""
    retail, lines = _lines(spark, folder, cleaned)
    counts = factor.interaction_counts(lines, "aisle_id")
    params = {"n_components": n_components, "test_size": test_size, "seed": seed}
    _save_svd(factor.fit_svd(counts, **params), retail.aisles, out, params)


def train_segment_svd(
    spark: SparkSession, folder: str, cleaned: str, segments: str, out: str,
    n_components: int = 50, test_size: float = 0.2, seed: int = 42, top_n: int = 4000,
) -> None:
    """Factors of the binary user x product ratings, one model per segment."""
    retail, lines = _lines(spark, folder, cleaned)
    users = spark.read.parquet(f"{segments}/user_clusters")
    ratings = factor.cluster_ratings(lines, users, "product_id", top_n)
    params = {"n_components": n_components, "test_size": test_size, "seed": seed}
    model = factor.fit_svd(ratings, **params, group_col="cluster")
    _save_svd(model, retail.products.select("product_id", "product_name"), out, params)
