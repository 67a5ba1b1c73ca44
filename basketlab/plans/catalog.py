"""Named queries: each takes a workspace and returns a DataFrame with engine-neutral columns."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.columns import ids_text, is_train, rounded
from basketlab.functions.text import tokens
from basketlab.operators import (
    baskets,
    clean,
    factor,
    profile,
    ranking,
    recommend,
    restricted,
    rules_eval,
    search,
    segment,
)
from basketlab.plans import jobs
from basketlab.plans.workspace import ASKED, AISLE_RULES, DOCUMENT_SEARCHES, PRODUCT_SEARCHES, Workspace
from basketlab.session import cut, new_folder
from basketlab.sources import integrity, store, tables

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- tables -------------------------------------------------------------------------------


@query
def retail_orders(ws: Workspace) -> DataFrame:
    return ws.view.orders


@query
def retail_order_products(ws: Workspace) -> DataFrame:
    return ws.view.order_products


@query
def retail_products(ws: Workspace) -> DataFrame:
    return tables.star(ws.view.retail)


@query
def merge_prior_train(ws: Workspace) -> DataFrame:
    sets = ws.view.orders.select("order_id", "eval_set")
    lines = ws.view.order_products.join(sets, "order_id")
    prior = lines.where(F.col("eval_set") == "prior").drop("eval_set")
    train = lines.where(F.col("eval_set") == "train").drop("eval_set")
    return tables.merge_prior_train(prior, train)


@query
def integrity_report(ws: Workspace) -> DataFrame:
    return integrity.integrity_report(ws.stored)


# --- profiling ----------------------------------------------------------------------------


@query
def profile_shape(ws: Workspace) -> DataFrame:
    return profile.shape(ws.view.retail.named())


HEAD_ORDER = {
    "aisles": ["aisle_id"],
    "departments": ["department_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_products": ["order_id", "product_id", "add_to_cart_order", "reordered"],
}


@query
def profile_head(ws: Workspace) -> DataFrame:
    parts = []
    for name, df in ws.view.retail.named().items():
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
        first = profile.head(df, HEAD_ORDER[name])
        parts.append(first.select(F.lit(name).alias("table_name"), text.alias("row_text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def profile_info(ws: Workspace) -> DataFrame:
    return profile.info(ws.view.retail.named())


@query
def profile_nulls(ws: Workspace) -> DataFrame:
    return profile.nulls(ws.view.retail.named())


@query
def profile_describe(ws: Workspace) -> DataFrame:
    named = ws.stored.named()
    with ThreadPoolExecutor(len(named)) as pool:  # the tables' jobs run side by side
        parts = list(pool.map(lambda item: profile.describe(*item), named.items()))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "table_name", "column_name", "n", *rounded("mean", "std", "lo", "p25", "p50", "p75", "hi")
    )


# --- cleaning -----------------------------------------------------------------------------


@query
def sample_orders(ws: Workspace) -> DataFrame:
    return clean.sample_first(ws.view.orders, 0.02)


@query
def sample_order_lines(ws: Workspace) -> DataFrame:
    return clean.lines_of(ws.view.lines, clean.sample_first(ws.view.orders, 0.02))


def _damaged_lines(ws: Workspace) -> str:
    """The orders as CSV lines, some of them damaged: a word for a number, a field too few, no user."""
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in tables.SCHEMAS["orders"].fields]
    id_ = F.col("order_id")
    word = F.concat_ws(",", *cells[:3], F.lit("many"), *cells[4:])
    short = F.concat_ws(",", *cells[:5])
    nobody = F.concat_ws(",", cells[0], F.lit(""), *cells[2:])
    line = F.when(id_ % 97 == 0, word).when(id_ % 89 == 0, short).when(id_ % 83 == 0, nobody).otherwise(F.concat_ws(",", *cells))
    folder = new_folder(ws.spark, "lines")
    ws.view.orders.select(line.alias("value")).write.text(folder)
    return folder


@query
def load_report(ws: Workspace) -> DataFrame:
    """Lines a checked load rejects, per cause."""
    _, rejected = tables.read_checked(ws.spark, _damaged_lines(ws), "orders", header=False)
    return rejected.groupBy("cause").agg(F.count("*").alias("n_lines"))


@query
def loaded_orders(ws: Workspace) -> DataFrame:
    """Lines read with checks, cast to the schema, written in order of the key and read again."""
    accepted, _ = tables.read_checked(ws.spark, _damaged_lines(ws), "orders", header=False)
    folder = new_folder(ws.spark, "loaded")
    tables.write_sorted(tables.conform(accepted, "orders"), folder)
    return ws.spark.read.schema(tables.SCHEMAS["orders"]).parquet(folder)


@query
def sorted_sink_report(ws: Workspace) -> DataFrame:
    """Files of the sorted sink: rows in all, rows out of order within a file, files that overlap."""
    folder = new_folder(ws.spark, "sorted")
    tables.write_sorted(ws.view.orders, folder)
    rows = ws.spark.read.parquet(folder).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), "order_id"
    )
    inside = Window.partitionBy("file").orderBy("place")
    rows = rows.withColumn("falls", F.lag("order_id").over(inside) > F.col("order_id"))
    files = rows.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if("falls").alias("falls"), F.min("order_id").alias("low"), F.max("order_id").alias("high")
    )
    # One row per file: its least id against the greatest of the files before.
    before = F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("overlaps", F.coalesce(before >= F.col("low"), F.lit(False)))
    return files.agg(
        F.sum("n").alias("n_rows"), F.sum("falls").alias("out_of_order"), F.count_if("overlaps").alias("overlapping_files")
    )


@query
def cleaned_orders_job(ws: Workspace) -> DataFrame:
    """Tables loaded in bulk, cleaned by the batch job and read from its output."""
    source, out = new_folder(ws.spark, "retail"), new_folder(ws.spark, "cleaned")
    tables.write(ws.stored, source)
    jobs.clean_orders(ws.spark, source, out)
    return ws.spark.read.schema(tables.SCHEMAS["orders"]).parquet(f"{out}/orders_cleaned")


@query
def clean_days_per_user(ws: Workspace) -> DataFrame:
    return clean.days_per_user(ws.view.orders)


@query
def clean_orders_global(ws: Workspace) -> DataFrame:
    return ws.clean_orders


@query
def clean_orders_report(ws: Workspace) -> DataFrame:
    return clean.orders_global_report(ws.view.orders)


@query
def validate_user_ids(ws: Workspace) -> DataFrame:
    people = ws.view.source("customer")
    typed = people.select(F.col("c_custkey").cast("string").alias("typed")).unionByName(
        people.select(F.col("c_name").alias("typed"))
    )
    return recommend.validate_user_ids(typed, ws.view.orders)


@query
def product_detail(ws: Workspace) -> DataFrame:
    asked = ws.star.where(F.col("product_id") % ASKED == 0)
    return recommend.product_detail(ws.star, asked)


@query
def user_products(ws: Workspace) -> DataFrame:
    return recommend.user_items(ws.user_lines, "product_id")


@query
def user_aisles(ws: Workspace) -> DataFrame:
    return recommend.user_items(ws.user_lines, "aisle_id")


# --- segments -----------------------------------------------------------------------------


@query
def rfm(ws: Workspace) -> DataFrame:
    return ws.rfm


@query
def rfm_scaled(ws: Workspace) -> DataFrame:
    return ws.scaled.select("user_id", *rounded(*[f"{c}_scaled" for c in segment.FEATURES]))


@query
def segment_assign(ws: Workspace) -> DataFrame:
    return ws.segments.select("user_id", "cluster")


@query
def segment_means(ws: Workspace) -> DataFrame:
    return segment.means(ws.segments).select("cluster", *rounded("user_id", *segment.FEATURES))


@query
def segment_stats(ws: Workspace) -> DataFrame:
    return segment.stats(ws.segments)


@query
def segment_balance(ws: Workspace) -> DataFrame:
    """K-means: scatter inside the segments and between their means adds up to the whole."""
    names = [f"{c}_scaled" for c in segment.FEATURES]
    users = segment.fit(ws.scaled)
    means = users.groupBy("cluster").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    rows = users.join(F.broadcast(means), "cluster")  # one row per segment
    inside = sum((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in names)
    between = sum(F.col(f"m_{c}") * F.col(f"m_{c}") for c in names)
    return rows.agg(
        F.countDistinct("cluster").alias("segments"),
        F.count(F.lit(1)).alias("n_users"),
        F.round(F.sum(inside) + F.sum(between), 4).alias("scatter"),
    )


@query
def elbow_wcss(ws: Workspace) -> DataFrame:
    return segment.elbow(ws.scaled).select("k", *rounded("wcss", digits=4))


@query
def segment_users(ws: Workspace) -> DataFrame:
    return segment.fit(ws.scaled).select("user_id", "cluster")


# --- interactions -------------------------------------------------------------------------


@query
def user_aisle_counts(ws: Workspace) -> DataFrame:
    return ws.aisle_counts


@query
def cluster_user_aisle_counts(ws: Workspace) -> DataFrame:
    return ws.cluster_aisle_interactions.select("cluster", "user_id", "item", "value")


@query
def user_product_ratings(ws: Workspace) -> DataFrame:
    return factor.cluster_ratings(ws.user_lines, ws.user_clusters)


@query
def cluster_top_products(ws: Workspace) -> DataFrame:
    return recommend.cluster_top_sold(ws.cluster_counts, ws.view.products, 1500).drop(
        "product_name"
    )


# --- baskets and rules --------------------------------------------------------------------


@query
def aisle_baskets(ws: Workspace) -> DataFrame:
    return baskets.baskets(ws.user_lines, "aisle_id")


@query
def basket_arrays(ws: Workspace) -> DataFrame:
    arrays = baskets.basket_arrays(baskets.baskets(ws.user_lines, "aisle_id"))
    return arrays.select("order_id", ids_text("items").alias("items"))


@query
def cluster_product_baskets(ws: Workspace) -> DataFrame:
    return baskets.cluster_baskets(ws.user_lines, ws.user_clusters, "product_id")


@query
def basket_split(ws: Workspace) -> DataFrame:
    orders = ws.user_lines.select("order_id").distinct()
    return orders.select("order_id", is_train("order_id").alias("is_train"))


@query
def user_split(ws: Workspace) -> DataFrame:
    users = ws.user_lines.select("user_id").distinct()
    return users.select("user_id", is_train("user_id").alias("is_train"))


def _itemsets(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, ids_text("items").alias("items"), F.size("items").alias("n_items"), "freq",
        *rounded("support"),
    )


RULE_MEASURES = (
    "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
    "conviction", "combined_score",
)


def _rules(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        ids_text("antecedents").alias("antecedents"),
        ids_text("consequents").alias("consequents"),
        *rounded(*RULE_MEASURES),
    )


@query
def freq_itemsets_department(ws: Workspace) -> DataFrame:
    return _itemsets(ws.department_rules.itemsets)


@query
def freq_itemsets_aisle(ws: Workspace) -> DataFrame:
    return _itemsets(ws.aisle_rules.itemsets)


@query
def cluster_freq_itemsets(ws: Workspace) -> DataFrame:
    return _itemsets(ws.cluster_rules.itemsets, "cluster")


@query
def assoc_rules_department(ws: Workspace) -> DataFrame:
    return _rules(ws.department_rules.rules)


@query
def assoc_rules_aisle(ws: Workspace) -> DataFrame:
    return _rules(ws.aisle_rules.rules)


@query
def stored_rule_model(ws: Workspace) -> DataFrame:
    """Rules as a later job reads them: saved, loaded, selected."""
    folder = new_folder(ws.spark, "rules")
    store.save({"rules": ws.aisle_rules.rules, "test": ws.aisle_rules.test}, folder, AISLE_RULES)
    parts, params = store.load(ws.spark, folder)
    return _rules(parts["rules"].where(F.col("lift") >= params["min_lift"]))


@query
def cluster_assoc_rules(ws: Workspace) -> DataFrame:
    return _rules(ws.cluster_rules.rules, "cluster")


# --- evaluation ---------------------------------------------------------------------------


def _metric_columns(df: DataFrame, *keys: str) -> DataFrame:
    exact = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
    means = ["avg_confidence", "avg_lift", "avg_support", "accuracy", "precision", "recall", "f1_score"]
    return df.select(*keys, *exact, "total_rules", *rounded(*means))


@query
def rule_counts(ws: Workspace) -> DataFrame:
    counts = rules_eval.rule_counts(ws.department_rules.rules, ws.department_rules.test)
    return counts.select(
        ids_text("antecedents").alias("antecedents"),
        ids_text("consequents").alias("consequents"),
        "matched", "both", "hit", "n_orders",
    )


@query
def rule_confusion(ws: Workspace) -> DataFrame:
    return rules_eval.confusion(ws.aisle_rule_counts)


@query
def rule_metrics(ws: Workspace) -> DataFrame:
    return _metric_columns(rules_eval.metrics(ws.aisle_rule_counts))


@query
def rule_rmse(ws: Workspace) -> DataFrame:
    return rules_eval.rmse(ws.aisle_rule_counts).select(
        "matched_orders", *rounded("mse", "rmse", digits=9)
    )


@query
def cluster_rule_metrics(ws: Workspace) -> DataFrame:
    counts = rules_eval.rule_counts(ws.cluster_rules.rules, ws.cluster_rules.test, "cluster")
    return _metric_columns(rules_eval.metrics(counts, "cluster"), "cluster")


def _ranking(ws: Workspace, order: str) -> DataFrame:
    """History counts as scores, the latest order as truth."""
    lines = baskets.user_lines(ws.view.lines, ws.clean_orders, ws.view.products, "eval_set")
    both = lines.groupBy("user_id", F.col("aisle_id").alias("item")).agg(
        F.count(F.when(F.col("eval_set") == "prior", 1)).alias("score"),
        F.count(F.when(F.col("eval_set") == "train", 1)).alias("latest"),
    )
    both = cut(both)
    truth = both.where(F.col("latest") > 0).select("user_id", "item")
    scores = both.where(F.col("score") > 0).select("user_id", "item", "score")
    return ranking.metrics(truth, scores, 5, order).select(
        "n_users", *rounded(*ranking.MEASURES)
    )


@query
def ranking_metrics(ws: Workspace) -> DataFrame:
    return _ranking(ws, ranking.BEST_FIRST)


@query
def ranking_metrics_worst_first(ws: Workspace) -> DataFrame:
    return _ranking(ws, ranking.WORST_FIRST)


# --- factors ------------------------------------------------------------------------------


@query
def item_gram(ws: Workspace) -> DataFrame:
    return factor.gram_cells(ws.aisle_counts)


@query
def cluster_item_gram(ws: Workspace) -> DataFrame:
    ratings = factor.cluster_ratings(ws.user_lines, ws.user_clusters, "product_name")
    return factor.gram_cells(ratings, "cluster")


@query
def svd_energy(ws: Workspace) -> DataFrame:
    parts = factor.explained_variance(ws.aisle_svd)
    return parts.agg(
        F.count(F.lit(1)).alias("components"),
        F.round(F.sum(F.col("sigma") * F.col("sigma")), 3).alias("energy"),
        F.round(F.max("cumulative_share"), 6).alias("kept_share"),
    )


@query
def explained_variance(ws: Workspace) -> DataFrame:
    found = factor.explained_variance(ws.aisle_svd_rank10)
    shares = rounded("sigma", "share", "cumulative_share", "share_of_total")
    return found.select("component", *shares, "components_for_95")


@query
def cluster_explained_variance(ws: Workspace) -> DataFrame:
    return factor.explained_variance(ws.product_svd)


def _svd_properties(model: factor.SvdModel) -> DataFrame:
    """Per group: what the components and the train error add up to, and whether V has unit columns."""
    g = model.group
    parts = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("v")).alias("k"), F.col("v").alias("x")))
    lengths = model.factors.select(g, parts.alias("p")).groupBy(g, "p.k").agg(
        F.sum(F.col("p.x") * F.col("p.x")).alias("length")
    )
    lengths = lengths.groupBy(g).agg(
        F.count(F.lit(1)).alias("components"),
        (F.max(F.abs(F.col("length") - 1)) < 1e-6).alias("unit_columns"),
    )
    powers = F.aggregate("sigma", F.lit(0.0), lambda a, s: a + s * s)
    kept = model.factors.where(F.col("idx") == 0).select(g, powers.alias("kept"))
    lost = factor.holdout_rows(model, train=True).groupBy(g).agg(F.sum("squared").alias("lost"))
    energy = F.round(F.col("kept") + F.col("lost"), 3).alias("energy")
    return lengths.join(kept, g).join(lost, g).select(g, "components", "unit_columns", energy)


@query
def svd_rank10_properties(ws: Workspace) -> DataFrame:
    """Train error and kept components of a truncated model share the energy of the train rows."""
    return _svd_properties(ws.aisle_svd_rank10).select("components", "unit_columns", "energy")


@query
def cluster_svd_properties(ws: Workspace) -> DataFrame:
    return _svd_properties(ws.product_svd)


@query
def svd_product_list_properties(ws: Workspace) -> DataFrame:
    """Per segment: users served, rows listed, and whether scores fall with the rank."""
    listed = factor.recommend(ws.product_svd, 9)
    before = F.lag("score").over(Window.partitionBy("cluster", "user_id").orderBy("rank"))
    return (
        listed.withColumn("falls", F.coalesce(before >= F.col("score"), F.lit(True)))
        .groupBy("cluster")
        .agg(
            F.countDistinct("user_id").alias("n_users"),
            F.count(F.lit(1)).alias("n_rows"),
            F.min("falls").alias("scores_fall"),
        )
    )


@query
def user_factors(ws: Workspace) -> DataFrame:
    unit = F.aggregate("factor", F.lit(0.0), lambda a, x: a + x * x)
    return factor.user_factors(ws.aisle_svd).select(
        "user_id", F.round(F.sqrt(unit), 6).alias("norm")
    )


def _svd_metrics(df: DataFrame, *keys: str) -> DataFrame:
    cells = ["true_positives", "false_positives", "false_negatives", "true_negatives", "n_users"]
    names = ["mse", "rmse", "mae", "accuracy", "precision", "recall", "f1_score", *ranking.MEASURES]
    return df.select(*keys, *cells, *rounded(*names))


@query
def svd_metrics(ws: Workspace) -> DataFrame:
    return _svd_metrics(factor.evaluate(ws.aisle_svd))


@query
def svd_metrics_rank10(ws: Workspace) -> DataFrame:
    return _svd_metrics(factor.evaluate(ws.aisle_svd_rank10))


@query
def cluster_svd_metrics(ws: Workspace) -> DataFrame:
    return _svd_metrics(factor.evaluate(ws.product_svd), "cluster")


@query
def similar_users(ws: Workspace) -> DataFrame:
    """Every user against all train users."""
    found = factor.similar_users(ws.aisle_svd, None, 10)
    return found.select("user_id", "neighbour", *rounded("similarity"), "rank")


@query
def similar_users_rank10(ws: Workspace) -> DataFrame:
    """Every user whose id ASKED divides against all train users."""
    found = factor.similar_users(ws.aisle_svd_rank10, ws.asked_users, 10)
    return found.select("user_id", "neighbour", *rounded("similarity"), "rank")


def _scores(df: DataFrame, item: str, *keys: str) -> DataFrame:
    return df.select("user_id", *keys, F.col("item").alias(item), *rounded("score"), "rank")


@query
def svd_recommend_aisles(ws: Workspace) -> DataFrame:
    return _scores(ws.svd_aisles, "aisle_id")


@query
def stored_svd_model(ws: Workspace) -> DataFrame:
    """Lists from a factor model that was saved and loaded."""
    folder, model = new_folder(ws.spark, "svd"), ws.aisle_svd
    params = {"group_col": model.group_col, "test_size": model.test_size, "seed": model.seed}
    store.save({"factors": model.factors, "interactions": model.interactions}, folder, params)
    parts, kept = store.load(ws.spark, folder)
    return _scores(factor.recommend(factor.SvdModel(**parts, **kept), 5), "aisle_id")


@query
def svd_recommend_aisles_rank10(ws: Workspace) -> DataFrame:
    return _scores(factor.recommend(ws.aisle_svd_rank10, 5), "aisle_id")


@query
def cluster_svd_recommend_aisles(ws: Workspace) -> DataFrame:
    own = factor.recommend(ws.cluster_aisle_svd, 5).drop("cluster")
    return _scores(recommend.cluster_first(own, ws.svd_aisles), "aisle_id", "cluster_specific")


@query
def svd_recommend_own_aisles(ws: Workspace) -> DataFrame:
    """Lists from the model of the user's segment on the ten aisles the base model puts first."""
    base = factor.recommend(ws.aisle_svd_rank10, restricted.LIST_LENGTH)
    own = restricted.recommend(base, ws.user_clusters, ws.aisle_counts, 5)
    return _scores(recommend.cluster_first(own, base.where("rank <= 5")), "aisle_id", "cluster_specific")


@query
def svd_recommend_products(ws: Workspace) -> DataFrame:
    return _scores(factor.recommend(ws.product_svd, 9), "product_id", "cluster")


def _products_text() -> Column:
    entry = F.transform(
        "top_products",
        lambda p: F.concat(p["product_id"].cast("string"), F.lit(":"), p["cluster_count"].cast("string")),
    )
    return F.coalesce(F.array_join(entry, ","), F.lit("")).alias("top_products")


@query
def svd_aisle_page(ws: Workspace) -> DataFrame:
    own = factor.recommend(ws.cluster_aisle_svd, 5).drop("cluster")
    listed = recommend.cluster_first(own, ws.svd_aisles).withColumnRenamed("item", "aisle_id")
    placed = listed.join(ws.user_clusters.select("user_id", "cluster"), "user_id")
    top = recommend.cluster_aisle_top_products(ws.cluster_counts, ws.view.products)
    return recommend.with_top_products(placed, top).select(
        "user_id", "aisle_id", "rank", *rounded("score"), _products_text()
    )


# --- customer pages -----------------------------------------------------------------------


@query
def user_card(ws: Workspace) -> DataFrame:
    return recommend.user_card(ws.user_clusters).withColumn(
        "avg_order_value", F.round("avg_order_value", 6)
    )


@query
def order_history(ws: Workspace) -> DataFrame:
    rows = recommend.order_history(ws.clean_orders, ws.user_lines, ws.view.aisles)
    return rows.withColumn("aisles", F.array_join("aisles", ","))


@query
def triggered_rules(ws: Workspace) -> DataFrame:
    return ws.triggered.select(
        "user_id",
        "order_id",
        ids_text("antecedents").alias("antecedents"),
        ids_text("consequents").alias("consequents"),
        *rounded("confidence", "lift", "support"),
    )


@query
def rule_summary(ws: Workspace) -> DataFrame:
    return recommend.rule_summary(ws.triggered)


@query
def user_rule_list(ws: Workspace) -> DataFrame:
    """Each rule once per user, with the names of its aisles."""
    names = recommend.rule_names(ws.aisle_rules.rules, ws.view.aisles, "aisle_id", "aisle", "Aisle")
    rows = recommend.rule_list(ws.triggered, names)
    texts = [F.array_join(c, ",").alias(c) for c in ("antecedent_names", "consequent_names")]
    return rows.select("user_id", ids_text("antecedents").alias("antecedents"), ids_text("consequents").alias("consequents"), *texts)


@query
def order_history_rules(ws: Workspace) -> DataFrame:
    """The order history with the rules each order triggers."""
    history = recommend.order_history(ws.clean_orders, ws.user_lines, ws.view.aisles)
    rows = recommend.with_triggered_rules(history, ws.triggered)
    return rows.select("user_id", "order_id", "order_number", "n_rules", F.array_join("rules", ";").alias("rules"))


@query
def cluster_aisle_top_products(ws: Workspace) -> DataFrame:
    return recommend.cluster_aisle_top_products(ws.cluster_counts, ws.view.products)


@query
def cluster_top_sold(ws: Workspace) -> DataFrame:
    return recommend.cluster_top_sold(ws.cluster_counts, ws.view.products)


def _mba(ws: Workspace) -> DataFrame:
    name = recommend.name_or("aisle", "Aisle", "aisle_id").alias("aisle_name")
    return (
        ws.mba.withColumnRenamed("item", "aisle_id")
        .join(ws.view.aisles, "aisle_id", "left")
        .withColumn("aisle_name", name)
        .drop("aisle")
    )


@query
def mba_recommendations(ws: Workspace) -> DataFrame:
    return _mba(ws).select(
        "user_id", "cluster", "aisle_id", "aisle_name", "previously_bought", "rank",
        "weight_confidence", "weight_lift", *rounded("confidence", "lift", "support", "score"),
    )


@query
def mba_aisle_page(ws: Workspace) -> DataFrame:
    top = recommend.cluster_aisle_top_products(ws.cluster_counts, ws.view.products)
    return recommend.with_top_products(_mba(ws), top).select(
        "user_id", "aisle_id", "rank", *rounded("score"), _products_text()
    )


@query
def combined_recommendations(ws: Workspace) -> DataFrame:
    rules = ws.mba.withColumnRenamed("item", "aisle_id")
    own = factor.recommend(ws.cluster_aisle_svd, 5).drop("cluster")
    listed = recommend.cluster_first(own, ws.svd_aisles)
    svd = listed.select("user_id", F.col("item").alias("aisle_id"), "score")
    out = recommend.blend(rules, svd).join(ws.view.aisles, "aisle_id", "left")
    name = recommend.name_or("aisle", "Aisle", "aisle_id").alias("aisle_name")
    # The place of an aisle in the user's list, best mean score first.
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("combined_score", 6)), "aisle_id")
    out = out.withColumn("rank", F.row_number().over(order))
    scores = ("mba_score", "mba_confidence", "mba_lift", "svd_score", "combined_score")
    return out.select(
        "user_id", "aisle_id", name, "rank", F.array_join("sources", ",").alias("sources"), *rounded(*scores)
    )


@query
def other_aisles(ws: Workspace) -> DataFrame:
    listed = ws.mba.select("user_id", F.col("item").alias("aisle_id"))
    return recommend.other_aisles(ws.user_clusters, ws.view.aisles, listed)


@query
def user_aisle_products(ws: Workspace) -> DataFrame:
    requests = ws.mba.select("user_id", F.col("item").alias("aisle_id"))
    return recommend.aisle_products(ws.user_lines, ws.view.products, requests)


def _bought_together(ws: Workspace, keep: str) -> DataFrame:
    rows = recommend.bought_together(ws.cluster_rules.rules, keep=keep)
    return rows.select(
        "cluster", "product", "item", "rank", *rounded("confidence", "lift", "support", "score")
    )


@query
def bought_together(ws: Workspace) -> DataFrame:
    return _bought_together(ws, "best")


@query
def bought_together_keep_last(ws: Workspace) -> DataFrame:
    return _bought_together(ws, "last")


@query
def cluster_product_rules(ws: Workspace) -> DataFrame:
    return _rules(ws.product_rules.rules, "cluster")


@query
def product_page_bought_together(ws: Workspace) -> DataFrame:
    """Every user whose id ASKED divides opens the pages of the products they bought."""
    requests = recommend.user_items(ws.user_lines, "product_id", ws.asked_users)
    rows = recommend.bought_together_for(
        requests.withColumnRenamed("item", "product_id"), ws.user_clusters, ws.product_rules.rules, ws.star
    )
    return rows.select(
        "user_id", "asked_id", "cluster", "rank", "product_id", "product_name",
        *rounded("confidence", "lift", "support", "score"),
    )


@query
def last_login(ws: Workspace) -> DataFrame:
    return recommend.last_login(ws.view.logins)


@query
def carts_opened(ws: Workspace) -> DataFrame:
    return recommend.carts_opened(ws.view.logins)


# --- search -------------------------------------------------------------------------------


@query
def search_tokens(ws: Workspace) -> DataFrame:
    words = F.array_join(tokens(F.col("text")), " ").alias("tokens")
    return ws.product_docs.select(F.col("doc_id").alias("product_id"), words)


@query
def tfidf_weights(ws: Workspace) -> DataFrame:
    return ws.product_index.weights.select(
        F.col("doc_id").alias("product_id"), "term", *rounded("weight")
    )


@query
def search_nlp(ws: Workspace) -> DataFrame:
    found = search.scores(ws.product_index, ws.searches(PRODUCT_SEARCHES))
    return found.select("query_id", F.col("doc_id").alias("product_id"), *rounded("nlp_score"))


def _product_search(ws: Workspace) -> DataFrame:
    asked = ws.searches(PRODUCT_SEARCHES)
    found = search.query(ws.product_index, ws.product_docs, asked)
    # Query q is asked by the q-th of the users with most lines.
    users = ws.top_users.agg(F.array_sort(F.collect_list("user_id"))).scalar()
    asking = asked.select("query_id", users[F.col("query_id") - 1].alias("user_id"))
    bought = recommend.user_items(ws.user_lines, "product_id").join(asking, "user_id")
    return search.products(found, ws.star, bought.select("query_id", F.col("item").alias("doc_id")))


@query
def search_products(ws: Workspace) -> DataFrame:
    return _product_search(ws).select(
        "query_id", "rank", "product_id", "product_name", "aisle", "department",
        "previously_bought", *rounded("nlp_score", "svd_score", "combined_score"),
    )


@query
def search_totals(ws: Workspace) -> DataFrame:
    """Results and shelves per search, as the head of the result page shows them."""
    return _product_search(ws).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_results"), F.countDistinct("aisle").alias("n_aisles")
    )


@query
def search_by_aisle(ws: Workspace) -> DataFrame:
    rows = search.by_aisle(_product_search(ws))
    return rows.withColumn("product_names", F.array_join("product_names", ","))


@query
def search_products_personal(ws: Workspace) -> DataFrame:
    """Every user whose id ASKED divides asks the first search; the segment model's list joins the score."""
    text = PRODUCT_SEARCHES[0][1]
    users = cut(ws.asked_users)
    asked = users.select(F.col("user_id").alias("query_id"), F.lit(text).alias("text"))
    listed = factor.recommend(ws.product_svd, search.SVD_LIST, users=users)
    svd = listed.select(
        F.col("user_id").alias("query_id"),
        F.col("item").alias("doc_id"),
        F.col("score").alias("svd_score"),
    )
    found = search.query(ws.product_index, ws.product_docs, asked, svd=svd)
    mine = recommend.user_items(ws.user_lines, "product_id", users)
    bought = mine.select(F.col("user_id").alias("query_id"), F.col("item").alias("doc_id"))
    return search.products(found, ws.star, bought)


@query
def document_terms(ws: Workspace) -> DataFrame:
    return ws.document_index.terms.select("term", "df", *rounded("idf"))


@query
def document_search(ws: Workspace) -> DataFrame:
    found = search.query(ws.document_index, ws.documents, ws.searches(DOCUMENT_SEARCHES))
    return found.select("query_id", "doc_id", "rank", *rounded("nlp_score", "combined_score"))
