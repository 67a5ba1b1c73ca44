"""Customer pages as batch queries: every function serves all users in one job, or only those
in a ``users`` / ``requests`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.topk import top_per_group
from basketlab.operators import segment
from basketlab.operators.rules_eval import match_rules

# Weight of confidence and lift by segment; any other segment takes OTHER.
CLUSTER_WEIGHTS = {
    0: (0.6, 0.5),
    1: (0.4, 0.4),
    2: (0.3, 0.8),
    3: (0.5, 0.6),
}
OTHER_WEIGHTS = (0.5, 0.5)
_OTHER = -1


def only(df: DataFrame, users: DataFrame | None) -> DataFrame:
    """Rows of the requested users; all rows without a request table."""
    if users is None:
        return df
    return df.join(users.select("user_id").distinct(), "user_id", "left_semi")


def name_or(name: str, prefix: str, id_col: str) -> Column:
    return F.coalesce(F.col(name), F.concat(F.lit(f"{prefix} "), F.col(id_col).cast("string")))


# --- customer card, history, logins -------------------------------------------------------


def validate_user_ids(typed: DataFrame, orders: DataFrame) -> DataFrame:
    """``typed`` (typed string) with user_id and status ok / unknown_user / not_a_number."""
    parsed = typed.withColumn("user_id", F.expr("try_cast(trim(typed) AS BIGINT)"))
    known = orders.select("user_id").distinct().withColumn("_known", F.lit(True))
    status = (
        F.when(F.col("user_id").isNull(), "not_a_number")
        .when(F.col("_known"), "ok")
        .otherwise("unknown_user")
    )
    return parsed.join(known, "user_id", "left").select("typed", "user_id", status.alias("status"))


def user_card(segments: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Segment, its text, the three features and the figures shown with them."""
    return only(segments, users).select(
        "user_id",
        "cluster",
        segment.description("cluster", segment.CARD_DESCRIPTIONS).alias("description"),
        "recency",
        "frequency",
        "monetary",
        F.col("frequency").cast("int").alias("total_orders"),
        (F.col("monetary") / F.col("frequency")).alias("avg_order_value"),
        F.col("recency").cast("int").alias("days_since_last"),
    )


def user_items(user_lines: DataFrame, item_col: str, users: DataFrame | None = None) -> DataFrame:
    """Distinct (user_id, item)."""
    return only(user_lines, users).select("user_id", F.col(item_col).alias("item")).distinct()


def order_history(
    orders: DataFrame, user_lines: DataFrame, aisles: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """One row per order with the sorted names of its aisles (empty for an order without lines)."""
    names = (
        user_lines.select("order_id", "aisle_id")
        .distinct()
        .join(aisles, "aisle_id", "left")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set(name_or("aisle", "Aisle", "aisle_id"))).alias("aisles"))
    )
    empty = F.array().cast("array<string>")
    return (
        only(orders, users)
        .join(names, "order_id", "left")
        .select(
            "user_id",
            "order_id",
            "order_number",
            "order_dow",
            F.col("order_hour_of_day").alias("order_hour"),
            F.coalesce("aisles", empty).alias("aisles"),
        )
    )


def last_login(logins: DataFrame) -> DataFrame:
    return logins.groupBy("user_id").agg(F.max("at").alias("last_login"))


def carts_opened(logins: DataFrame) -> DataFrame:
    return logins.select("user_id", F.col("at").alias("created_at"))


# --- rules at work ------------------------------------------------------------------------


def item_arrays(user_lines: DataFrame, item_col: str, *keys: str) -> DataFrame:
    """Array of distinct items per key. Use a dimension with few members (aisles)."""
    item = F.col(item_col).alias("item")
    return (
        user_lines.select(*keys, item).distinct().groupBy(*keys).agg(F.collect_set("item").alias("items"))
    )


def triggered_rules(order_arrays: DataFrame, rules: DataFrame) -> DataFrame:
    """(user_id, order_id, rule): all antecedents and at least one consequent in the order."""
    kept = rules.select(
        "antecedents", "consequents", "anchor", "confidence", "lift", "support"
    )
    return (
        match_rules(order_arrays, kept)
        .where(F.arrays_overlap("consequents", "items"))
        .drop("items")
    )


def user_rules(triggered: DataFrame) -> DataFrame:
    return triggered.select("user_id", "antecedents", "consequents").distinct()


def rule_summary(triggered: DataFrame) -> DataFrame:
    return user_rules(triggered).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_rules_triggered")
    )


def _rule_text() -> Column:
    sides = [F.array_join(F.col(c).cast("array<string>"), ",") for c in ("antecedents", "consequents")]
    return F.concat_ws(">", *sides)


def rule_names(rules: DataFrame, dimension: DataFrame, id_col: str, name_col: str, default: str) -> DataFrame:
    """Each distinct rule with the names of its sides, in the order of their ids.

    Names meet the rules, not their many matches; an id without a name reads ``<default> <id>``.
    """
    keys = rules.select("antecedents", "consequents").distinct()
    out = keys
    for side in ("antecedents", "consequents"):
        sets = keys.select(side).distinct()
        parts = sets.select(side, F.posexplode(side).alias("pos", id_col)).join(dimension, id_col, "left")
        name = name_or(name_col, default, id_col)
        named = parts.groupBy(side).agg(F.sort_array(F.collect_list(F.struct("pos", name.alias("name")))).alias("n"))
        names = F.transform("n", lambda x: x["name"]).alias(side[:-1] + "_names")
        out = out.join(named.select(side, names), side)
    return out


def rule_list(triggered: DataFrame, names: DataFrame) -> DataFrame:
    """(user_id, antecedents, consequents and their names): each rule once per user."""
    return user_rules(triggered).join(names, ["antecedents", "consequents"])


def with_triggered_rules(history: DataFrame, triggered: DataFrame) -> DataFrame:
    """``history`` (one row per order) with ``n_rules`` and ``rules``, the sorted texts of the rules it triggers."""
    found = triggered.groupBy("order_id").agg(F.sort_array(F.collect_list(_rule_text())).alias("rules"))
    empty = F.array().cast("array<string>")
    joined = history.join(found, "order_id", "left").withColumn("rules", F.coalesce("rules", empty))
    return joined.withColumn("n_rules", F.size("rules"))


def _scored_rules(rules: DataFrame) -> DataFrame:
    """Each rule once per set of weights, with its score and its place among all rules there."""
    sets = [*((c, *w) for c, w in CLUSTER_WEIGHTS.items()), (_OTHER, *OTHER_WEIGHTS)]
    weights = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("weights_of"),
                    F.lit(a).alias("weight_confidence"),
                    F.lit(b).alias("weight_lift"),
                )
                for c, a, b in sets
            ]
        )
    )
    scored = rules.select("*", weights.alias("w")).select("*", "w.*").drop("w")
    score = F.col("confidence") * F.col("weight_confidence") + F.col("lift") * F.col("weight_lift")
    order = Window.partitionBy("weights_of").orderBy(
        F.desc("score"), F.desc("combined_score"), "antecedents", "consequents"
    )
    return scored.withColumn("score", score).withColumn("place", F.row_number().over(order))


def by_rules(
    user_arrays: DataFrame,
    user_clusters: DataFrame,
    rules: DataFrame,
    n: int = 5,
    users: DataFrame | None = None,
) -> DataFrame:
    """Top ``n`` consequents of the rules whose antecedents the user has bought from.

    A rule's score depends on the user's segment only, so rules are ranked once per segment
    and the best rule per (user, item) is a plain minimum over that rank.
    """
    scored = _scored_rules(rules)
    weights_of = F.when(F.col("cluster").isin(list(CLUSTER_WEIGHTS)), F.col("cluster"))
    people = (
        only(user_arrays, users)
        .join(user_clusters.select("user_id", "cluster"), "user_id")
        .withColumn("weights_of", F.coalesce(weights_of, F.lit(_OTHER)).cast("int"))
    )
    light = scored.select("weights_of", "anchor", "antecedents", "consequents", "place")
    best = (
        match_rules(people, light, ["weights_of"])
        .withColumn("item", F.explode("consequents"))
        .groupBy("user_id", "cluster", "weights_of", "item")
        .agg(
            F.min("place").alias("place"),
            F.max(F.array_contains("items", F.col("item"))).alias("previously_bought"),
        )
    )
    detail = scored.select(
        "weights_of", "place", "confidence", "lift", "support", "score",
        "weight_confidence", "weight_lift",
    )
    rows = best.join(detail, ["weights_of", "place"]).drop("weights_of", "place")
    return top_per_group(rows, ["user_id"], [F.desc("score"), F.asc("item")], n)


def bought_together(
    rules: DataFrame,
    n: int = 5,
    keep: str = "best",
    group_col: str = "cluster",
    requests: DataFrame | None = None,
) -> DataFrame:
    """Per (segment, product): the ``n`` consequents of rules with the product among the
    antecedents, one row each. ``keep='last'`` keeps the weakest rule of a consequent."""
    pairs = rules.withColumn("product", F.explode("antecedents"))
    if requests is not None:
        pairs = pairs.join(requests.distinct(), [group_col, "product"], "left_semi")
    pairs = pairs.select(
        group_col, "product", F.explode("consequents").alias("item"), "antecedents", "consequents",
        "confidence", "lift", "support", F.col("combined_score").alias("score"),
    )
    first = F.desc("score") if keep == "best" else F.asc("score")
    one = top_per_group(
        pairs, [group_col, "product", "item"], [first, F.asc("antecedents"), F.asc("consequents")],
        1,
    ).drop("rank", "antecedents", "consequents")
    order = [F.desc("score"), F.asc("item")]
    return top_per_group(one, [group_col, "product"], order, n)


def bought_together_for(
    requests: DataFrame, user_clusters: DataFrame, rules: DataFrame, products: DataFrame, n: int = 5
) -> DataFrame:
    """For each requested (user_id, product_id): the products bought together with it in the
    user's segment, with names. ``rules`` are mined per segment over product ids."""
    asked = requests.distinct().join(user_clusters.select("user_id", "cluster"), "user_id")
    pages = asked.select("cluster", F.col("product_id").alias("product"))
    listed = bought_together(rules, n, requests=pages)
    name = name_or("product_name", "Product", "product_id").alias("product_name")
    return (
        asked.withColumnRenamed("product_id", "product")
        .join(listed, ["cluster", "product"])
        .withColumnRenamed("item", "product_id")
        .join(products.select("product_id", "product_name"), "product_id", "left")
        .select(
            "user_id", F.col("product").alias("asked_id"), "cluster", "rank", "product_id", name,
            "confidence", "lift", "support", "score",
        )
    )


# --- products -----------------------------------------------------------------------------


def product_detail(star: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested products with names; an unknown id gives no row."""
    return star.join(requests.select("product_id").distinct(), "product_id", "left_semi")


def cluster_product_counts(user_lines: DataFrame, user_clusters: DataFrame) -> DataFrame:
    """Lines per (cluster, aisle, product); counts are combined before they leave a task."""
    return (
        user_lines.select("user_id", "aisle_id", "product_id")
        .join(user_clusters.select("user_id", "cluster"), "user_id")
        .groupBy("cluster", "aisle_id", "product_id")
        .agg(F.count(F.lit(1)).alias("cluster_count"))
    )


def _by_count() -> Sequence[Column]:
    return [F.desc("cluster_count"), F.asc("product_id")]


def _named(top: DataFrame, products: DataFrame) -> DataFrame:
    """Names join the few rows left after the cut."""
    return top.join(products.select("product_id", "product_name"), "product_id")


def cluster_aisle_top_products(counts: DataFrame, products: DataFrame, n: int = 3) -> DataFrame:
    keys = ["cluster", "aisle_id"]
    return _named(top_per_group(counts, keys, _by_count(), n), products)


def cluster_top_sold(counts: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    top = top_per_group(counts, ["cluster"], _by_count(), n)
    return _named(top.drop("aisle_id"), products)


def with_top_products(recommended: DataFrame, top_products: DataFrame) -> DataFrame:
    """Recommendations (cluster, aisle_id, ...) with an array of the aisle's top products."""
    lists = top_products.groupBy("cluster", "aisle_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "product_id", "product_name", "cluster_count"))
        ).alias("top_products")
    )
    return recommended.join(lists, ["cluster", "aisle_id"], "left")


def aisle_products(
    user_lines: DataFrame, products: DataFrame, requests: DataFrame, n: int = 3
) -> DataFrame:
    """Per requested (user_id, aisle_id): top ``n`` products, bought ones at twice their count,
    all others at 1.

    Any bought product beats any other, and only products missing from the top n are filled
    from the aisle's lowest ids; n + (n - 1) of these are enough, so the aisle's whole range
    is never paired with every user.
    """
    asked = requests.select("user_id", "aisle_id").distinct()
    bought = (
        user_lines.join(asked, ["user_id", "aisle_id"], "left_semi")
        .groupBy("user_id", "aisle_id", "product_id")
        .agg((F.count(F.lit(1)) * 2).alias("score"))
    )
    first = top_per_group(
        products, ["aisle_id"], [F.asc("product_id")], 2 * n - 1
    ).select("aisle_id", "product_id")
    shelf = first.groupBy("aisle_id").agg(F.collect_list("product_id").alias("shelf"))
    filler = (
        asked.join(shelf, "aisle_id")
        .select("user_id", "aisle_id", F.explode("shelf").alias("product_id"))
        .withColumn("score", F.lit(1).cast("long"))
    )
    rows = (
        bought.unionByName(filler)
        .groupBy("user_id", "aisle_id", "product_id")
        .agg(F.max("score").alias("score"))
        .withColumn("previously_bought", F.col("score") > 1)
    )
    order = [F.desc("score"), F.desc("previously_bought"), F.asc("product_id")]
    top = top_per_group(rows, ["user_id", "aisle_id"], order, n)
    return _named(top, products)


# --- blending -----------------------------------------------------------------------------


def other_aisles(users: DataFrame, aisles: DataFrame, recommended: DataFrame) -> DataFrame:
    """Aisles not recommended to a user. The list of all aisles is one small array."""
    everything = aisles.agg(F.sort_array(F.collect_list("aisle_id"))).scalar()
    mine = recommended.groupBy("user_id").agg(F.collect_set("aisle_id").alias("mine"))
    empty = F.array().cast("array<bigint>")
    return (
        users.select("user_id")
        .distinct()
        .join(mine, "user_id", "left")
        .select(
            "user_id",
            F.explode(F.array_except(everything, F.coalesce("mine", empty))).alias("aisle_id"),
        )
    )


def blend(rules: DataFrame, svd: DataFrame) -> DataFrame:
    """Both lists per (user_id, aisle_id): mean of the scores that exist, with their sources.

    ``rules``: user_id, aisle_id, score, confidence, lift. ``svd``: user_id, aisle_id, score.
    A source that repeats an aisle counts once, at its best score.
    """
    keys = ["user_id", "aisle_id"]
    left = rules.groupBy(*keys).agg(
        F.max("score").alias("mba_score"),
        F.max_by("confidence", "score").alias("mba_confidence"),
        F.max_by("lift", "score").alias("mba_lift"),
        F.lit("MBA").alias("_a"),
    )
    right = svd.groupBy(*keys).agg(F.max("score").alias("svd_score"), F.lit("SVD").alias("_b"))
    both = left.join(right, keys, "full")
    sources = F.array_compact(F.array("_a", "_b"))
    total = F.coalesce("mba_score", F.lit(0.0)) + F.coalesce("svd_score", F.lit(0.0))
    return both.select(
        *keys,
        sources.alias("sources"),
        "mba_score",
        "mba_confidence",
        "mba_lift",
        "svd_score",
        (total / F.size(sources)).alias("combined_score"),
    )


def cluster_first(cluster_list: DataFrame, base_list: DataFrame) -> DataFrame:
    """The segment model's list where a user has one, the overall model's list elsewhere."""
    missing = base_list.join(cluster_list.select("user_id").distinct(), "user_id", "left_anti")
    return cluster_list.withColumn("cluster_specific", F.lit(True)).unionByName(
        missing.withColumn("cluster_specific", F.lit(False))
    )
