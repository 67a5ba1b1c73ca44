"""Shared inputs and fitted models over one data folder, built on first use."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.operators import baskets, clean, factor, recommend, rules_eval, search, segment
from basketlab.session import cut, drop_cuts, tune
from basketlab.sources import tables
from basketlab.sources.retail_view import RetailView

# Fixed segment centres in scaled feature space (a segmentation any engine can repeat).
CENTROIDS = [(-0.5, 0.8, 0.5), (1.2, -0.9, -0.8), (-0.2, 1.0, 1.3), (-0.4, -0.4, -0.4)]

# Thresholds at which the test data yields rules.
DEPARTMENT_RULES = {"min_support": 0.05, "min_lift": 0.9}
AISLE_RULES = {"min_support": 0.01, "min_lift": 1.0}
CLUSTER_RULES = {"min_support": 0.005, "min_lift": 1.0}
PRODUCT_RULES = {"min_support": 0.0005, "min_lift": 1.0, "min_count": 2}
# Requests: every user or product whose id this divides.
ASKED = 50

# What visitors type into the search box.
PRODUCT_SEARCHES = [
    (1, "small ring"),
    (2, "Blue BOLT economy"),
    (3, "brand 13 widget and gear"),
    (4, "the of unknownword"),
]
DOCUMENT_SEARCHES = [
    (1, "ering tion nter ndre"),
    (2, "éeau des leaux avec"),
    (3, "privacy license email address"),
]


class Workspace:
    """Cheap results stay lazy. Models are fitted once, stored, and read by later queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.view = RetailView(spark, folder)

    def close(self) -> int:
        """Delete the tables this session wrote; results that read them must be finished."""
        return drop_cuts(self.spark)

    # inputs
    @cached_property
    def stored(self) -> tables.Retail:
        """The retail tables for reports that scan a table several times: the derived one is written."""
        return replace(self.view.retail, order_products=cut(self.view.order_products))

    @cached_property
    def clean_orders(self) -> DataFrame:
        return clean.orders_global(self.view.orders)

    @cached_property
    def user_lines(self) -> DataFrame:
        """Written once: rules, factors and lists all start from these lines."""
        return cut(baskets.user_lines(self.view.lines, self.clean_orders, self.view.products))

    @cached_property
    def star(self) -> DataFrame:
        return self.view.star

    @cached_property
    def rfm(self) -> DataFrame:
        """One row per user, written once: its moments and its rows are read by turns."""
        return cut(segment.rfm(self.view.orders, self.view.lines))

    @cached_property
    def scaled(self) -> DataFrame:
        return segment.scale(self.rfm)

    @cached_property
    def segments(self) -> DataFrame:
        return segment.assign(self.scaled, CENTROIDS)

    @cached_property
    def user_clusters(self) -> DataFrame:
        """Stored once, as the batch segmentation stores its table for the models."""
        return cut(self.segments.select("user_id", *segment.FEATURES, "cluster"))

    @cached_property
    def order_arrays(self) -> DataFrame:
        return recommend.item_arrays(self.user_lines, "aisle_id", "user_id", "order_id")

    @cached_property
    def user_arrays(self) -> DataFrame:
        return recommend.item_arrays(self.user_lines, "aisle_id", "user_id")

    # rule models
    @cached_property
    def department_rules(self) -> baskets.RuleModel:
        return baskets.fit_rules(
            baskets.baskets(self.user_lines, "department_id"), **DEPARTMENT_RULES
        )

    @cached_property
    def aisle_rules(self) -> baskets.RuleModel:
        return baskets.fit_rules(baskets.baskets(self.user_lines, "aisle_id"), **AISLE_RULES)

    @cached_property
    def cluster_rules(self) -> baskets.RuleModel:
        rows = baskets.cluster_baskets(self.user_lines, self.user_clusters, "product_name")
        return baskets.fit_rules(rows, **CLUSTER_RULES, group_col="cluster")

    @cached_property
    def product_rules(self) -> baskets.RuleModel:
        """Per segment over product ids, as a product page asks for them."""
        rows = baskets.cluster_baskets(self.user_lines, self.user_clusters, "product_id")
        return baskets.fit_rules(rows, **PRODUCT_RULES, group_col="cluster")

    @cached_property
    def triggered(self) -> DataFrame:
        return recommend.triggered_rules(self.order_arrays, self.aisle_rules.rules)

    @cached_property
    def aisle_rule_counts(self) -> DataFrame:
        return cut(rules_eval.rule_counts(self.aisle_rules.rules, self.aisle_rules.test))

    # factor models
    @cached_property
    def aisle_counts(self) -> DataFrame:
        return factor.interaction_counts(self.user_lines, "aisle_id")

    @cached_property
    def aisle_svd(self) -> factor.SvdModel:
        return factor.fit_svd(self.aisle_counts, n_components=50)

    @cached_property
    def aisle_svd_rank10(self) -> factor.SvdModel:
        return factor.fit_svd(self.aisle_counts, n_components=10)

    @cached_property
    def product_svd(self) -> factor.SvdModel:
        ratings = factor.cluster_ratings(self.user_lines, self.user_clusters)
        return factor.fit_svd(ratings, n_components=50, group_col="cluster")

    # recommendations
    @cached_property
    def mba(self) -> DataFrame:
        """Written once: the list a page serves and several pages build on."""
        return cut(
            recommend.by_rules(self.user_arrays, self.user_clusters, self.aisle_rules.rules)
        )

    @cached_property
    def svd_aisles(self) -> DataFrame:
        return factor.recommend(self.aisle_svd, 5)

    @cached_property
    def cluster_counts(self) -> DataFrame:
        return recommend.cluster_product_counts(self.user_lines, self.user_clusters)

    @cached_property
    def cluster_aisle_interactions(self) -> DataFrame:
        """Counts on the aisles the overall model puts in any list of ten of the segment."""
        people = self.user_clusters.select("user_id", "cluster")
        listed = factor.recommend(self.aisle_svd, 10).join(people, "user_id")
        keep = listed.select("cluster", "item").distinct()
        return self.aisle_counts.join(people, "user_id").join(keep, ["cluster", "item"], "left_semi")

    @cached_property
    def cluster_aisle_svd(self) -> factor.SvdModel:
        return factor.fit_svd(
            self.cluster_aisle_interactions, n_components=50, group_col="cluster", test_size=0.0
        )

    # search
    @cached_property
    def product_docs(self) -> DataFrame:
        return search.product_text(self.star)

    @cached_property
    def product_index(self) -> search.TextIndex:
        return search.stored(search.fit(self.product_docs))

    @cached_property
    def documents(self) -> DataFrame:
        return self.view.source("documents").select("doc_id", "text")

    @cached_property
    def document_index(self) -> search.TextIndex:
        return search.stored(search.fit(self.documents))

    def searches(self, rows: list[tuple[int, str]]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("text")) for i, t in rows])
        return self.spark.range(1).select(F.explode(cells).alias("q")).select("q.*")

    @cached_property
    def asked_users(self) -> DataFrame:
        """Request table: every user with lines whose id ASKED divides."""
        return self.aisle_counts.select("user_id").distinct().where(F.col("user_id") % ASKED == 0)

    @cached_property
    def top_users(self) -> DataFrame:
        """The visitors who type PRODUCT_SEARCHES are the first of the 20 users with most lines."""
        totals = self.aisle_counts.groupBy("user_id").agg(F.sum("value").alias("n"))
        return cut(totals.orderBy(F.desc("n"), F.asc("user_id")).limit(20).select("user_id"))


_current: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per session and folder, so a model is fitted once and then served."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _current:
        _current.clear()
        _current[key] = Workspace(spark, folder)
    return _current[key]
