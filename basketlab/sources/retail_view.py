"""The retail tables derived from star-schema order data (part, orders, lineitem, events)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.functions.position import number_in_group
from basketlab.session import cut
from basketlab.sources.tables import Retail


class RetailView:
    """Lazy tables over one folder of parquet files. Only the columns used are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _dimension(self, column: str, id_name: str, name: str) -> DataFrame:
        """Dense ids by name. The domain is the short fixed list of brands / types."""
        values = self.source("part").select(F.col(column).alias(name)).distinct()
        ids = F.row_number().over(Window.orderBy(name)).cast("long")
        return values.select(ids.alias(id_name), name)

    @cached_property
    def aisles(self) -> DataFrame:
        return self._dimension("p_brand", "aisle_id", "aisle")

    @cached_property
    def departments(self) -> DataFrame:
        return self._dimension("p_type", "department_id", "department")

    @cached_property
    def star(self) -> DataFrame:
        """Products with their names, each name joined to its id once."""
        part = self.source("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("aisle"),
            F.col("p_type").alias("department"),
        )
        return (
            part.join(self.aisles, "aisle")
            .join(self.departments, "department")
            .select(
                "product_id", "product_name", "aisle_id", "department_id", "aisle", "department"
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.star.select("product_id", "product_name", "aisle_id", "department_id")

    @cached_property
    def orders(self) -> DataFrame:
        base = self.source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("at"),
        )
        numbered = number_in_group(base, "user_id", "at", "order_id")
        last = F.col("number") == F.col("total")
        # Written once: features, models and lists all read the numbered orders.
        return cut(numbered.select(
            "order_id",
            "user_id",
            F.when(last, "train").otherwise("prior").alias("eval_set"),
            F.col("number").alias("order_number"),
            (F.dayofweek("at") - 1).alias("order_dow"),
            F.hour("at").alias("order_hour_of_day"),
            F.datediff("at", "previous").cast("double").alias("days_since_prior_order"),
        ))

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines without the reorder flag, which costs an extra aggregation."""
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("add_to_cart_order"),
        )

    @cached_property
    def order_products(self) -> DataFrame:
        owned = self.lines.join(
            self.orders.select("order_id", "user_id", "order_number"), "order_id"
        )
        first = owned.groupBy("user_id", "product_id").agg(
            F.min("order_number").alias("first_number")
        )
        flag = (F.col("order_number") > F.col("first_number")).cast("int")
        return owned.join(first, ["user_id", "product_id"]).select(
            "order_id", "product_id", "add_to_cart_order", flag.alias("reordered")
        )

    @cached_property
    def retail(self) -> Retail:
        return Retail(
            self.aisles, self.departments, self.products, self.orders, self.order_products
        )

    @cached_property
    def logins(self) -> DataFrame:
        """Login trail: sign-up events stand in for logins."""
        return self.source("events").where(F.col("event_type") == "signup").select(
            "user_id", F.col("ts").alias("at")
        )
