"""Rules the relational schema implies, as one report row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.sources.tables import PRIMARY_KEYS, Retail

# Longest text the schema allows, foreign keys, the one nullable column.
TEXT_LIMITS = {
    ("aisles", "aisle"): 100,
    ("departments", "department"): 100,
    ("products", "product_name"): 200,
    ("orders", "eval_set"): 20,
}
FOREIGN_KEYS = [
    ("products", "aisle_id", "aisles"),
    ("products", "department_id", "departments"),
    ("order_products", "order_id", "orders"),
    ("order_products", "product_id", "products"),
]
NULLABLE = {("orders", "days_since_prior_order")}


def integrity_report(retail: Retail) -> DataFrame:
    """(rule, violations) for unique keys, references, lengths and missing values.

    Nulls and lengths of a table come from one pass; a reference check joins the distinct
    foreign ids only, so a heavily used id costs nothing extra.
    """
    tables = retail.named()
    reports = []
    for name, key in PRIMARY_KEYS.items():
        repeats = tables[name].groupBy(key).count().where(F.col("count") > 1)
        reports.append(_one(repeats, f"unique:{name}.{key}"))
    for child, key, parent in FOREIGN_KEYS:
        used = tables[child].select(key).where(F.col(key).isNotNull()).groupBy(key).count()
        orphans = used.join(tables[parent].select(key), key, "left_anti")
        total = orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
        rule = F.lit(f"reference:{child}.{key}").alias("rule")
        reports.append(total.select(rule, "violations"))
    for name, df in tables.items():
        checks = {
            f"missing:{name}.{c}": F.col(c).isNull()
            for c in df.columns
            if (name, c) not in NULLABLE
        }
        for (table, c), limit in TEXT_LIMITS.items():
            if table == name:
                checks[f"length:{name}.{c}"] = F.length(c) > limit
        counts = df.agg(*[F.count(F.when(bad, 1)).alias(rule) for rule, bad in checks.items()])
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations"))
                    for r in checks
                ]
            )
        )
        reports.append(counts.select(pairs.alias("r")).select("r.rule", "r.violations"))
    return reduce(DataFrame.unionByName, reports)


def _one(violating: DataFrame, rule: str) -> DataFrame:
    return violating.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )
