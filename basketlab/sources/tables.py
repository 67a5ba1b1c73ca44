"""The five retail tables: schemas, readers, writers."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.session import cut


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


SCHEMAS: dict[str, T.StructType] = {
    "aisles": _schema(("aisle_id", T.LongType()), ("aisle", T.StringType())),
    "departments": _schema(("department_id", T.LongType()), ("department", T.StringType())),
    "products": _schema(
        ("product_id", T.LongType()),
        ("product_name", T.StringType()),
        ("aisle_id", T.LongType()),
        ("department_id", T.LongType()),
    ),
    "orders": _schema(
        ("order_id", T.LongType()),
        ("user_id", T.LongType()),
        ("eval_set", T.StringType()),
        ("order_number", T.IntegerType()),
        ("order_dow", T.IntegerType()),
        ("order_hour_of_day", T.IntegerType()),
        ("days_since_prior_order", T.DoubleType()),
    ),
    "order_products": _schema(
        ("order_id", T.LongType()),
        ("product_id", T.LongType()),
        ("add_to_cart_order", T.IntegerType()),
        ("reordered", T.IntegerType()),
    ),
}

# Columns that a complete row may lack.
MAY_BE_NULL = {"days_since_prior_order"}

PRIMARY_KEYS = {
    "aisles": "aisle_id",
    "departments": "department_id",
    "products": "product_id",
    "orders": "order_id",
}


@dataclass(frozen=True)
class Retail:
    aisles: DataFrame
    departments: DataFrame
    products: DataFrame
    orders: DataFrame
    order_products: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV with a header; quotes inside quoted text are doubled. Types come from the schema."""
    return (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_checked(spark: SparkSession, path: str, table: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of a CSV file, and the rejected ones with ``cause`` and the ``line`` as it stood.

    ``malformed``: fields that are too few, too many or not of their type. ``missing value``: no value
    where the schema needs one. Nothing else is dropped, so both counts add up to the lines read.
    """
    schema = T.StructType([*SCHEMAS[table].fields, T.StructField("line", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "line")
        .csv(path)
    )
    needed = [f.name for f in SCHEMAS[table].fields if f.name not in MAY_BE_NULL]
    missing = reduce(or_, [F.col(c).isNull() for c in needed])
    cause = F.when(F.col("line").isNotNull(), "malformed").when(missing, "missing value")
    # Parsed once: what a line is rejected for is known only after all its fields were read.
    checked = cut(rows.withColumn("cause", cause))
    accepted = checked.where("cause is null").drop("cause", "line")
    return accepted, checked.where("cause is not null")


def read(spark: SparkSession, folder: str, fmt: str = "parquet") -> Retail:
    """All five tables from ``folder/<table>`` (parquet) or ``folder/<table>.csv``."""
    if fmt == "csv":
        return Retail(**{t: read_csv(spark, f"{folder}/{t}.csv", t) for t in SCHEMAS})
    return Retail(
        **{t: spark.read.schema(SCHEMAS[t]).parquet(f"{folder}/{t}") for t in SCHEMAS}
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``df`` cast, ordered and named as the table's schema says."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def write(retail: Retail, folder: str, fmt: str = "parquet") -> None:
    """Bulk load: every table, cast to its schema, in one write each."""
    for name, df in retail.named().items():
        target = f"{folder}/{name}" if fmt == "parquet" else f"{folder}/{name}.csv"
        write_table(conform(df, name), target, fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_sorted(df: DataFrame, path: str, key: str = "order_id", fmt: str = "parquet") -> None:
    """Files hold ascending, non-overlapping key ranges, each file sorted inside."""
    write_table(df.repartitionByRange(key).sortWithinPartitions(key), path, fmt)


def register(retail: Retail, database: str, bucket_lines_by: int | None = None) -> None:
    """Save as catalog tables. With ``bucket_lines_by`` the two large tables are bucketed on
    order_id, so their join needs no shuffle."""
    for name, df in retail.named().items():
        writer = conform(df, name).write.mode("overwrite")
        if bucket_lines_by and name in ("orders", "order_products"):
            writer = writer.bucketBy(bucket_lines_by, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{name}")


def merge_prior_train(prior: DataFrame, train: DataFrame) -> DataFrame:
    return prior.unionByName(train)


def star(retail: Retail) -> DataFrame:
    """Products with their aisle and department names."""
    return (
        retail.products.join(retail.aisles, "aisle_id")
        .join(retail.departments, "department_id")
        .select(
            "product_id", "product_name", "aisle_id", "department_id", "aisle", "department"
        )
    )
