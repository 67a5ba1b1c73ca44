"""Fitted models as folders of parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(tables: dict[str, DataFrame], folder: str, params: dict | None = None) -> None:
    """One sub-folder per table; parameters as a one-row text table beside them."""
    if not tables:
        raise ValueError("nothing to save: fit the model first")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({"tables": sorted(tables), "params": params or {}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{folder}/_model"
    )


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and parameters written by :func:`save`."""
    meta = json.loads(spark.read.text(f"{folder}/_model").first()[0])
    return (
        {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]},
        meta["params"],
    )
