"""The login trail kept up to date as logins arrive: last login per user, one cart per login."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketlab.operators.recommend import carts_opened


def keep_last_login(logins: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's latest login per user as a new part of the table at ``path``.

    Parts are addressed by batch id, so a batch that runs again after a failure replaces its
    own part. :func:`read_last_login` folds the parts.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("user_id").agg(F.max("at").alias("last_login"))
        latest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        logins.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_last_login(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(F.max("last_login").alias("last_login"))


def open_carts(logins: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append one cart row per login."""
    return (
        carts_opened(logins)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
