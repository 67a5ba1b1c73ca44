"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
}


# Let AQE split a hot join key even where that costs a later exchange: without the last
# setting a hot order stays in one task when a distinct on (order, item) follows its join.
SKEW = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Trim each map task to the top n of a group before the shuffle, for any n in use.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def build(app: str = "basketlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tuned for; a cluster's own settings win.

    Shuffle partitions start high and AQE merges them back, so the same code suits a
    laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **SKEW,
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the skew settings to a session made elsewhere."""
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, else one in the session's warehouse.

    Both are shared by driver and executors; a machine's own temporary folder is never used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/cuts").rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, deleted by :func:`drop_cuts`."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the files.

    Lost executors cost nothing that was computed before the cut, later scans prune columns,
    and the known file size lets Spark choose between broadcast and shuffle joins.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished results: it does so when the driver collects garbage."""
    spark._jvm.System.gc()


# Folders of new_folder, by application, so that they can be deleted together.
_written: dict[str, list[str]] = {}


def drop_cuts(spark: SparkSession) -> int:
    """Delete what :func:`cut` wrote in this session. DataFrames that still read it must be done."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation (no Python worker, size known to the planner)."""
    fields = [part.split() for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), type=_ARROW[t]) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))
