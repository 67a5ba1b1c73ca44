"""Helpers the text operators share: words as bytes, word hashes, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.session import cut as cut_base
from basketlab.session import tune as tune_base

# Rows of an Arrow batch: about 3 MB of ordinary documents, so a worker stays small.
BATCH_ROWS = 1000
# Distinct words a worker remembers the hash of before it starts afresh.
CACHED_WORDS = 1 << 18


def tune(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches, skew joins split."""
    tune_base(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its own shuffle files go at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut_base(df)
    finally:
        conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a table :func:`cut` wrote and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        target = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


# Letters, digits and every byte of a non-ASCII character stay, A-Z become a-z, the rest parts words.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-case words of letters, digits and non-ASCII characters."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= STEP
        out += words[k : k + n]
    return mix(out)


def add_columns(
    df: DataFrame,
    fn: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    fields: list[tuple[str, T.DataType]],
) -> DataFrame:
    """``df`` with columns a function computes from each Arrow batch; no shuffle.

    ``fn`` is called once per task and returns the function of a batch. A column of the same
    name is replaced.
    """
    names = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            old = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays([*old, *work(batch)], names=schema.names)

    return df.mapInArrow(run, schema)


def keeping(docs: DataFrame, names: tuple[str, ...], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn(docs)`` with the columns of ``docs`` alone; own columns called like ``names`` survive it."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    done = fn(docs.withColumnsRenamed(own))
    return done.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def byte_list(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string or binary column as bytes; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
