"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into phrases (LZ78): each is the longest phrase seen before plus one
byte. The set of phrases, hashed, gives a SuperMinHash signature of ``REGISTERS`` values of 16 bits;
the share of equal values estimates how much dictionary two texts share, as compressing them
together would.

``neighbour_report`` compares each document with an edited copy and with the next document in
descending order of id (the first follows the last). Documents are dealt to ranges of ids; the first
of each range is also sent, marked, to the range before it, so a task reads its rows one by one and
keeps two of them. An edited text shares its first part with the original, which is parsed once.

Null and empty texts have no phrases: all their registers are equal, so two of them are alike by 1.
Repeated ids stand next to each other, in order of a hash of the text; null ids come last. A single
document is its own next one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.common import mix
from basketlab.llm.near_dedup import super_minhash

REGISTERS = 128
# Ranges of ids per shuffle partition, so that partitions hold about as much as each other.
RANGES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Parser:
    """An LZ78 parse that can be continued: phrase ends and the dictionary so far."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.ends: list[int] = []
        self.node = 0
        self.length = 0

    def copy(self) -> Parser:
        other = Parser()
        other.next, other.ends = self.next.copy(), self.ends.copy()
        other.node, other.length = self.node, self.length
        return other

    def feed(self, data: bytes) -> Parser:
        known, find, add, node = self.next, self.next.get, self.ends.append, self.node
        for at, byte in enumerate(data, self.length + 1):
            key = node << 8 | byte
            node = find(key, 0)
            if not node:
                known[key] = len(known) + 1
                add(at)
        self.node, self.length = node, self.length + len(data)
        return self


class Hasher:
    """Hashes of the slices of a text, from prefix sums of a polynomial."""

    def __init__(self) -> None:
        self._grow(1 << 14)

    def _grow(self, size: int) -> None:
        self.powers = np.cumprod(np.full(size, _BASE, np.uint64))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.inverse = np.cumprod(np.full(size, inverse, np.uint64))

    def phrases(self, data: bytes, ends: list[int]) -> np.ndarray:
        if not ends:
            return np.empty(0, np.uint64)
        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        end = np.array(ends)
        start = np.concatenate(([0], end[:-1]))
        return mix((sums[end] - sums[start]) * self.inverse[start])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of 16 bits, one row per phrase set."""
    return (mix(super_minhash(sets, REGISTERS)) >> np.uint64(48)).astype("<u2")


def _text(row: np.ndarray) -> str:
    return base64.b64encode(row.tobytes()).decode()


def fingerprint(texts: list[str | None]) -> list[str]:
    """Fingerprints of whole texts."""
    hasher, sets = Hasher(), []
    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        sets.append(hasher.phrases(data, Parser().feed(data).ends))
    return [_text(row) for row in signatures(sets)]


def likeness(a: str, b: str) -> float:
    """Share of equal registers of two fingerprints."""
    x, y = (np.frombuffer(base64.b64decode(v), "<u2") for v in (a, b))
    return float((x == y).mean())


_OUT = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]


def _walk(rows: Iterator[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sentinel, doc_id, text) in order -> results of all that are no sentinels."""
    hasher = Hasher()
    own: list[tuple] = []  # (doc_id, n_chars, sha, phrases, edited phrases), then a last (phrases)
    before = None  # (bucket, doc_id, text, phrases, parser of the first part, its bytes)

    def emit(last: np.ndarray) -> pa.RecordBatch:
        values = signatures([r[3] for r in own] + [last])
        edited = signatures([r[4] for r in own])
        # The next document of a row is the next row, or what follows the last one.
        follow = np.array([k if r[5] is None else -1 for k, r in enumerate(own, 1)])
        others = signatures([r[5] for r in own if r[5] is not None])
        following = values[follow].copy()
        following[follow < 0] = others
        columns = [
            [r[0] for r in own],
            [r[1] for r in own],
            [r[2] for r in own],
            [_text(v) for v in values[:-1]],
            [_text(v) for v in edited],
            (values[:-1] == edited).mean(axis=1),
            (values[:-1] == following).mean(axis=1),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(columns, _OUT)], names=[n for n, _ in _OUT]
        )

    def parsed(text: str) -> tuple[np.ndarray, Parser, bytes]:
        head = text[: len(text) - len(text) // 3].encode("utf-8", "replace")
        parser = Parser().feed(head)
        data = text.encode("utf-8", "replace")
        whole = parser.copy().feed(data[len(head) :])
        return hasher.phrases(data, whole.ends), parser, head

    def finish(row: tuple, text: str, phrases: np.ndarray, inside: bool) -> None:
        _, doc_id, mine, known, parser, head = row
        data = head + text[: len(mine) // 3].encode("utf-8", "replace")
        edited = hasher.phrases(data, parser.feed(data[len(head) :]).ends)
        own.append((doc_id, len(mine), hashlib.sha256(data).hexdigest(), known, edited, None if inside else phrases))

    done = None
    for bucket, sentinel, doc_id, text in rows:
        if sentinel and bucket == done:
            continue
        text = text or ""
        now = (bucket, doc_id, text, *parsed(text))
        if before is not None and before[0] == bucket:
            finish(before, text, now[3], not sentinel)
        if sentinel:
            done, before = bucket, None
        else:
            before = now
        if len(own) >= size:
            yield emit(now[3])
            own.clear()
    if own:
        yield emit(np.empty(0, np.uint64))


def _in_ranges(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` with ``bucket``: ranges of doc_id in descending order, rows without an id last.

    The bounds are searched by halves in the JVM and are no literals of the plan.
    """
    if not cuts:
        return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_range", handleInvalid="keep")
    known = F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))
    ranged = split.transform(rows.withColumn("_id", known))
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("_range")).cast("int")
    return ranged.select(*rows.columns, bucket.alias("bucket"))


def neighbour_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited copy, and its likeness to that and to the next one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where("doc_id is not null").approxQuantile(
        "doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges
    )
    rows = _in_ranges(rows, sorted({float(c) for c in cuts}))
    heads = {r.bucket: r.top for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(heads)
    # The first row of each range but the first also goes, as a sentinel, to the range before it
    # (that of the first to the last, whose last document it follows). One row per range.
    marks = spark.createDataFrame(
        [(b, heads[b], order[k - 1]) for k, b in enumerate(order)], "bucket int, top long, to int"
    )
    entry = F.struct(F.xxhash64("text").alias("h"), "text")
    sentinels = (
        rows.join(F.broadcast(marks), "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("to", "doc_id")
        .agg(F.min(entry).alias("first"))
        .select("doc_id", F.col("first.text").alias("text"), F.col("to").alias("bucket"), F.lit(1).alias("sentinel"))
    )
    dealt = rows.select("doc_id", "text", "bucket", F.lit(0).alias("sentinel")).unionByName(sentinels)
    partitions = max(1, -(-ranges // RANGES))
    dealt = dealt.repartition(partitions, "bucket").sortWithinPartitions(
        "bucket", "sentinel", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(
                    batch["bucket"].to_pylist(),
                    batch["sentinel"].to_pylist(),
                    batch["doc_id"].to_pylist(),
                    batch["text"].to_pylist(),
                )

        return _walk(each())

    return dealt.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
