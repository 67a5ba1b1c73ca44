"""Merkle fixity audit of web archives.

Pages become WARC records; records stand in order of id in volumes of ``VOLUME`` ids, each at its
byte offset. Every replica is hashed on its own, into a tree:

* leaf: SHA-256 of a record's bytes;
* range: SHA-256 over the records that start in the same ``RANGE`` bytes of a volume, in order, each
  with its offset, so a moved record counts as damage too;
* volume: over its ranges; above it, ``FANOUT`` nodes to a parent, up to one root.

``audit`` compares the roots. Where they differ it goes down: at each level only children of nodes
that differ are compared, and at last only records of ranges that differ. Lost or added bytes shift
the rest of their volume, no other one. Record level joins touch damaged ranges alone, so a sound
replica costs one comparison of two rows.

A level's groups hold at most ``FANOUT`` nodes, a range's at most ``RANGE`` bytes of records.
Repeated rows (equal id and bytes) are one record with a number of copies, counted in its leaf, and
the copies share one offset. Null ids form a volume of their own; null urls and pages are empty.
Pages of one id and different bytes are records of their own, in order of their hash. Empty tables
have no root: two of them are alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.common import cut

VOLUME = 4096
RANGE = 1 << 16
FANOUT = 64


def record(page_id: Column, url: Column, body: Column) -> Column:
    """Bytes of a WARC resource record."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def manifest(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, volume, offset, length, copies, record_sha256, piece): one row per distinct record."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        record(F.col(page_id).cast("long"), F.col(url), F.col(body)).alias("bytes"),
    )
    rows = rows.select("page_id", F.sha2("bytes", 256).alias("record_sha256"), F.length("bytes").cast("long").alias("length"))
    rows = rows.groupBy("page_id", "record_sha256", "length").agg(F.count("*").alias("copies"))
    # Null ids have a volume number far below those in use.
    volume = F.coalesce(F.floor(F.col("page_id") / VOLUME), F.lit(-(1 << 20))).cast("long")
    rows = rows.withColumn("volume", volume)
    before = Window.partitionBy("volume").orderBy("page_id", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return rows.withColumn("piece", F.floor(F.col("offset") / RANGE).cast("long"))


def _digest(parts: Column) -> Column:
    """SHA-256 over ordered (place, text) pairs."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "\n"), 256)


def _collected(place: str | Column, *texts: str | Column) -> Column:
    text = F.concat_ws(":", *[F.col(t).cast("string") if isinstance(t, str) else t for t in texts])
    return F.collect_list(F.struct(place, text.alias("text")))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels (parent, node, digest) from ranges up to the root, each written once.

    A node's number at the next level is the number of its parent, its own divided by FANOUT towards
    0, so that negative numbers end in one root as well; ranges are keyed by volume.
    """
    place = F.struct("offset", "record_sha256").alias("place")
    ranges = records.groupBy("volume", "piece").agg(
        _digest(_collected(place, "offset", "length", "copies", "record_sha256")).alias("digest")
    )
    levels = [cut(ranges.select(F.col("volume").alias("parent"), F.col("piece").alias("node"), "digest"))]
    nodes = levels[0].groupBy("parent").agg(
        _digest(_collected(F.col("node").alias("place"), "node", "digest")).alias("digest")
    )
    nodes = nodes.withColumnRenamed("parent", "node")
    while True:
        level = cut(nodes.select(F.expr(f"node div {FANOUT}").alias("parent"), "node", "digest"))
        levels.append(level)
        if level.select("parent").distinct().limit(2).count() < 2:
            break
        nodes = level.groupBy("parent").agg(
            _digest(_collected(F.col("node").alias("place"), "node", "digest")).alias("digest")
        )
        nodes = nodes.withColumnRenamed("parent", "node")
    top = levels[-1].groupBy().agg(
        _digest(_collected(F.col("node").alias("place"), "node", "digest")).alias("digest"), F.count("*").alias("n")
    )
    root = F.when(F.col("n") > 0, F.col("digest")).alias("digest")
    levels.append(top.select(F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("node"), root))
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(parent, node) whose digests differ, or that one side lacks."""
    other = right.select(F.col("parent").alias("p"), F.col("node").alias("n"), F.col("digest").alias("d"))
    both = left.join(other, (F.col("parent") == F.col("p")) & (F.col("node") == F.col("n")), "full")
    both = both.where(~F.col("digest").eqNullSafe(F.col("d")))
    return both.select(F.coalesce("parent", "p").alias("parent"), F.coalesce("node", "n").alias("node"))


def damaged_ranges(ours: DataFrame, theirs: DataFrame) -> DataFrame | None:
    """(volume, piece) of the ranges that differ, found from the root down; None if the roots agree.

    Trees of different heights (one replica lacks whole branches) are compared from the level both
    have.
    """
    left, right = tree(ours), tree(theirs)
    if len(left) == len(right) and left[-1].first().digest == right[-1].first().digest:
        return None
    shared = min(len(left), len(right)) - 1
    bad = None
    for a, b in zip(left[:shared][::-1], right[:shared][::-1]):
        if bad is not None:
            above = bad.select(F.col("node").alias("parent"))
            a, b = (x.join(above, "parent", "left_semi") for x in (a, b))
        bad = cut(_differing(a, b))
    return bad.select(F.col("parent").alias("volume"), F.col("node").alias("piece"))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page_id, volume, offset, length, record_sha256, status) of our records and of those only they have.

    status: intact; moved (equal bytes at another offset or another number of copies); altered (they
    have other bytes for the id); missing; extra.
    """
    ours, theirs = cut(ours), cut(theirs)
    columns = ["page_id", "volume", "offset", "length", "record_sha256"]
    bad = damaged_ranges(ours, theirs)
    if bad is None:
        return ours.select(*columns, F.lit("intact").alias("status"))
    key = ["volume", "piece"]
    suspect = ours.join(bad, key, "left_semi")
    rest = ours.join(bad, key, "left_anti").select(*columns, F.lit("intact").alias("status"))
    found = theirs.join(bad, key, "left_semi")
    copy = found.select(
        F.col("page_id").alias("_id"), F.col("record_sha256").alias("_sha"), F.col("offset").alias("_offset"), F.col("copies").alias("_copies")
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("record_sha256") == F.col("_sha"))
    ids = copy.select("_id").distinct().withColumn("_known", F.lit(True)).withColumnRenamed("_id", "_other")
    judged = suspect.join(copy, same, "left").join(ids, F.col("page_id").eqNullSafe(F.col("_other")), "left")
    in_place = (F.col("offset") == F.col("_offset")) & (F.col("copies") == F.col("_copies"))
    status = (
        F.when(in_place, "intact")
        .when(F.col("_sha").isNotNull(), "moved")
        .when(F.col("_known"), "altered")
        .otherwise("missing")
    )
    own = suspect.select("page_id").distinct().withColumnRenamed("page_id", "_own")
    extra = found.join(own, F.col("page_id").eqNullSafe(F.col("_own")), "left_anti")
    return (
        rest.unionByName(judged.select(*columns, status.alias("status")))
        .unionByName(extra.select(*columns, F.lit("extra").alias("status")))
    )
