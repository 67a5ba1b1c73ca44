"""Hard negatives of anchor vectors: exact top inner products by coordinate pruning.

For each anchor the ``positives`` best other rows of its label are found, then for each positive the
``negatives`` best rows of other labels whose score lies between two shares of the positive's score.

Rows are taken in blocks, a block is parted by vector length into buckets, and a bucket keeps a
sorted list of its rows for each coordinate of the directions. An anchor with a threshold (its
worst kept score, or the lower share) asks of a bucket a cosine of at least threshold / (its length x
the bucket's longest). That bounds each coordinate of a direction to a range around the anchor's own;
for the anchor's ``FOCUS`` largest coordinates the ranges are cut out of the sorted lists, the shortest
list is tested against the other ranges, and what remains is verified by exact inner products. A
bucket that is too short for the threshold is passed over whole; one of which most rows would remain
is verified whole, by one product for all such anchors.

Anchors are sent to the tasks in chunks of ``CHUNK_BYTES`` and met by every block of rows in one pass
over the table: no shuffle of rows, no pairs, only the best few of each task are merged per anchor.

Results: rows with a null label or id, a null vector, or a null or non-finite component take no
part. Vectors shorter than others end in zeros. Repeated rows count each for themselves; rows with
the anchor's id are not its positives. Ties go to the smaller id. Scores are sums of doubles, exact
while they stay under 2**53. Anchors without positives, positives without negatives and an empty
table give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlab.llm.common import cut

# Coordinates of an anchor that are looked up, rows of a block and of a bucket.
FOCUS, BLOCK_ROWS, BUCKET_ROWS = 5, 16_384, 4_096
# A bucket of this many rows ends where the length falls below this share of its longest.
BUCKET_LEAST, FALL = 256, 0.9
# Of a bucket at most this share is verified row by row.
SPARSE = 0.25
# Bytes of the anchors sent to the tasks at once.
CHUNK_BYTES = 16 << 20


def prepared(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: float) -> DataFrame:
    """id, label and scaled, floored components of the rows that take part."""
    parts = F.col(vector)
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), parts.alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    )


@dataclass
class Anchors:
    """A chunk of anchors with the slots to fill: one for positives, one per positive for negatives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray  # (anchor, slot) scores a row must reach
    high: np.ndarray  # and must not pass
    same: bool  # whether rows of the same label are sought, or of others
    keep: int


def _matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for row, values in zip(out, lists):
        row[: len(values)] = values[:width]
    return out


class Bucket:
    """Rows of similar length with a sorted list per coordinate of their directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest = float(lengths.max())
        self.directions = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(self.directions, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.directions, self.order, axis=0)

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates are feasible at this cosine; None where most may be."""
        q = direction[focus]
        slack = np.sqrt((1 - cosine * cosine) * np.maximum(1 - q * q, 0))
        low = np.where(q <= -cosine, -1.0, q * cosine - slack) - 1e-9
        high = np.where(q >= cosine, 1.0, q * cosine + slack) + 1e-9
        ends = [
            (np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right"))
            for f, a, b in zip(focus, low, high)
        ]
        sizes = [b - a for a, b in ends]
        k = int(np.argmin(sizes))
        rows = self.order[ends[k][0] : ends[k][1], focus[k]]
        for f, a, b in zip(focus, low, high):
            x = self.directions[rows, f]
            rows = rows[(x >= a) & (x <= b)]
        return rows if len(rows) <= SPARSE * len(self.ids) else None


class Search:
    """Best rows of each slot so far, over the buckets given to it."""

    def __init__(self, anchors: Anchors):
        self.anchors = anchors
        n, slots = anchors.low.shape
        lengths = np.sqrt((anchors.vectors**2).sum(1))
        self.lengths = lengths
        self.directions = anchors.vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.focus = np.argsort(-np.abs(self.directions), axis=1, kind="stable")[:, :FOCUS]
        self.need = anchors.low.copy()
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.verified = self.met = 0

    def add(self, bucket: Bucket) -> None:
        a = self.anchors
        some, whole = [], []
        least = self.need.min(axis=1)
        for k in range(len(a.ids)):
            reach = self.lengths[k] * bucket.longest
            # Rounding of the lengths must not pass over a row that just reaches the threshold.
            if least[k] > reach * (1 + 1e-9) + 1e-6:
                continue
            if least[k] <= 0:
                whole.append(k)
                continue
            rows = bucket.candidates(self.directions[k], self.focus[k], min(least[k] / reach, 1.0) * (1 - 1e-12))
            if rows is None:
                whole.append(k)
            elif len(rows):
                some.append((k, rows))
        self.met += len(a.ids) * len(bucket.ids)
        found = []
        for begin in range(0, len(whole), 256):
            part = np.array(whole[begin : begin + 256])
            scores = a.vectors[part] @ bucket.vectors.T
            self.verified += scores.size
            found += self._passing(part, scores, np.arange(len(bucket.ids)), bucket)
        for k, rows in some:
            self.verified += len(rows)
            found += self._passing(np.array([k]), (bucket.vectors[rows] @ a.vectors[k])[None], rows, bucket)
        if found:
            self._merge(*(np.concatenate(x) for x in zip(*found)))

    def _passing(self, part: np.ndarray, scores: np.ndarray, rows: np.ndarray, bucket: Bucket):
        a = self.anchors
        same = a.labels[part][:, None] == bucket.labels[rows][None]
        fits = same & (a.ids[part][:, None] != bucket.ids[rows][None]) if a.same else ~same
        slots = a.low.shape[1]
        for s in range(slots):
            i, j = np.nonzero(fits & (scores >= self.need[part, s][:, None]) & (scores <= a.high[part, s][:, None]))
            if len(i):
                yield part[i] * slots + s, scores[i, j], bucket.ids[rows[j]]

    def _merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        sizes = np.diff(np.append(first, len(slot)))
        rank = np.arange(len(slot)) - np.repeat(first, sizes)
        best = rank < self.anchors.keep
        self.slot, self.score, self.id = slot[best], score[best], ids[best]
        full = sizes >= self.anchors.keep
        flat = self.need.reshape(-1)
        worst = score[first[full] + self.anchors.keep - 1]
        flat[slot[first[full]]] = np.maximum(flat[slot[first[full]]], worst)


def buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[Bucket]:
    """The rows of a block by length, longest first."""
    lengths = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    k = 0
    while k < len(order):
        fallen = int(np.searchsorted(falling, FALL * falling[k], "right"))
        end = min(max(fallen, k + BUCKET_LEAST), k + BUCKET_ROWS)
        rows = order[k:end]
        k = end
        yield Bucket(ids[rows], labels[rows], vectors[rows], lengths[rows])


def _search(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """(anchor, slot, id, score): the best few of each task; the anchor is its number in the chunk."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    slots, width = anchors.low.shape[1], anchors.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value)
        waiting: list[pa.RecordBatch] = []

        def take() -> None:
            block = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            lists = block["v"].combine_chunks()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            sizes = np.diff(ends)
            if len(sizes) and (sizes == width).all():
                vectors = flat.reshape(-1, width)
            else:
                vectors = _matrix([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], max(width, int(sizes.max(initial=0))))
            ids, labels = (block[c].to_numpy() for c in ("id", "label"))
            for bucket in buckets(ids, labels, vectors):
                search.add(_narrow(bucket, width))

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= BLOCK_ROWS:
                take()
        if sum(map(len, waiting)):
            take()
        yield pa.RecordBatch.from_arrays(
            [pa.array(search.slot // slots), pa.array(search.slot % slots), pa.array(search.id), pa.array(search.score)],
            names=["anchor", "slot", "id", "score"],
        )

    return rows.mapInArrow(run, "anchor long, slot long, id long, score double")


def _narrow(bucket: Bucket, width: int) -> Bucket:
    """Coordinates past the anchors' own meet zeros; lengths still count them."""
    bucket.vectors = bucket.vectors[:, :width]
    return bucket


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` rows per anchor and slot, ranked from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A negative scores at least ``low`` and at most ``high`` hundredths of its positive.
    ``is_anchor`` is an expression over ``id``.
    """
    table = prepared(rows, vec_id, vector, F.col("label") if label is None else label, scale)
    anchors = cut(table.where(is_anchor))
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(size.width or 0, 1)
    chunks = max(1, -(-size.n * (width + 4 * positives * negatives) * 8 // CHUNK_BYTES))
    out = None
    for chunk in range(chunks):
        part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).toArrow()
        if not len(part) and (out is not None or chunk < chunks - 1):
            continue
        ids, labels = (part[c].to_numpy() for c in ("id", "label"))
        vectors = _matrix([np.array(v) for v in part["v"].to_pylist()], width)
        anchor = Anchors(ids, labels, vectors, np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), np.inf), True, positives)
        best = _best(_search(table, anchor), positives).toArrow()
        k, slot, near, score = (best[c].to_numpy() for c in ("anchor", "rank", "id", "score"))
        floor, ceiling = (np.full((len(ids), positives), x) for x in (np.inf, -np.inf))
        # Whole scores: at least low hundredths, at most high hundredths.
        floor[k, slot - 1], ceiling[k, slot - 1] = np.ceil(low * score / 100), np.floor(high * score / 100)
        found = _best(_search(table, Anchors(ids, labels, vectors, floor, ceiling, False, negatives)), negatives)
        keys = rows.sparkSession.createDataFrame(
            pa.table({"anchor": k, "slot": slot.astype(np.int64) - 1, "anchor_id": ids[k], "positive_id": near, "positive_score": score.astype(np.int64)}),
        )
        done = found.join(F.broadcast(keys), ["anchor", "slot"]).select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").cast("long").alias("negative_score"),
        )
        if chunks > 1:
            done = cut(done)
        out = done if out is None else out.unionAll(done)
    return out
