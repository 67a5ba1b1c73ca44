"""Near duplicates: SuperMinHash signatures, banding, exact verification, union of links.

Two documents are linked when the Jaccard similarity of their shingle sets (64-bit hashes of
runs of ``size`` words) is at least ``percent`` / 100. Steps:

1. Each document becomes (set hash, signature). Documents of equal sets form one class; everything
   after works on classes, known by the set hash.
2. Bands of ``ROWS`` registers: classes that share a band meet in a bucket. With 48 bands of 5
   rows a pair at 0.8 misses all of them with a probability of 5e-9.
3. Each member of a bucket is compared with the bucket's hub (its smallest class) on full sets, once
   per distinct pair; the links give first components.
4. A bucket whose members are not all in one component may hide links between members that are
   not the hub. Jaccard distance is a metric, so the known distances to the hub bound every other
   one: two members of distances a and b are at least |a - b| apart, so one linked with the hub
   cannot be linked with one twice as far away, and two linked with the hub are in one component.
   What these bounds leave is compared in square tiles of about ``TILE`` documents a side, dealt
   over the cluster; a tile returns links only, never pairs that fail.
5. Components over the links by alternating large-star and small-star steps.

Null and empty texts have an empty set, are linked with nothing and form their own component.
Repeated ids: each row is judged by its own text. Null ids are grouped like others, but a component
is named by its smallest id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.common import STEP, WordHashes, alnum_words, byte_list, cut, mix, space_words

ROWS, BANDS = 5, 48
TILE = 256
_SEED = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    size = min(size, len(h))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out) * STEP + h[k : k + n]
    return np.unique(mix(out + np.uint64(size)))


def super_minhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SuperMinHash signatures of many sets at once, one row per set, as integers.

    Level j offers each element's j-th entry of a random permutation of the registers, with the
    rank (j, random fraction). Once all registers of a set hold a rank of an earlier level, later
    levels cannot lower any of them, so the set leaves the loop: the early stop.
    """
    count = len(sets)
    out = np.full((count, registers), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if count else np.empty(0, np.uint64)
    base = np.repeat(np.arange(count) * registers, sizes)
    swaps: list[np.ndarray] = []
    for level in range(registers):
        if not len(element):
            break
        draw = mix(element + np.uint64(int(STEP) * (2 * level + 1) & _MASK))
        # The high half picks the register, the low half is the fraction of the rank.
        pick = level + (((draw >> np.uint64(32)) * np.uint64(registers - level)) >> np.uint64(32)).astype(np.int64)
        place = pick.copy()
        for earlier in range(level - 1, -1, -1):
            place[place == swaps[earlier]] = earlier
        rank = (np.uint64(level) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, base + place, rank)
        swaps.append(pick)
        open_sets = (out >= np.uint64((level + 1) << 32)).any(axis=1)
        keep = open_sets[base // registers]
        if not keep.all():
            element, base = element[keep], base[keep]
            swaps = [s[keep] for s in swaps]
    return out


def _set_hash(items: np.ndarray) -> int:
    return int(mix(mix(items).sum(keepdims=True) + np.uint64(int(STEP) * len(items) & _MASK))[0])


def _classes(docs: DataFrame, doc_id: str, text: str, size: int, words: Callable) -> DataFrame:
    """(doc_id, n, id, bands) of each row: id is the set's hash, bands one hash per band."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                sets = [shingles(words(v), size, hashes) for v in byte_list(part["text"])]
                signature = super_minhash(sets, ROWS * BANDS).reshape(len(sets), BANDS, ROWS)
                band = np.arange(BANDS, dtype=np.uint64) * _SEED
                for k in range(ROWS):
                    band = mix(band + signature[:, :, k]) + STEP
                whole = np.array([_set_hash(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(whole.view(np.int64)),
                        pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "id", "bands"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, id long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, size: int, words: Callable) -> DataFrame:
    """(id, items) of the documents in ``ids`` (doc_id): sorted shingle hashes as bytes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.join(ids, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            items = [shingles(words(v), size, hashes) for v in byte_list(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([_set_hash(s) for s in items], np.uint64).view(np.int64)),
                    pa.array([s.tobytes() for s in items], pa.binary()),
                ],
                names=["id", "items"],
            )

    return rows.mapInArrow(run, "id long, items binary")


def _similar(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of intersection and union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common, len(both) - common


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, hub, common, total) of each pair, from full sets."""
    left = pairs.join(sets, "id")
    both = left.join(sets.select(F.col("id").alias("hub"), F.col("items").alias("others")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_similar(a, b) for a, b in zip(batch["items"].to_pylist(), batch["others"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["hub"],
                    pa.array([c for c, _ in found], pa.int64()),
                    pa.array([t for _, t in found], pa.int64()),
                ],
                names=["id", "hub", "common", "total"],
            )

    return both.select("id", "hub", "items", "others").mapInArrow(
        run, "id long, hub long, common long, total long"
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link (a, b): the smallest id that can be reached.

    Alternating large-star and small-star; each step is written, and the loop ends when a round
    changes nothing.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(
            small.select("u", F.col("m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
        ).first()
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        heads.select("id", F.col("id").alias("component"))
    )


def _tiles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside each hub's unresolved members, found in tiles.

    ``members`` has (hub, id, component, common, total). Members are near (linked with the hub),
    in the shell (up to twice as far) or far, and each kind is dealt to blocks of about ``TILE``. A
    pair of blocks is a tile; near with near and near with far hold no open link and make none.
    """
    gap = 1 - percent / 100 + 1e-9
    near = F.col("common") * 100 >= F.col("total") * percent
    rows = members.withColumn("distance", 1 - F.col("common") / F.col("total")).withColumn("near", near)
    kind = F.when(F.col("near"), 0).when(F.col("distance") <= 2 * gap, 1).otherwise(2)
    rows = rows.withColumn("kind", kind)
    blocks = [
        F.ceil(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)) / TILE).cast("int").alias(f"b{k}")
        for k in range(3)
    ]
    rows = rows.join(rows.groupBy("hub").agg(*blocks), "hub")
    own = F.when(F.col("kind") == 0, F.col("b0")).when(F.col("kind") == 1, F.col("b1")).otherwise(F.col("b2"))
    first = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, F.col("b0")).otherwise(F.expr("b0 + b1"))
    # The blocks a member's own block is compared with: from, to (exclusive).
    low = F.when(F.col("kind") == 1, 0).otherwise(F.col("b0"))
    high = F.when(F.col("kind") == 0, F.expr("b0 + b1")).otherwise(F.expr("b0 + b1 + b2"))
    rows = rows.withColumn("block", (first + F.pmod(F.xxhash64("id"), own)).cast("int"))
    rows = rows.withColumn("low", low).withColumn("high", high).where("high > low")
    other = F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("other")
    rows = rows.select("hub", "id", "component", "distance", "near", "block", other)
    rows = rows.select(
        "hub",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "id",
        "component",
        "distance",
        "near",
    ).join(sets, "id")

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        items = [np.frombuffer(b, np.uint64) for b in group["items"]]
        sizes = np.array([len(x) for x in items])
        distance, label = group["distance"].to_numpy(), group["component"].to_numpy()
        near, ids = group["near"].to_numpy(), group["id"].to_numpy()
        # Elements in one member only cannot be shared; the rest get small numbers.
        owner = np.repeat(np.arange(len(items)), sizes)
        values, code, seen = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = seen[code] > 1
        order = np.lexsort((owner[shared], code[shared]))
        code, owner = code[shared][order], owner[shared][order]
        common = np.zeros((len(items), len(items)), np.int32)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, int)
        ends = np.append(starts[1:], len(code))
        step = 4096
        for at in range(0, len(starts), step):
            lo, hi = starts[at], ends[min(at + step, len(starts)) - 1]
            block = np.zeros((len(items), min(step, len(starts) - at)), np.float32)
            column = np.searchsorted(starts, np.arange(lo, hi), side="right") - 1 - at
            block[owner[lo:hi], column] = 1
            common += (block @ block.T).astype(np.int32)
        total = sizes[:, None] + sizes[None, :] - common
        ok = common * 100 >= total * percent
        ok &= label[:, None] != label[None, :]
        ok &= np.abs(distance[:, None] - distance[None, :]) <= gap
        ok &= ~(near[:, None] & near[None, :])
        i, j = np.nonzero(np.triu(ok, 1))
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    return rows.groupBy("hub", "low", "high").applyInPandas(tile, "a long, b long")


def link_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    words: Callable[[bytes], list[bytes]] = alnum_words,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row."""
    rows = cut(_classes(docs, doc_id, text, size, words))
    # Written once: both sides of the join below read the exploded bands (a band's hash tells its number).
    # Copies collapse here, before anything is joined by class.
    classes = cut(
        rows.where("n > 0").groupBy("id").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first_id"))
    )
    table = classes.select("id", F.explode("bands").alias("bucket"))
    heads = table.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n"))
    buckets = cut(table.join(heads.where("n > 1"), "bucket").select("bucket", "id", "hub"))
    pairs = cut(buckets.where("id <> hub").select("id", "hub").distinct())
    ids = pairs.select("id").union(pairs.select("hub")).distinct()
    ids = cut(classes.join(ids, "id").select(F.col("first_id").alias("doc_id")).distinct())
    sets = cut(_sets(docs, ids, doc_id, text, size, words).dropDuplicates(["id"]))
    compared = cut(_compare(pairs, sets))
    links = compared.where(F.col("common") * 100 >= F.col("total") * percent)
    links = links.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    first = components(links)

    # Buckets whose members are not all in one component.
    labelled = buckets.join(first, "id", "left").select(
        "bucket", "hub", "id", F.coalesce("component", "id").alias("component")
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        .where("low <> high and n > 2")
        .select("bucket")
    )
    members = (
        labelled.join(mixed, "bucket", "left_semi")
        .where("id <> hub")
        .select("hub", "id", "component")
        .distinct()
        .join(compared, ["hub", "id"])
    )
    whole = components(links.union(cut(_tiles(members, sets, percent))))

    named = classes.select("id", "first_id").join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(heads, "component").select("id", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("id")).alias("id")).join(named, "id", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each group stays: the one with the smallest id. Columns as they were.

    Rows are told apart by a written number, so repeated rows and rows without an id are copies like
    any others; of rows with the smallest id one stays, and an id that is null comes last. Documents
    without words are kept.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    marks = link_classes(rows, "__row", **options)
    marks = cut(marks.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")))
    # Groups of one row have nothing to lose.
    groups = marks.groupBy("__group").agg(F.count("*").alias("__n")).where("__n > 1").select("__group")
    marks = marks.join(groups, "__group", "left_semi")
    ids = rows.select("__row", F.col(doc_id).cast("long").alias("__id"))
    marks = cut(marks.join(ids, "__row").select("__row", "__group", F.struct(F.col("__id").isNull(), "__id", "__row").alias("__key")))
    kept = marks.groupBy("__group").agg(F.min("__key")["__row"].alias("__row")).select("__row")
    gone = cut(marks.select("__row").join(kept, "__row", "left_anti"))
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
