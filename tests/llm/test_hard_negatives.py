import math
import random

import numpy as np
from pyspark.sql import functions as F

from basketlab.llm import hard_negatives
from basketlab.llm.hard_negatives import Anchors, Bucket, Search, buckets


def plain(rows, positives=5, negatives=10):
    """Every anchor against every row."""
    good = [
        (i, l, [math.floor(256 * float(x)) for x in v])
        for i, l, v in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good]
        near = sorted((s, j) for s, j, m in score if m == label and j != i)[:positives]
        for s, j in near:
            far = sorted((t, k) for t, k, m in score if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(far)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, id string, v string"


def mined(spark, rows, parts=4, **options):
    data = [(i, v, l, "s", 1, "i", "v") for i, l, v in rows]
    table = spark.createDataFrame(data, SCHEMA).repartition(parts)
    found = hard_negatives.mine(table, F.col("id") % 100 == 0, **options)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, found.collect()))


def clustered(rng, n, dims=8):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, rng.randrange(3), [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = clustered(rng, 900)
    rows += [(1000 + k, 1, [0.5] * 8) for k in range(40)]  # ties
    rows += [(2000, 1, [0.5] * 8), (2000, 2, [0.5] * 8), (2100, 1, [0.0] * 8), (2100, 1, [0.0] * 8)]
    rows += [(3000, None, [0.5] * 8), (None, 1, [0.5] * 8), (3100, 1, None), (3200, 1, [None] * 8), (3300, 1, [math.nan] * 8), (3400, 1, [math.inf] * 8)]
    rows += [(3500, 1, []), (3600, 1, [0.5] * 3), (3700, 9, [0.1] * 8), (3601, 2, [0.5] * 10)]
    assert mined(spark, rows) == plain(rows)


def test_chunks_and_small_buckets(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i * 50, l, v) for i, l, v in clustered(rng, 500)]
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", 200_000)
    assert mined(spark, rows, parts=3) == plain(rows)


def test_few_rows_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 3.0])]
    assert mined(spark, rows) == plain(rows) == [(0, 1, 1, 2, 65536, 32768)]
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_pruning_drops_no_row_and_saves_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = np.floor(256 * (centres[rng.integers(0, 40, 6000)] * rng.uniform(0.5, 2, (6000, 1)) + rng.normal(size=(6000, 16)) * 0.05))
    labels, ids = rng.integers(0, 4, 6000), np.arange(6000)
    pick = ids[::100]
    full = np.full((60, 1), np.inf)
    search = Search(Anchors(ids[pick], labels[pick], vectors[pick], -full, full, True, 5))
    for k in range(0, 6000, 1000):
        for bucket in buckets(ids[k : k + 1000], labels[k : k + 1000], vectors[k : k + 1000]):
            search.add(bucket)
    for a in range(60):
        scores = vectors @ vectors[pick[a]]
        order = [j for j in np.lexsort((ids, -scores)) if labels[j] == labels[pick[a]] and j != pick[a]][:5]
        mine = search.slot == a
        assert search.id[mine].tolist() == order and (search.score[mine] == scores[order]).all()
    assert search.verified < 0.5 * search.met


def test_feasible_ranges_hold_every_row_of_the_cosine():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 6))
    lengths = np.sqrt((vectors**2).sum(1))
    bucket = Bucket(np.arange(500), np.zeros(500), vectors, lengths)
    for _ in range(50):
        q = rng.normal(size=6)
        q /= np.sqrt(q @ q)
        focus = np.argsort(-np.abs(q))[:3]
        for cosine in (0.5, 0.8, 0.95):
            rows = bucket.candidates(q, focus, cosine)
            exact = np.flatnonzero(bucket.directions @ q >= cosine)
            assert rows is None or set(exact) <= set(rows.tolist())
