import numpy as np
import pytest
from helpers import nodes
from pyspark.sql import functions as F

from basketlab.operators import restricted


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    counts = rng.integers(1, 9, (80, 12)) * (rng.random((80, 12)) < 0.4)
    counts[0] = 0  # a user without lines
    cluster = rng.integers(0, 3, 80)
    lists = {u: sorted(rng.choice(12, size=rng.integers(1, 6), replace=False).tolist()) for u in range(80)}
    lists[5], lists[6], lists[7] = lists[4], lists[4], []
    cluster[4:7] = 1  # the same list and segment three times
    frames = (
        spark.createDataFrame([(u, 100 + i) for u, x in lists.items() for i in x], "user_id long, item long"),
        spark.createDataFrame([(u, int(c)) for u, c in enumerate(cluster)], "user_id long, cluster int"),
        spark.createDataFrame(
            [(u, 100 + i, int(x)) for u, row in enumerate(counts) for i, x in enumerate(row) if x], "user_id long, item long, value long"
        ),
    )
    return frames, counts, cluster, lists


@pytest.mark.parametrize("k", [1, 2, 50])
def test_lists_equal_one_decomposition_per_user(tables, k):
    """Brute force: the matrix of each user's segment and list is built and decomposed by itself."""
    frames, counts, cluster, lists = tables
    want = {}
    for u, items in lists.items():
        x = counts[u, items]
        if not x.any():
            continue
        matrix = counts[cluster == cluster[u]][:, items].astype(float)
        v = np.linalg.svd(matrix, full_matrices=False)[2][:k].T
        scores = x @ v @ v.T
        best = np.argsort(-np.round(scores, 9), kind="stable")[:3]
        want[u] = [(100 + items[i], round(float(scores[i]), 6) + 0.0) for i in best]
    got = {}
    for r in restricted.recommend(*frames, 3, k).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item, round(r.score, 6) + 0.0))
    assert set(got) == set(want) and 0 not in got and 7 not in got
    for u, rows in want.items():
        assert [i for i, _ in got[u]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in got[u]], [s for _, s in rows], atol=1e-6)


def test_empty_tables(tables):
    (lists, people, counts), *_ = tables
    assert restricted.recommend(lists.limit(0), people, counts).count() == 0
    assert restricted.recommend(lists, people, counts.limit(0)).count() == 0


def test_lists_are_not_broadcast_for_their_cells(spark):
    """Few bytes of lists become many rows of pairs, which must not pass through the driver."""
    lists = spark.range(600).select(F.col("id").alias("user_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("id") + i * (1 + F.col("id") % 4)) % 25)).alias("item"))
    lists = lists.distinct()
    people = spark.range(600).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("cluster"))
    counts = spark.range(6000).select((F.col("id") % 600).alias("user_id"), (F.col("id") % 25).alias("item"), F.lit(1).alias("value")).distinct()
    out = restricted.recommend(lists, people, counts)
    sent = [n.toString() for n in nodes(out) if n.nodeName() == "BroadcastExchange"]
    assert not [x for x in sent if "posexplode" in x]
    assert out.select("user_id").distinct().count() == 600
