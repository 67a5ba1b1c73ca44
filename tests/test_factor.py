import numpy as np
import pandas as pd
import pytest
from helpers import SMALL, values
from pyspark.sql import functions as F

from basketlab.functions import position
from basketlab.functions.columns import is_train
from basketlab.operators import factor, krylov, ranking
from basketlab.plans import catalog
from basketlab.plans.workspace import workspace

TYPES = "user_id long, item long, value double"


def interactions(spark, matrix):
    rows = [(u, 100 + i, float(x)) for u, row in enumerate(matrix) for i, x in enumerate(row) if x]
    return spark.createDataFrame(rows, TYPES)


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(3).integers(0, 4, (60, 8)) * (
        np.random.default_rng(4).random((60, 8)) < 0.6
    )


@pytest.fixture(scope="module")
def train(spark, matrix):
    ids = spark.range(len(matrix)).select("id", is_train("id").alias("t")).orderBy("id").collect()
    return np.array([r.t for r in ids])


def test_reconstruction_metrics_equal_numpy(spark, matrix, train):
    model = factor.fit_svd(interactions(spark, matrix), 3)
    _, s, vh = np.linalg.svd(matrix[train].astype(float), full_matrices=False)
    v = vh[:3].T
    sigma = factor.explained_variance(model).orderBy("component").toPandas()
    assert np.allclose(sigma["sigma"], s[:3])
    assert np.allclose(sigma["share"], s[:3] ** 2 / (s[:3] ** 2).sum())
    assert np.isclose(sigma["cumulative_share"].iloc[-1], 1.0)
    assert np.allclose(sigma["share_of_total"], s[:3] ** 2 / (s**2).sum())
    x = matrix[~train]
    x = x[x.any(axis=1)]
    r = x @ v @ v.T
    got = factor.evaluate(model).first()
    assert np.isclose(got.mse, ((x - r) ** 2).mean()) and np.isclose(got.mae, np.abs(x - r).mean())
    assert got.true_positives == ((x > 0) & (r >= 0.5)).sum()
    assert got.false_positives == ((x == 0) & (r >= 0.5)).sum()
    assert got.false_negatives == ((x > 0) & (r < 0.5)).sum()
    assert got.true_negatives == ((x == 0) & (r < 0.5)).sum()
    top = np.argsort(-r, axis=1, kind="stable")[:, :5]
    hits = np.take_along_axis(x > 0, top, axis=1)
    assert np.isclose(got.recall_at_k, (hits.sum(1) / (x > 0).sum(1)).mean())
    worst = factor.evaluate(model, order=ranking.WORST_FIRST).first()
    assert worst.precision_at_k == got.precision_at_k and worst.ndcg_at_k != got.ndcg_at_k


def test_recommend_equals_numpy(spark, matrix, train):
    model = factor.fit_svd(interactions(spark, matrix), 2)
    vh = np.linalg.svd(matrix[train].astype(float), full_matrices=False)[2]
    scores = matrix @ vh[:2].T @ vh[:2]
    for r in factor.recommend(model, 3).collect():
        best = np.sort(scores[r.user_id])[::-1]
        assert np.isclose(r.score, best[r["rank"] - 1])
        assert np.isclose(r.score, scores[r.user_id][r["item"] - 100])
    only = factor.recommend(model, 3, users=spark.createDataFrame([(5,)], "user_id long"))
    assert {r.user_id for r in only.collect()} == {5} and only.count() == 3


def test_more_components_than_rank(spark):
    rank_one = np.outer([1, 2, 3, 1, 2, 1, 4, 2, 1, 3], [1, 2, 1])
    model = factor.fit_svd(interactions(spark, rank_one), 50, test_size=0.0)
    assert factor.explained_variance(model).count() == 1


def test_items_only_in_holdout_count_as_cells(spark, matrix, train):
    wide = np.hstack([matrix, np.zeros((60, 1), int)])
    wide[np.flatnonzero(~train)[0], 8] = 1
    model = factor.fit_svd(interactions(spark, wide), 8)
    zero = model.factors.where("item = 108").first()
    assert not np.any(zero.v)
    got = factor.evaluate(model).first()
    assert got.false_negatives == 1  # the one cell no factor reaches


@pytest.mark.parametrize("density", [0.02, 0.9])
def test_gram_sparse_and_dense_paths(density):
    rng = np.random.default_rng(0)
    x = rng.integers(1, 5, (300, 40)) * (rng.random((300, 40)) < density)
    x = x[x.any(axis=1)]
    pdf = pd.DataFrame(
        {"idxs": [np.flatnonzero(r) for r in x], "vals": [r[r > 0].astype(float) for r in x]}
    )
    gram = np.zeros((40, 40))
    factor._add_gram(gram, pdf)
    assert np.allclose(np.triu(gram), np.triu(x.T @ x))


def test_groups_do_not_mix(spark, matrix):
    a, b = matrix[:30], matrix[30:]
    rows = interactions(spark, a).withColumn("cluster", F.lit(0)).unionByName(
        interactions(spark, b).withColumn("cluster", F.lit(1)).withColumn("user_id", F.col("user_id") + 30)
    )
    cells = factor.gram_cells(rows, "cluster").collect()
    for key, part in ((0, a), (1, b)):
        gram = np.zeros((8, 8))
        for r in cells:
            if r.cluster == key:
                gram[r.item_i - 100, r.item_j - 100] = r.dot
        assert np.allclose(gram, part.T @ part)
    model = factor.fit_svd(rows, 3, "cluster", test_size=0.0)
    for key, part in ((0, a), (1, b)):
        s = np.linalg.svd(part.astype(float), compute_uv=False)[:3]
        got = factor.explained_variance(model).where(f"cluster = {key}").orderBy("component")
        assert np.allclose([r.sigma for r in got.collect()], s)


def test_neighbours_and_compatibility_list(spark, matrix, train):
    model = factor.fit_svd(interactions(spark, matrix), 8)
    asked = spark.createDataFrame([(3,), (7,)], "user_id long")
    got = factor.similar_users(model, asked, 4)
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    users = np.flatnonzero(train & matrix.any(axis=1))
    for u in (3, 7):
        want = np.sort(unit[users] @ unit[u])[::-1][:4]
        rows = got.where(f"user_id = {u}").orderBy("rank").collect()
        assert np.allclose([r.similarity for r in rows], want)
    lists = factor.items_by_neighbour_index(model, got).collect()
    place = {u: i for i, u in enumerate(users)}
    near = {(r.user_id, r["rank"]): r.neighbour for r in got.collect()}
    assert len(lists) == 8
    assert all(r["item"] == 100 + place[near[r.user_id, r["rank"]]] % 8 for r in lists)


def test_blocks_of_users_give_the_same_model(spark, matrix, monkeypatch):
    data = interactions(spark, matrix)
    whole = factor.evaluate(factor.fit_svd(data, 3)).first()
    monkeypatch.setattr(factor, "USERS_PER_TASK", 7)
    model = factor.fit_svd(data, 3)
    parts = factor.evaluate(model).first()
    assert np.allclose([float(x) for x in whole], [float(x) for x in parts])
    asked = spark.createDataFrame([(u,) for u in range(30)], "user_id long")
    few = values(factor.similar_users(model, asked, 4), "user_id", "neighbour", "rank")
    monkeypatch.setattr(factor, "USERS_PER_TASK", 1000)
    assert values(factor.similar_users(model, asked, 4), "user_id", "neighbour", "rank") == few


def test_every_user_has_neighbours_of_every_point(spark, matrix, monkeypatch):
    """Users with equal rows are one point; without requests every user is asked."""
    many = np.concatenate([matrix, np.repeat(matrix[:6], 20, axis=0)])
    ids = spark.range(len(many)).select("id", is_train("id").alias("t")).orderBy("id").collect()
    used = many.any(axis=1)
    users = np.flatnonzero(np.array([r.t for r in ids]) & used)
    unit = many / np.maximum(np.linalg.norm(many, axis=1, keepdims=True), 1e-300)
    model = factor.fit_svd(interactions(spark, many), 8)
    want = []
    for u in np.flatnonzero(used):
        score = np.round(unit[users] @ unit[u], factor.TIE_DIGITS)
        order = np.argsort(-score, kind="stable")[:5]
        want += [(int(u), int(users[i]), r) for r, i in enumerate(order, 1)]
    for per_task in (7, 1000):
        monkeypatch.setattr(factor, "USERS_PER_TASK", per_task)
        got = factor.similar_users(model, None, 5)
        assert values(got, "user_id", "neighbour", "rank") == sorted(want, key=str)


def test_similar_users_asks_for_every_user(spark):
    ws = workspace(spark, SMALL)
    lists = catalog.QUERIES["similar_users"](ws).groupBy("user_id").count().collect()
    assert {r.user_id for r in lists} == {r.user_id for r in ws.aisle_counts.select("user_id").distinct().collect()}
    assert {r["count"] for r in lists} == {10}


def test_nearest_in_steps_equals_best(monkeypatch):
    monkeypatch.setattr(factor, "TRAIN_PER_STEP", 16)
    rng = np.random.default_rng(8)
    asked, train = (rng.integers(0, 3, shape).astype(float) for shape in ((50, 4), (4, 333)))
    for n in (1, 5, 40, 400):
        for a, b in zip(factor._nearest(asked, train, n), factor._best(asked @ train, n)):
            assert (a == b).all()


def test_best_takes_the_first_of_equal_scores():
    scores = np.random.default_rng(7).integers(0, 4, (200, 12)).astype(float)
    for n in (1, 5, 12, 20):
        best, found = factor._best(scores, n)
        want = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        assert (best == want).all() and (found == np.take_along_axis(scores, want, axis=1)).all()


def test_a_group_without_held_out_users_is_listed(spark, matrix, train):
    ids = np.flatnonzero(train)[:6]
    rows = [(0, u, 100 + i, float(x)) for u, r in enumerate(matrix) for i, x in enumerate(r) if x]
    rows += [(1, int(u), 100 + k % 3, 1.0 + k) for k, u in enumerate(ids)]
    data = spark.createDataFrame(rows, "grp long, user_id long, item long, value double")
    got = {r.grp: r for r in factor.evaluate(factor.fit_svd(data, 2, group_col="grp")).collect()}
    assert set(got) == {0, 1} and got[1].mse is None and got[0].mse is not None


@pytest.mark.parametrize("items, users, k", [(60, 300, 6), (120, 40, 50), (70, 300, 69)])
def test_block_lanczos_equals_numpy(spark, monkeypatch, items, users, k):
    monkeypatch.setattr(factor, "DENSE_ITEMS", 0)
    monkeypatch.setattr(factor, "USERS_PER_TASK", 64)
    monkeypatch.setattr(krylov, "ITEM_BLOCK", 25)
    monkeypatch.setattr(krylov, "MAX_BLOCKS", 3)
    rng = np.random.default_rng(items)
    x = rng.integers(1, 4, (users, items)) * (rng.random((users, items)) < 0.1)
    model = factor.fit_svd(interactions(spark, x), k, test_size=0.0)
    used = np.flatnonzero(x.any(axis=0))
    rows = {r["item"] - 100: r for r in model.factors.collect()}
    assert sorted(rows) == used.tolist()
    s, vh = np.linalg.svd(x[:, used].astype(float), full_matrices=False)[1:]
    want = min(k, int((s > 1e-9).sum()))
    v = np.stack([rows[i].v for i in used])
    assert v.shape[1] == want and np.allclose(rows[used[0]].sigma, s[:want], rtol=1e-7)
    assert np.allclose(v @ v.T, vh[:want].T @ vh[:want], atol=1e-5)
    assert np.allclose(v.T @ v, np.eye(want), atol=1e-8) and (v[np.abs(v).argmax(axis=0), range(want)] > 0).all()
    assert np.isclose(rows[used[0]].energy, (x.astype(float) ** 2).sum())


def test_dense_and_lanczos_groups_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide = rng.integers(0, 2, (80, 40)) * (rng.random((80, 40)) < 0.3)
    rows = [(c, 100 * c + u, i, float(v)) for c in (0, 1) for u, r in enumerate(wide[:, : 40 if c else 12]) for i, v in enumerate(r) if v]
    data = spark.createDataFrame(rows, "grp long, user_id long, item long, value double")
    whole = factor.fit_svd(data, 4, "grp")
    monkeypatch.setattr(factor, "DENSE_ITEMS", 20)
    both = factor.fit_svd(data, 4, "grp")
    a, b = (np.array(values(factor.evaluate(m).drop("grp")), float) for m in (whole, both))
    assert np.allclose(a, b, atol=1e-6)


def test_items_are_numbered_alike_by_ranges(spark, matrix, monkeypatch):
    data = interactions(spark, matrix).withColumn("grp", F.col("user_id") % 2)
    whole = values(factor.item_index(data, "grp"))
    monkeypatch.setattr(position, "WINDOW_ROWS", 0)
    assert values(factor.item_index(data, "grp")) == whole


def test_neighbours_do_not_depend_on_the_blocks_asked_at_once(spark, monkeypatch):
    """Few blocks of requests meet the train users at a time; results are the same as of one pass."""
    draw = np.random.default_rng(4)
    rows = [(u, i, float(draw.integers(1, 4))) for u in range(150) for i in range(8) if draw.random() < 0.5]
    rows += [(u + 1000, i, x) for u, i, x in rows if u < 30]  # copies
    model = factor.fit_svd(spark.createDataFrame(rows, "user_id long, item long, value double"), 3)
    want = values(factor.similar_users(model, None, 4))
    monkeypatch.setattr(factor, "USERS_PER_TASK", 20)
    monkeypatch.setattr(factor, "ASKED_BLOCKS", 1)
    passes = []
    monkeypatch.setattr(factor, "free_shuffles", lambda spark: passes.append(1))
    got = values(factor.similar_users(model, None, 4))
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want]) and len(passes) > 1
