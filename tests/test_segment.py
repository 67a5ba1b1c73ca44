import numpy as np
from helpers import values
from pyspark.sql import functions as F

from basketlab.operators import lloyd, segment


def test_rfm_leaves_out_users_without_lines(spark):
    orders = spark.createDataFrame(
        [(1, 10, 1, None), (2, 10, 2, 7.0), (3, 20, 1, None), (4, 30, 1, None)],
        "order_id long, user_id long, order_number int, days_since_prior_order double",
    )
    lines = spark.createDataFrame(
        [(1, 5), (1, 5), (2, 6), (4, 5)], "order_id long, product_id long"
    )
    out = segment.rfm(orders, lines)
    assert values(out, "user_id", *segment.FEATURES) == [(10, 7.0, 2, 3), (30, 0.0, 1, 1)]


def test_scale_uses_population_spread_and_survives_none(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5, 1), (2, 2.0, 5, 2), (3, 4.0, 5, 4)],
        "user_id long, recency double, frequency long, monetary long",
    )
    rows = segment.scale(df).orderBy("user_id").collect()
    assert [r.frequency_scaled for r in rows] == [0.0, 0.0, 0.0]
    assert abs(rows[0].recency_scaled - (1 - 7 / 3) / 1.247219128924647) < 1e-12


def test_assign_breaks_ties_to_the_lower_number(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0)],
        "user_id long, recency_scaled double, frequency_scaled double, monetary_scaled double",
    )
    assert segment.assign(df, [(1, 0, 0), (-1, 0, 0), (9, 9, 9)]).first().cluster == 0


def test_canonical_numbers():
    means = {
        7: {"recency": 9.0, "frequency": 1.0, "monetary": 2.0},
        5: {"recency": 1.0, "frequency": 8.0, "monetary": 50.0},
        3: {"recency": 2.0, "frequency": 6.0, "monetary": 20.0},
        1: {"recency": 3.0, "frequency": 2.0, "monetary": 10.0},
    }
    assert segment.canonical_numbers(means) == {5: 2, 7: 1, 3: 0, 1: 3}


def test_elbow_falls_and_fit_labels_everyone(ws):
    costs = segment.elbow(ws.scaled, range(2, 5), n_init=3).orderBy("k").collect()
    wcss = [r.wcss for r in costs]
    assert wcss == sorted(wcss, reverse=True) and min(wcss) > 0
    labelled = segment.fit(ws.scaled, n_init=2)
    assert labelled.count() == ws.rfm.count()
    means = {r.cluster: r.monetary for r in segment.means(labelled).collect()}
    assert set(means) == {0, 1, 2, 3} and means[2] == max(means.values())


SCALED = "user_id long, recency double, frequency double, monetary double, recency_scaled double, frequency_scaled double, monetary_scaled double"


def frame(spark, points):
    return spark.createDataFrame([(u, *map(float, p), *map(float, p)) for u, p in enumerate(points)], SCALED)


def test_fitted_centres_are_means_of_their_users(spark):
    rng = np.random.default_rng(2)
    points = np.round(np.concatenate([rng.normal(m, 0.3, (60, 3)) for m in (-3, 0, 2, 6)]), 3)
    names = [f"{c}_scaled" for c in segment.FEATURES]
    df = frame(spark, points)
    best = lloyd.fit_all(df, names, "user_id", range(2, 6), 5, 7)
    for k, (cost, centres) in best.items():
        grid = np.round(points * lloyd.GRID)
        far = ((grid[:, None] - centres[None]) ** 2).sum(2)
        mine = far.argmin(1)
        assert len(centres) == k and np.isclose(cost, far.min(1).sum() / lloyd.GRID**2)
        for c in range(k):
            assert np.abs(grid[mine == c].mean(0) - centres[c]).max() <= 1
    # The four groups are found, whatever the order and the partitions of the rows.
    assert np.isclose(best[4][0], sum(((p - p.mean(0)) ** 2).sum() for p in points.reshape(4, 60, 3)), rtol=1e-4)
    again = lloyd.fit_all(df.orderBy(F.rand(3)).repartition(5), names, "user_id", range(2, 6), 5, 7)
    assert all((again[k][1] == centres).all() for k, (_, centres) in best.items())
    # A hot point weighs as its rows do.
    heavy = frame(spark, [(0, 0, 0)] * 500 + [(1, 1, 1)] * 3 + [(9, 9, 9)] * 2)
    cost, centres = lloyd.fit_all(heavy, names, "user_id", range(2, 3), 4, 1)[2]
    assert np.isclose(cost, 3 * 500 * 3 / 503, atol=1e-3) and sorted(centres[:, 0])[1] == 9 * lloyd.GRID


def test_fit_with_few_or_no_points(spark):
    assert segment.fit(frame(spark, [(1, 2, 3)]).limit(0)).count() == 0
    assert segment.elbow(frame(spark, [(1, 2, 3)]).limit(0)).count() == 0
    assert {r.cluster for r in segment.fit(frame(spark, [(1, 2, 3)] * 3)).collect()} == {2}
    labelled = segment.fit(frame(spark, [(1, 2, 3), (1, 2, 3), (5, 5, 5)])).collect()
    assert len(labelled) == 3 and len({r.cluster for r in labelled}) == 2
