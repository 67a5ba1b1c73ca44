import pytest
from helpers import values
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlab.functions import position
from basketlab.functions.position import global_position, nth_smallest, number_in_group
from basketlab.operators import clean

ROWS = "order_id long, user_id long, days_since_prior_order double"


def orders(spark, *gaps):
    return spark.createDataFrame(
        [(i, user, gap) for i, (user, gap) in enumerate(gaps)], ROWS
    )


def test_days_per_user_three_cases(spark):
    df = orders(
        spark, (1, None), (1, 0.0), (1, 5.0), (2, None), (2, 4.0), (2, 6.0), (3, None)
    )
    out = values(clean.days_per_user(df), "order_id", "days_since_prior_order")
    assert out == [(0, None), (1, 0.0), (2, 5.0), (3, 0.0), (4, 4.0), (5, 6.0), (6, 0.0)]


@pytest.mark.parametrize(
    "gaps, kept, removed",
    [
        ([None, 0.0, 5.0, None], [0.0, 5.0], 2),
        ([None, 4.0, 6.0], [0.0, 4.0, 6.0], 0),
        ([None, None], [0.0, 0.0], 0),
    ],
)
def test_orders_global(spark, gaps, kept, removed):
    df = orders(spark, *[(1, g) for g in gaps])
    found = clean.orders_global(df).select("days_since_prior_order").collect()
    assert sorted(r[0] for r in found) == kept
    report = clean.orders_global_report(df).first()
    assert tuple(report) == (len(gaps), removed, len(kept))


def test_sample_first_keeps_lowest_ids(spark):
    df = orders(spark, *[(i % 3, 1.0) for i in range(50)])
    kept = clean.sample_first(df, 0.3).select("order_id").collect()
    assert sorted(r[0] for r in kept) == list(range(15))
    assert clean.sample_first(df).count() == 50


def test_global_position_with_gaps_between_ids(spark):
    ids = [-7, 3, 8, 9, 100, 101, 5000, 1 << 40, 1 << 61, (1 << 62) + 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert values(global_position(df, "id")) == sorted(
        [(i, p) for p, i in enumerate(ids)], key=str
    )


@pytest.mark.parametrize("window_rows", [0, 1_000_000])
def test_numbers_equal_a_plain_window_for_hot_users_and_null_dates(spark, monkeypatch, window_rows):
    monkeypatch.setattr(position, "WINDOW_ROWS", window_rows)
    rows = [(1 if i % 3 else i, None if i % 4 == 0 else i * 7 % 50, i * (1 << 40) - 9) for i in range(400)]
    rows += [(None, 3, 5), (None, None, 6), (2, None, 1 << 60), (2, None, 1 << 59)]
    df = spark.createDataFrame(rows, "user_id long, day long, id long")
    ordered = Window.partitionBy("user_id").orderBy("day", "id")
    plain = df.select(
        "*",
        F.row_number().over(ordered).alias("number"),
        F.lag("day").over(ordered).alias("previous"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total"),
    )
    assert values(number_in_group(df, "user_id", "day", "id")) == values(plain)


def test_nth_smallest_narrows_brackets(spark, monkeypatch):
    monkeypatch.setattr(position, "SORTED_ROWS", 20)
    monkeypatch.setattr(position, "SKETCH", 50)
    ids = spark.range(5000).selectExpr("CASE WHEN id % 2 = 0 THEN id * id ELSE -id * 1000003 END AS id")
    plain = sorted(r.id for r in ids.collect())
    for n in (1, 2, 37, 2500, 4999, 5000):
        assert nth_smallest(ids, "id", n) == plain[n - 1]
    assert nth_smallest(ids, "id", 0) is None and nth_smallest(ids, "id", 5001) is None
    # Filtered, not sorted: no exchange of the table.
    df = orders(spark, *[(i % 3, 1.0) for i in range(50)])
    assert "Exchange" not in clean.sample_first(df, 0.3)._jdf.queryExecution().executedPlan().toString()
