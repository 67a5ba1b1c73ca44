import pytest
from helpers import values

from basketlab.operators import clean
from basketlab.plans import jobs
from basketlab.sources import integrity, store, tables
from basketlab.streaming import logins


@pytest.fixture
def small(spark):
    def df(name, rows):
        return spark.createDataFrame(rows, tables.SCHEMAS[name])

    return tables.Retail(
        df("aisles", [(1, "gems"), (2, 'say "hi", all')]),
        df("departments", [(1, "x")]),
        df("products", [(1, "ring", 1, 1), (2, "a" * 201, 2, 1), (3, None, 9, 1)]),
        df("orders", [(1, 7, "prior", 1, 0, 0, None), (2, 7, "train", 2, 1, 5, 3.0), (2, 8, "train", 1, 1, 5, 4.0)]),
        df("order_products", [(2, 1, 1, 0), (2, 2, 2, 0), (1, 1, 1, 0), (5, 1, 1, 0), (5, 1, 2, 0)]),
    )


def test_csv_and_parquet_round_trip(spark, small, tmp_path):
    for fmt in ("csv", "parquet"):
        tables.write(small, str(tmp_path / fmt), fmt)
        again = tables.read(spark, str(tmp_path / fmt), fmt)
        for name, df in small.named().items():
            assert values(getattr(again, name)) == values(df)


def test_sorted_files_do_not_overlap(spark, tmp_path):
    df = spark.range(1000, numPartitions=4).selectExpr("(id * 37) % 1000 AS order_id")
    tables.write_sorted(df, str(tmp_path / "t"))
    spans = []
    for file in (tmp_path / "t").glob("*.parquet"):
        ids = [r[0] for r in spark.read.parquet(str(file)).collect()]
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_integrity_violations_are_counted(small):
    got = {r.rule: r.violations for r in integrity.integrity_report(small).collect() if r.violations}
    assert got == {
        "unique:orders.order_id": 1,
        "reference:products.aisle_id": 1,
        "reference:order_products.order_id": 2,
        "length:products.product_name": 1,
        "missing:products.product_name": 1,
    }


def test_star_and_merge(small):
    assert values(tables.star(small), "product_id", "aisle", "department")[0] == (1, "gems", "x")
    lines = small.order_products
    merged = tables.merge_prior_train(lines.where("order_id = 1"), lines.where("order_id <> 1"))
    assert values(merged) == values(lines)


def test_store_round_trip(spark, small, tmp_path):
    store.save({"a": small.aisles, "p": small.products}, str(tmp_path), {"k": 3})
    parts, params = store.load(spark, str(tmp_path))
    assert params == {"k": 3} and values(parts["p"]) == values(small.products)
    with pytest.raises(ValueError):
        store.save({}, str(tmp_path))


def test_bucketed_tables_join_without_shuffle(spark, small, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    tables.register(small, "shop", bucket_lines_by=4)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("shop.order_products").join(spark.table("shop.orders"), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.sql("DROP DATABASE shop CASCADE")


def test_jobs_end_to_end(spark, ws, tmp_path):
    t = str(tmp_path)
    tables.write(ws.view.retail, f"{t}/csv", "csv")
    jobs.load(spark, f"{t}/csv", f"{t}/in")
    report = jobs.clean_orders(spark, f"{t}/in", f"{t}/clean").first()
    assert report.removed_rows == 150 and report.final_rows == 1350
    with pytest.raises(ValueError):
        jobs.clean_orders(spark, f"{t}/in", f"{t}/in/")
    jobs.segment_users(spark, f"{t}/in", f"{t}/seg", n_init=1)
    assert spark.read.parquet(f"{t}/seg/cluster_statistics").count() == 4
    jobs.train_rules(spark, f"{t}/in", f"{t}/clean", f"{t}/rules", min_support=0.02)
    parts, params = store.load(spark, f"{t}/rules")
    assert params["min_support"] == 0.02 and parts["metrics"].first().total_rules == parts["rules"].count()
    jobs.train_segment_rules(
        spark, f"{t}/in", f"{t}/clean", f"{t}/seg", f"{t}/srules", 0.02, 1.0, item_col="product_name"
    )
    parts, _ = store.load(spark, f"{t}/srules")
    assert parts["metrics"].count() >= 1
    jobs.train_svd(spark, f"{t}/in", f"{t}/clean", f"{t}/svd", n_components=5)
    model = jobs.load_svd(spark, f"{t}/svd")
    from basketlab.operators import factor

    stored = store.load(spark, f"{t}/svd")[0]["metrics"].first()
    assert factor.evaluate(model).first().mse == pytest.approx(stored.mse)
    jobs.train_segment_svd(spark, f"{t}/in", f"{t}/clean", f"{t}/seg", f"{t}/ssvd", n_components=4)
    parts, params = store.load(spark, f"{t}/ssvd")
    assert params["group_col"] == "cluster" and parts["metrics"].count() == 4


def test_login_streams_equal_batch(spark, ws, tmp_path):
    folder = tmp_path / "in"
    ws.view.logins.where("user_id % 2 = 0").coalesce(1).write.parquet(f"{folder}/a")
    ws.view.logins.where("user_id % 2 = 1").coalesce(1).write.parquet(f"{folder}/b")
    source = (
        spark.readStream.schema(ws.view.logins.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )
    logins.keep_last_login(source, f"{tmp_path}/last", f"{tmp_path}/c1").awaitTermination()
    got = logins.read_last_login(spark.read.parquet(f"{tmp_path}/last"))
    from basketlab.operators import recommend

    assert values(got) == values(recommend.last_login(ws.view.logins))
    logins.open_carts(source, f"{tmp_path}/carts", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/carts").count() == ws.view.logins.count()


def test_clean_orders_feed_the_models(ws):
    assert clean.orders_global(ws.view.orders).where("days_since_prior_order IS NULL").count() == 0


def test_checked_load_keeps_every_line(spark, tmp_path):
    lines = ["order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order", '1,2,"a ""b"", c",1,2,3,4.5', "2,2,prior,1,2,3,", "x,2,prior,1,2,3,4", "3,2,prior,1,2", "4,,prior,1,2,3,4", "5,2,prior,1,2,3,4,5"]
    (tmp_path / "orders.csv").write_text("\n".join(lines))
    good, bad = tables.read_checked(spark, str(tmp_path / "orders.csv"), "orders")
    assert [(r.order_id, r.eval_set, r.days_since_prior_order) for r in good.orderBy("order_id").collect()] == [(1, 'a "b", c', 4.5), (2, "prior", None)]
    assert sorted((r.cause, r.line) for r in bad.collect() if r.line) == sorted(("malformed", lines[k]) for k in (3, 4, 6))
    assert [(r.cause, r.order_id) for r in bad.where("line is null").collect()] == [("missing value", 4)]
