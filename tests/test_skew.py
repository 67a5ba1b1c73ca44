"""One user with a third of the orders, one order and one product with a third of the lines."""

import duckdb
import pytest
from compare import SOURCES, connect, differences
from helpers import SMALL

import __spark_entry__ as entry
from basketlab.functions import position
from basketlab.plans.catalog import QUERIES
from basketlab.plans.workspace import Workspace

SKEWED = {
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN l_orderkey % 7 IN (1, 2) THEN 11 ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey",
}
NAMES = [
    "retail_orders",
    "retail_order_products",
    "clean_days_per_user",
    "rfm_scaled",
    "profile_describe",
    "order_history",
    "assoc_rules_department",
    "rule_metrics",
    "ranking_metrics",
    "item_gram",
    "svd_recommend_aisles",
    "mba_recommendations",
    "cluster_aisle_top_products",
    "user_aisle_products",
]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skew"))
    con = duckdb.connect()
    for name in SOURCES:
        change = f"REPLACE ({SKEWED[name]})" if name in SKEWED else ""
        con.execute(
            f"COPY (SELECT * {change} FROM '{SMALL}/{name}.parquet') "
            f"TO '{folder}/{name}.parquet' (FORMAT parquet)"
        )
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(position, "WINDOW_ROWS", 100)  # the hot user is too large for one task
        yield Workspace(spark, folder), connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_on_skewed_data(skewed, name):
    ws, con = skewed
    assert differences(QUERIES[name](ws), con, entry.oracle_sql()[name]) is None
