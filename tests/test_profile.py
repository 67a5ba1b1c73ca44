import numpy as np
import pandas as pd

from basketlab.operators import profile


def test_describe_equals_pandas_for_small_and_large_columns(spark):
    rng = np.random.default_rng(1)
    n = 4001
    pdf = pd.DataFrame(
        {
            "unique": rng.permutation(n),
            "ties": rng.integers(0, 5, n),
            "wide": rng.standard_normal(n) * 1e6,
            "mostly": np.where(rng.random(n) < 0.6, 7, rng.integers(0, 1000, n)),
        }
    )
    df = spark.createDataFrame(pdf)
    for accuracy in (100, None):  # sketch brackets, whole column
        out = profile.describe("t", df, accuracy).toPandas().set_index("column_name")
        want = pdf.describe().T
        ours = out[["n", "mean", "std", "lo", "p25", "p50", "p75", "hi"]].to_numpy(float)
        assert np.allclose(ours, want.loc[out.index].to_numpy(float), rtol=1e-12)


def test_missing_values_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, None)], "x long, y string")
    nulls = {r.column_name: r.null_count for r in profile.nulls({"t": df}).collect()}
    assert nulls == {"x": 1, "y": 2}
    info = {r.column_name: (r.dtype, r.non_null) for r in profile.info({"t": df}).collect()}
    assert info == {"x": ("bigint", 2), "y": ("string", 1)}
    assert tuple(profile.shape({"t": df}).first()) == ("t", 3, 2)


def test_describe_of_empty_and_text_only_tables(spark):
    empty = spark.createDataFrame([], "x long, y string")
    row = profile.describe("t", empty).first()
    assert (row.table_name, row.column_name, row.n, row.mean, row.p50) == ("t", "x", 0, None, None)
    words = spark.createDataFrame([("a",)], "y string")
    assert profile.describe("t", words).collect() == []
    mixed = spark.createDataFrame([(None, 2)], "x long, z long")
    found = {r.column_name: (r.n, r.p50) for r in profile.describe("t", mixed).collect()}
    assert found == {"x": (0, None), "z": (1, 2.0)}
