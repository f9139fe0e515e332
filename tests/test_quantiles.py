"""Quantiles by distributed selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertfold.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def test_a_million_different_values(spark):
    n = 1_000_003
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k")).select(
        F.pow(F.col("k") / 1000.0 - 300, F.lit(3)).alias("value"), (F.col("k") % 3 + 1).alias("n"))
    got = exact_quantiles(df, SHARES, few=5000).first().q
    k = np.arange(n)
    values = np.sort(np.repeat(np.power(k / 1000.0 - 300, 3), k % 3 + 1))
    assert got == pytest.approx([float(np.quantile(values, q)) for q in SHARES], rel=1e-12)


@pytest.mark.parametrize("few", [1, 40, 50_000])
def test_series_with_ties_and_odd_ranges(spark, few):
    rng = np.random.default_rng(few)
    data = {
        "ties": rng.integers(-3, 4, 900).astype(float), "one": np.array([5.5]), "same": np.full(70, -2.25),
        "wide": np.concatenate([rng.normal(0, 1e-9, 300), [1e300, -1e300, 1e308, -1e308]]), "zero": np.array([0.0, -0.0, 0.0]),
        "tail": np.exp(rng.normal(0, 8, 600))}
    rows = [(s, float(v), 1) for s, values in data.items() for v in values] + [("ties", None, 9), ("nothing", None, 3)]
    df = spark.createDataFrame(rows, "feature string, value double, n int").repartition(4)
    got = {r.feature: r.q for r in exact_quantiles(df, SHARES, "feature", few=few).collect()}
    assert set(got) == set(data)
    for s, values in data.items():
        ordered = np.sort(values)
        at = [(len(values) - 1) * q for q in SHARES]
        want = [(1 - x % 1) * ordered[int(x)] + x % 1 * ordered[min(int(x) + 1, len(values) - 1)] for x in at]
        assert got[s] == pytest.approx(want, rel=1e-9, abs=1e-30), s


def test_no_values(spark):
    none = spark.createDataFrame([], "feature string, value double, n long")
    assert exact_quantiles(none, SHARES).collect() == [(None,)]
    assert exact_quantiles(none, SHARES, "feature").count() == 0
