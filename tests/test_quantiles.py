"""Exact quantiles by narrowing histograms, against Spark's own percentile and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.operators.quantiles import exact_quantiles

AT = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)


def groups():
    rng = random.Random(7)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(997)] + [("equal", 3.25)] * 400 + [("one", -0.0)] + [("few", float(k)) for k in (5, 1, 4)]
    rows += [("huge", rng.choice([-1.7e308, 1.7e308, 1e-300, 0.0])) for _ in range(300)] + [("skew", 10.0 ** rng.uniform(-300, 300)) for _ in range(500)]
    rows += [("half", rng.choice([1.0, 1.0, 1.0, math.nextafter(1.0, 2.0), 2.0])) for _ in range(501)] + [(None, rng.random()) for _ in range(250)]
    return rows + [("gone", None)] * 5 + [("normal", None)] * 9


@pytest.mark.parametrize(("bins", "small"), [(1024, 100_000), (64, 20)])
def test_equal_to_percentile(spark, bins, small):
    df = spark.createDataFrame(groups(), "g string, v double").repartition(4)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, AT))).alias("q")).collect() if r.q is not None}
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", AT, bins, small).collect()}
    assert set(got) == set(want)
    for g, q in want.items():
        assert got[g] == pytest.approx(q, rel=1e-12, abs=0), g


@pytest.mark.parametrize("small", [10, 1000])
def test_of_all_rows_with_infinite_values(spark, small):
    values = [float("-inf")] * 40 + [float(k) for k in range(100)] + [float("inf")] * 60
    df = spark.createDataFrame([(v,) for v in values], "v double")
    at = [0.0, 0.1, 0.5, 0.6, 0.95]
    assert exact_quantiles(df, [], "v", at, 16, small).first().q == pytest.approx(list(np.percentile(values, [100 * p for p in at])))
    nan = df.unionByName(spark.createDataFrame([(float("nan"),)] * 300, "v double"))
    q = exact_quantiles(nan, [], "v", [0.0, 0.9], 16, small).first().q
    assert q[0] == float("-inf") and math.isnan(q[1])


def test_no_window_or_group_holds_more_than_its_bound(spark):
    """Two groups of 20,000 values, of which one task sorts at most 64 a rank."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", AT, 64, 64).collect()}
    for g in (0, 1):
        q = df.where(F.col("g") == g).agg(F.percentile("v", F.array(*map(F.lit, AT)))).first()[0]
        assert got[g] == pytest.approx(q, rel=1e-12)
    assert exact_quantiles(df.limit(0), ["g"], "v", AT).collect() == []
