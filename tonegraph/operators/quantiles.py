"""Exact interpolated quantiles by group, with no group in one task.

All ranks of all groups are narrowed down together: each round counts, inside the interval that still holds a rank, the values of
BINS bins (added map-side, one row a bin), and goes on with the bin that holds the rank, between the least and the greatest value
there.  An interval with one value is settled; one with at most `small` values is sorted.  The least and the greatest value of an interval
never share a bin, so every round narrows every open interval; bins go by sign, then by logarithm, then by width, so ten rounds or so settle
any doubles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import all_of
from ..sources.scratch import materialize

#: Bins of a round, values of an interval that one task sorts, and the ratio of values from which logarithms part them.
BINS, SMALL, WIDE = 1024, 100_000, 4


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value between low and high: by sign where that differs, by logarithm where values differ by more than WIDE
    times, else by equal widths.  Infinite values have bins of their own."""
    inf, most = float("inf"), 1.7976931348623157e308
    first, last = F.greatest(low, F.lit(-most)), F.least(high, F.lit(most))
    share = lambda x, a, b: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0)) * bins)))
    near, far = F.least(F.abs(first), F.abs(last)), F.greatest(F.abs(first), F.abs(last))
    by_log = share(F.ln(F.abs(v)), F.ln(near), F.ln(far))
    finite = (
        F.when((first <= 0) & (last >= 0), F.signum(v))
        .when(far / WIDE > near, F.when(first > 0, by_log).otherwise(-by_log))
        .otherwise(share(v, first, last))
    )
    return F.when(v == -inf, -bins - 1).when(v == inf, bins + 1).otherwise(finite).cast("int")


def _other(df: DataFrame) -> DataFrame:
    """df with its columns named as the other side of a join."""
    return df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])


def _same(columns: list[str]) -> Column:
    return all_of([F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in columns])


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: Sequence[float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """by, q: for each group the quantiles of value at the shares `at`, linear between neighbours.

    Nulls don't count, NaN is the greatest value; a group without values has no row; null is a group like any other.  A quantile between
    an infinite value and another is what that arithmetic gives."""
    keys = [f"k{i}" for i in range(len(by))] or ["k0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("k0")]
    values = materialize(rows.select(*named, F.col(value).cast("double").alias("v")).where("v is not null"), "values")
    real = ~F.isnan("v")
    groups = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(real).alias("size"), F.min(F.when(real, F.col("v"))).alias("low"), F.max(F.when(real, F.col("v"))).alias("high")
    )
    groups = materialize(groups, "groups")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in at for f in (F.floor, F.ceil)]))
    state = groups.select(*keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "size", "low", "high", "n")
    state = state.withColumns({c: F.when(F.col("rank") < F.col("size"), F.col(c)).otherwise(F.lit(float("nan"))) for c in ("low", "high")}).drop("n")
    state = materialize(state, "ranks")
    settled: list[DataFrame] = []
    interval = [*keys, "low", "high"]

    def inside(intervals: DataFrame) -> DataFrame:
        found = values.join(_other(intervals), _same(keys) & F.col("v").between(F.col("o_low"), F.col("o_high")))
        return found.select(*[F.col(f"o_{c}").alias(c) for c in interval], "v")

    single = F.col("low").eqNullSafe(F.col("high"))
    while True:
        settled.append(state.where(single | (F.col("size") <= small)))
        open_ = state.where(~single & (F.col("size") > small))
        if open_.isEmpty():
            break
        binned = inside(open_.select(*interval).distinct()).withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high"), bins))
        counted = binned.groupBy(*interval, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = W.partitionBy(*interval).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most bins + 2 rows
        counted = materialize(counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "bins")
        rest = F.col("rank") - F.col("below")
        held = open_.join(_other(counted), _same(interval) & (rest >= F.col("o_before")) & (rest < F.col("o_before") + F.col("o_n")))
        state = held.select(*keys, "rank", (F.col("below") + F.col("o_before")).alias("below"), F.col("o_n").alias("size"), F.col("o_least").alias("low"), F.col("o_most").alias("high"))
        state = materialize(state, "ranks")
    narrowed = reduce(DataFrame.union, settled)
    known = narrowed.where(single).select(*keys, "rank", F.col("low").alias("v"))
    sought = materialize(narrowed.where(~single), "sought")
    order = W.partitionBy(*interval).orderBy("v")  # at most `small` rows
    sorted_ = inside(sought.select(*interval).distinct()).withColumn("place", F.row_number().over(order) - 1)
    found = sought.join(_other(sorted_), _same(interval) & (F.col("o_place") == F.col("rank") - F.col("below")))
    known = known.union(found.select(*keys, "rank", F.col("o_v").alias("v")))
    listed = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("known"))  # two a share
    joined = listed.join(_other(groups.select(*keys, "n")), _same(keys)).withColumnRenamed("o_n", "n")

    def between(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.element_at("known", low), F.element_at("known", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], F.array(*[between(p) for p in at]).alias("q"))
