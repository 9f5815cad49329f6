"""Statistics over a table of weight trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import all_of, equal_width_bin
from .evaluation import LEVELS
from .quantiles import exact_quantiles

METRICS = ("accuracy", "mean_margin", "median_margin", "std_margin")
TOP = 100


def weight_columns(trials: DataFrame) -> list[str]:
    return [c for c in trials.columns if c.startswith("weight_")]


def numeric_columns(trials: DataFrame) -> list[str]:
    return [c for c, kind in trials.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def with_strategy(trials: DataFrame, levels=LEVELS) -> DataFrame:
    """sampling_strategy: gridsearch where every weight is one of the levels, else uniform_sampled."""
    grid = all_of([F.col(c).isin(*levels) for c in weight_columns(trials)])
    return trials.withColumn("sampling_strategy", F.when(grid, "gridsearch").otherwise("uniform_sampled"))


def strategy_counts(trials: DataFrame) -> DataFrame:
    return with_strategy(trials).groupBy("sampling_strategy").agg(F.count(F.lit(1)).alias("trials"))


def drop_zero_accuracy(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("accuracy") != 0.0)


def histograms(trials: DataFrame, columns=METRICS, bins: int = 10) -> DataFrame:
    """sampling_strategy, metric, bin, n: equal-width histograms of each column by strategy."""
    long = with_strategy(trials).unpivot("sampling_strategy", list(columns), "metric", "value")
    span = long.groupBy("sampling_strategy", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))  # a row for each metric
    placed = long.join(F.broadcast(span), ["sampling_strategy", "metric"])
    bin_of = equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    return placed.groupBy("sampling_strategy", "metric", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(trials: DataFrame, columns=METRICS) -> DataFrame:
    """Minimum, quartiles and maximum of each column by strategy."""
    long = with_strategy(trials).unpivot("sampling_strategy", list(columns), "metric", "value")
    found = exact_quantiles(long, ["sampling_strategy", "metric"], "value", (0.0, 0.25, 0.5, 0.75, 1.0))
    names = ("low", "q1", "median", "q3", "high")
    return found.select("sampling_strategy", "metric", *[F.col("q")[k].alias(n) for k, n in enumerate(names)])


def iqr_outliers(trials: DataFrame, column: str = "std_margin", k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k iqr, q3 + k iqr] by strategy."""
    rows = with_strategy(trials)
    q = exact_quantiles(rows, ["sampling_strategy"], column, (0.25, 0.75)).select("sampling_strategy", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = k * (F.col("q3") - F.col("q1"))
    outside = (F.col(column) < F.col("q1") - reach) | (F.col(column) > F.col("q3") + reach)
    return rows.join(F.broadcast(q), "sampling_strategy").groupBy("sampling_strategy").agg(F.count_if(outside).alias("outliers"))


def _pearson(a: str, b: str) -> Column:
    """Correlation, null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(trials: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_a, column_b, corr: lower triangle with diagonal, in one pass."""
    columns = columns or [c for c in numeric_columns(trials) if c != "trial"]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    row = trials.agg(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), _pearson(a, b).alias("corr")) for a, b in pairs]).alias("c"))
    return row.select(F.inline("c"))


def top_trials(trials: DataFrame, n: int = TOP) -> DataFrame:
    return trials.orderBy(F.desc("accuracy"), "trial").limit(n)


def top_share(trials: DataFrame, n: int = TOP) -> DataFrame:
    """Rows in the top and their share of all."""
    everything = trials.agg(F.count(F.lit(1)).alias("all"))
    return top_trials(trials, n).agg(F.count(F.lit(1)).alias("top")).join(everything).select("top", F.try_divide(F.col("top"), F.col("all")).alias("share"))


def top_mix(trials: DataFrame, n: int = TOP) -> DataFrame:
    """Share of each strategy among the top trials."""
    counted = with_strategy(top_trials(trials, n)).groupBy("sampling_strategy").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("sampling_strategy", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


def weight_dispersion(trials: DataFrame, n: int = TOP, reach: float = 5.0) -> DataFrame:
    """Sample deviation of each weight among the top uniformly sampled trials, and its share of the range."""
    top = top_trials(with_strategy(trials).where("sampling_strategy = 'uniform_sampled'"), n)
    parts = [F.struct(F.lit(c).alias("weight"), F.stddev_samp(c).alias("std"), (F.stddev_samp(c) / reach).alias("dispersion")) for c in weight_columns(trials)]
    return top.agg(F.array(*parts).alias("w")).select(F.inline("w"))


def top_margins(trials: DataFrame, n: int = TOP) -> DataFrame:
    return five_numbers(top_trials(trials, n), METRICS[1:])


def union_trials(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
