"""Triplets of human judgements and the search for weights that agree with them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GROUPS
from .knn import group_dots, weighted_cosine

LEVELS = (0.0, 2.5, 5.0)
BROADCAST_TRIPLETS = 50_000
SCORES = ("accuracy", "mean_margin", "median_margin", "std_margin")
#: Margins that a task holds at once.
_MARGINS = 1 << 22


def page(numbered: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Rows skip, skip + 1, ... of the numbered tracks, at most limit, numbered anew from 0.  The range is one of
    numbers, so no rows are counted off."""
    kept = numbered.where(F.col("faiss_id") >= skip)
    if limit is not None:
        kept = kept.where(F.col("faiss_id") < skip + limit)
    return kept.withColumn("faiss_id", F.col("faiss_id") - skip)


def track_mapping(numbered: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """track_id, faiss_id of the tracks that have a vector; vectors: id of each."""
    kept = numbered if vectors is None else numbered.join(vectors.select(F.col("id").alias("faiss_id")), "faiss_id", "left_semi")
    return kept.select("track_id", "faiss_id")


def build_triplets(numbered: DataFrame, choices: DataFrame) -> DataFrame:
    """Triplets from rows of three.  numbered: faiss_id, track_id, title, artist_name; rows 3c, 3c + 1 and 3c + 2
    are root, a and b of comparison c.  choices: comparison, choice: a (a is closer), b, c (a and b are
    closest to each other); any other choice skips the comparison."""
    label = F.concat_ws(" - ", "artist_name", "title")
    trio = numbered.select(
        F.floor(F.col("faiss_id") / 3).cast("long").alias("comparison"), (F.col("faiss_id") % 3).cast("int").alias("place"), "track_id", label.alias("label")
    )
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    wide = trio.groupBy("comparison").agg(*[pick(k, c).alias(f"{c}{k}") for k in range(3) for c in ("track_id", "label")], F.count(F.lit(1)).alias("n"))
    judged = wide.where("n = 3").join(choices.select("comparison", F.lower("choice").alias("choice")), "comparison").where(F.col("choice").isin("a", "b", "c"))

    def role(a: int, b: int, c: int, column: str) -> Column:
        return F.when(F.col("choice") == "a", F.col(f"{column}{a}")).when(F.col("choice") == "b", F.col(f"{column}{b}")).otherwise(F.col(f"{column}{c}"))

    roles = {"root": (0, 0, 1), "closer": (1, 2, 2), "further": (2, 1, 0)}
    return judged.select(
        "comparison", *[role(*r, "label").alias(f"{k}_track") for k, r in roles.items()], *[role(*r, "track_id").alias(f"{k}_track_id") for k, r in roles.items()]
    )


def index_triplets(triplets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triplets with the embedding index of each track; those with an unknown track are dropped.
    mapping: track_id, faiss_id."""
    for role in ("root", "closer", "further"):
        side = mapping.select(F.col("track_id").alias(f"{role}_track_id"), F.col("faiss_id").alias(f"{role}_embedding_index"))
        triplets = triplets.join(side, f"{role}_track_id")
    return triplets


def weight_grid(spark: SparkSession, levels=LEVELS, groups=GROUPS) -> DataFrame:
    """trial, weight_<group>: every combination of levels, the last group varying fastest."""
    n = len(levels)
    choose = F.array(*[F.lit(float(v)) for v in levels])
    rows = spark.range(n ** len(groups)).withColumnRenamed("id", "trial")
    digit = lambda k: F.floor(F.col("trial") / n ** (len(groups) - 1 - k)) % n
    return rows.select("trial", *[F.get(choose, digit(k).cast("int")).alias(f"weight_{g}") for k, g in enumerate(groups)])


def random_weights(spark: SparkSession, trials: int = 20_000, seed: int = 19, low: float = 0.0, high: float = 5.0, groups=GROUPS) -> DataFrame:
    """trial, weight_<group>: uniform in [low, high).  A draw is the first 52 bits of the MD5 of "seed:trial:group", so tasks
    draw for themselves, a lost task draws the same again, and more trials keep the earlier ones."""
    bits = lambda g: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.lit(g))), 1, 13), 16, 10).cast("long")
    drawn = [(F.lit(float(low)) + bits(g) / F.lit(float(1 << 52)) * F.lit(float(high - low))).alias(f"weight_{g}") for g in groups]
    return spark.range(trials).withColumnRenamed("id", "trial").select("trial", *drawn)


def triplet_dots(triplets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Each triplet's group products with the closer (c_...) and the further (f_...) track."""
    near = group_dots(triplets.select("triplet", "root", "closer"), grouped, "root", "closer")
    far = group_dots(triplets.select("triplet", "root", "further"), grouped, "root", "further")
    rename = lambda df, mark: df.select("triplet", *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c.split("_")[0] in ("dot", "left", "right")])
    return rename(near, "c").join(rename(far, "f"), "triplet")


def score_trials(trials: DataFrame, dots: DataFrame) -> DataFrame:
    """trials with accuracy, mean, median and population deviation of the margin over all triplets.

    Triplets are hand-made judgements, a few hundred rows; up to BROADCAST_TRIPLETS their products are sent to every
    task, where a batch of trials is a few matrix products.  More are dealt into cells that trials are copied to."""
    n = dots.count()
    if n <= BROADCAST_TRIPLETS:
        return _score_by_matrix(trials, dots)
    weight = lambda g: F.col(f"weight_{g}")
    margin = weighted_cosine(weight, prefix="c_") - weighted_cosine(weight, prefix="f_")
    cells = math.ceil(n / BROADCAST_TRIPLETS)
    dealt = dots.withColumn("cell", F.pmod(F.xxhash64("triplet"), F.lit(cells)).cast("int"))
    pairs = trials.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).join(dealt, "cell")
    pairs = pairs.select(*trials.columns, margin.alias("margin"))
    return pairs.groupBy(*trials.columns).agg(
        F.avg((F.col("margin") > 0).cast("double")).alias("accuracy"),
        F.avg("margin").alias("mean_margin"),
        F.median("margin").alias("median_margin"),
        F.stddev_pop("margin").alias("std_margin"),
    )


def _score_by_matrix(trials: DataFrame, dots: DataFrame) -> DataFrame:
    rows = dots.toPandas()  # of checked size
    parts = [f"{side}_{kind}" for side in "cf" for kind in ("dot", "left", "right")]
    products = {p: np.ascontiguousarray(rows[[f"{p}_{g}" for g in GROUPS]].to_numpy("f8").T) for p in parts}
    shared = dots.sparkSession.sparkContext.broadcast(products)
    weights = [f"weight_{g}" for g in GROUPS]

    def cosine(squares: np.ndarray, side: str) -> np.ndarray:
        dot, left, right = (squares @ shared.value[f"{side}_{kind}"] for kind in ("dot", "left", "right"))
        length = np.sqrt(left * right)
        return np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, _MARGINS // max(1, shared.value["c_dot"].shape[1]))
            for s in range(0, len(batch), step):
                part = batch.iloc[s : s + step]
                squares = part[weights].to_numpy("f8") ** 2
                margin = cosine(squares, "c") - cosine(squares, "f")
                if not margin.shape[1]:
                    margin = np.full((len(part), 1), np.nan)
                scores = ((margin > 0).mean(axis=1), margin.mean(axis=1), np.median(margin, axis=1), margin.std(axis=1))
                yield part.assign(**dict(zip(SCORES, scores, strict=True)))

    spread = trials.repartition(dots.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, T.StructType([*trials.schema.fields, *[T.StructField(c, T.DoubleType()) for c in SCORES]]))


def best_weighting(scored: DataFrame) -> DataFrame:
    """The weights of the most accurate trial; ties go to the lowest trial."""
    return scored.orderBy(F.desc("accuracy"), "trial").limit(1).select([c for c in scored.columns if c.startswith("weight_")])
