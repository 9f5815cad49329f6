"""The search for weights that agree with the triplets: random and grid trials, scored, and the best weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import union_trials
from ..operators.evaluation import best_weighting, random_weights, score_trials, triplet_dots, weight_grid
from ..sources.scratch import materialize
from ..sources.tables import write_parquet


def evaluate(grouped: DataFrame, triplets: DataFrame, trials: int = 20_000, seed: int = 19, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored trials, best first (ties by trial), and the best weighting, one row.

    grouped: id and the nine groups; triplets: triplet, root, closer, further.  Random trials are numbered from 0, the grid's
    follow.  With a folder both are written there, as weight_evaluation and best_weighting, and read back."""
    spark = grouped.sparkSession
    dots = materialize(triplet_dots(triplets, grouped), "dots")
    drawn = random_weights(spark, trials, seed)
    grid = weight_grid(spark).withColumn("trial", F.col("trial") + trials)
    scored = materialize(score_trials(union_trials([drawn, grid]), dots), "scored").orderBy(F.desc("accuracy"), "trial")
    best = best_weighting(scored)
    if folder:
        for table, name in ((scored, "weight_evaluation"), (best, "best_weighting")):
            write_parquet(table, f"{folder}/{name}")
        scored, best = (spark.read.parquet(f"{folder}/{name}") for name in ("weight_evaluation", "best_weighting"))
    return scored, best
