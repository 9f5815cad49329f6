"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends every node one minimum (summed map-side), so a component with a third of all nodes is
no special case; the minima are read from a written table, for a join that lies on their grouping's partitions
can't be split where one node has most links.  Every step's links are fixed in a written table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = materialize(least, "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    links = materialize(links, "stars")  # used twice
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _round(links: DataFrame) -> DataFrame:
    return _small_star(_large_star(links))


def components(links: DataFrame) -> DataFrame:
    """links: u, v of one orderable type.  Returns u, v: each linked node but the smallest of its
    component, with that smallest.  Nodes without links are not listed.  Each round moves links to smaller nodes, so the
    rounds end; their number grows with the logarithm of the longest chain."""
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = materialize(now, "links"), None
    while True:
        now = settled(now.sparkSession, "links", functools.partial(_round, now))
        row = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if tuple(row) == mark:
            return now
        mark = tuple(row)
