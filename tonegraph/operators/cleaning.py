"""Duplicate tracks, dense numbering, and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def folded(text: Column) -> Column:
    """Text for comparison: null is empty, outer white space goes, case is folded.  Upper forms are compared, in
    which sharp s is SS (lower(upper(x)) would be simplified to lower(x), which keeps it)."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def duplicate_tracks(tracks: DataFrame) -> DataFrame:
    """Every track with the first track of the same title and artist, and whether it repeats that one.

    Firsts are summed map-side into a written table, so tracks without title and artist, however many, meet in no one task."""
    keyed = tracks.select("track_id", "file_order", folded(F.col("title")).alias("__title"), folded(F.col("artist_name")).alias("__artist"))
    place = F.struct("file_order", "track_id")
    firsts = materialize(keyed.groupBy("__title", "__artist").agg(F.min(place).alias("__first")), "firsts")
    return keyed.join(firsts, ["__title", "__artist"]).select("track_id", F.col("__first.track_id").alias("kept_track_id"), (place != F.col("__first")).alias("is_duplicate"))


def drop_duplicates(features: DataFrame, tracks: DataFrame, after_extract: bool = False) -> DataFrame:
    """features without duplicate tracks.  By default copies are told by metadata alone; after_extract looks for
    the first copy among those tracks that have features."""
    if after_extract:
        tracks = tracks.join(features.select("track_id"), "track_id", "left_semi")
    gone = duplicate_tracks(tracks).where("is_duplicate").select("track_id")
    return features.join(gone, "track_id", "left_anti")


def reindex(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Tracks that have features, numbered 0, 1, ... in file order.

    The number is the row's place inside its range partition plus the rows of the partitions before, so
    no task sees the whole table."""
    kept = tracks.join(features.select("track_id"), "track_id", "left_semi")
    ranged = kept.repartitionByRange("file_order").sortWithinPartitions("file_order")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("file_order")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(starts), "part").withColumn("faiss_id", F.col("before") + F.col("place")).drop("part", "place", "before")


def search(tracks: DataFrame, query: str, column: str = "title", limit: int | None = None, order: str = "track_id") -> DataFrame:
    """Tracks whose column holds query literally, upper and lower case alike.  limit 0 or less means all."""
    found = tracks.where(F.contains(F.upper(column), F.upper(F.lit(query)))).orderBy(order)
    return found.limit(limit) if limit and limit > 0 else found


def lookup(tracks: DataFrame, track_id, key: str = "track_id") -> DataFrame:
    """The one row with this id; no row or more than one is an error."""
    found = tracks.where(F.col(key) == track_id).limit(2)
    n = found.count()
    if n != 1:
        raise ValueError(f"{'no song' if not n else 'multiple songs'} with id {track_id}")
    return found
