"""Note streams of a song: registers, melody, intervals, inter-onset intervals and interval n-grams.

Every operator groups or orders by track_id and finer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import bucket_count, bucketed

LOW_MAX, MID_MAX = 48, 72
LEAST_NOTES = 5
#: Notes of one task: windows and groupings by track stand side by side in it, each with a sort of its own.
TASK_NOTES = 200_000


def song_notes(notes: DataFrame, least: int = LEAST_NOTES, parts: int | None = None) -> DataFrame:
    """Notes of the tracks with at least `least` non-drum notes.

    parts: partitions by track, which all that goes by track keeps, as task_count gives them; else Spark joins small ones to larger."""
    notes = notes if parts is None else notes.repartition(parts, "track_id")
    count = F.count_if(~F.col("is_drum")).over(W.partitionBy("track_id"))
    return notes.where(F.col("pitch").isNotNull()).withColumn("__n", count).where(F.col("__n") >= least).drop("__n")


def task_count(notes: DataFrame) -> int:
    """A task for each TASK_NOTES notes."""
    return bucket_count(notes, TASK_NOTES)


def note_table(notes: DataFrame, least: int = LEAST_NOTES, buckets: int | None = None) -> DataFrame:
    """song_notes as a table bucketed by track and sorted by onset: what groups, joins or orders by track reads it in place."""
    return bucketed(song_notes(notes, least), "notes", ["track_id"], ["track_id", "onset", "note_seq"], buckets or task_count(notes))


def melodic(song: DataFrame, low_max: int = LOW_MAX, mid_max: int = MID_MAX) -> DataFrame:
    """Non-drum notes with their register."""
    register = F.when(F.col("pitch") < low_max, "low").when(F.col("pitch") < mid_max, "mid").otherwise("high")
    return song.where(~F.col("is_drum")).withColumn("register", register)


def melody(song: DataFrame) -> DataFrame:
    """The highest note of each onset; of equals the one read first."""
    best = W.partitionBy("track_id", "onset").orderBy(F.desc("pitch"), "note_seq")
    return song.where(~F.col("is_drum")).withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def streams(song: DataFrame) -> DataFrame:
    """Melody and the three registers as one table with a column stream."""
    return melodic(song).withColumnRenamed("register", "stream").unionByName(melody(song).withColumn("stream", F.lit("melody")))


def intervals(streamed: DataFrame) -> DataFrame:
    """Pitch steps between consecutive notes of a stream, with their place."""
    order = W.partitionBy("track_id", "stream").orderBy("onset", "note_seq")
    steps = streamed.select(
        "track_id", "stream", (F.row_number().over(order) - 2).alias("pos"), (F.col("pitch") - F.lag("pitch").over(order)).alias("step"), "onset", "note_seq"
    )
    return steps.where(F.col("step").isNotNull())


def ngrams(steps: DataFrame, n: int = 3, coarse: int = 1) -> DataFrame:
    """Sliding n-grams of steps, each step floored to a multiple of `coarse`."""
    order = W.partitionBy("track_id", "stream").orderBy("pos")
    step = F.floor(F.col("step") / coarse).cast("int") if coarse != 1 else F.col("step").cast("int")
    parts = [step, *[F.lead(step, k).over(order) for k in range(1, n)]]
    gram = F.when(parts[-1].isNotNull(), F.concat_ws(",", *[p.cast("string") for p in parts]))
    return steps.select("track_id", "stream", "pos", gram.alias("ngram")).where(F.col("ngram").isNotNull())


def ngram_counts(grams: DataFrame) -> DataFrame:
    """Occurrences of each n-gram by track and stream, with the place of its first one."""
    return grams.groupBy("track_id", "stream", "ngram").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def onset_gaps(song: DataFrame) -> DataFrame:
    """Inter-onset intervals of all non-drum notes, the drums, the low register (bass) and the melody."""
    low = melodic(song).where("register = 'low'")
    sources = {"ioi": song.where(~F.col("is_drum")), "drum_ioi": song.where("is_drum"), "bass_ioi": low, "melody_ioi": melody(song)}
    order = W.partitionBy("track_id").orderBy("onset")
    out = None
    for kind, notes in sources.items():
        gaps = notes.select("track_id", F.lit(kind).alias("kind"), (F.col("onset") - F.lag("onset").over(order)).alias("value"))
        gaps = gaps.where(F.col("value").isNotNull())
        out = gaps if out is None else out.union(gaps)
    return out
