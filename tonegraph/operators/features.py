"""Features of a song, one function for each family; all return one row (or a few) for each track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import TINY, bound, dot, edge_counts, equal_width_bin, first_argmax, norm, pitch_class_counts, share, total
from . import notes as N

REGISTERS = ("low", "mid", "high")
SEGMENTS = 16
LEAST_SEGMENT_NOTES = 10
ENTROPY_BINS = 20

# Tonal profiles of the key-finding method, and pitch class names.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")

#: Ten bins, equal in the logarithm, from 1 ms to 10 s.
LOG_EDGES = tuple(10 ** (-3 + 0.4 * i) for i in range(11))


def basic_stats(song: DataFrame) -> DataFrame:
    """Counts, means and population deviations over non-drum notes; files found and mean instruments a file."""
    plain = song.where(~F.col("is_drum")).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("note_count"),
        F.avg("pitch").alias("mean_pitch"),
        F.stddev_pop("pitch").alias("std_pitch"),
        (F.max("pitch") - F.min("pitch")).cast("long").alias("pitch_range"),
        F.avg(F.col("release") - F.col("onset")).alias("mean_duration"),
        F.stddev_pop(F.col("release") - F.col("onset")).alias("std_duration"),
        F.avg("velocity").alias("mean_velocity"),
        F.stddev_pop("velocity").alias("std_velocity"),
    )
    by_file = song.groupBy("track_id", "file_no").agg(F.countDistinct("instrument").alias("instruments"))
    files = by_file.groupBy("track_id").agg(F.count(F.lit(1)).alias("num_files"), F.avg("instruments").alias("mean_instruments"))
    return plain.join(files, "track_id")


def register_counts(song: DataFrame) -> DataFrame:
    return N.melodic(song).groupBy("track_id", "register").agg(F.count(F.lit(1)).alias("notes"))


def chroma(song: DataFrame) -> DataFrame:
    """low, mid, high and total chroma; the total is that of the sum of the three normalised ones."""
    notes = N.melodic(song)
    counts = [pitch_class_counts(F.col("pitch"), F.col("register") == r).alias(r) for r in REGISTERS]
    counted = notes.groupBy("track_id").agg(*counts)
    shares = counted.select("track_id", *[share(F.col(r)).alias(f"{r}_chroma") for r in REGISTERS])
    both = F.zip_with("low_chroma", "mid_chroma", lambda x, y: x + y)
    total = F.zip_with(both, F.col("high_chroma"), lambda x, y: x + y)
    return shares.withColumn("total_chroma", total).withColumn("total_chroma", share(F.col("total_chroma")))


def _rotated_profiles() -> Column:
    """24 arrays of weights: the profiles, major before minor, centred, scaled and turned by each of twelve steps."""
    rows = []
    for i in range(12):
        for profile in (MAJOR_PROFILE, MINOR_PROFILE):
            centre = sum(profile) / 12
            scale = math.sqrt(sum((p - centre) ** 2 for p in profile))
            rows.append(", ".join(f"{(profile[(m + i) % 12] - centre) / scale!r}D" for m in range(12)))
    return F.expr(f"array({', '.join(f'array({row})' for row in rows)})")


def _key_scores(values: Column) -> Column:
    """Array of (score, -order) of the correlation of each rotation of values with the two profiles.

    Rotating values by i against a profile is the same as weighing value m by the profile's entry m + i."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / 12
    spread = norm(F.transform(values, lambda x: x - mean))
    one = lambda n: lambda w, k: F.struct(F.try_divide(dot(values, w), n).alias("score"), (-k).alias("order"))
    return bound(spread, lambda n: F.transform(_rotated_profiles(), one(n)))


def key(chromas: DataFrame) -> DataFrame:
    """key label, its strength and its place on the circle.

    The label names the rotation (so it mirrors the tonic); tonic holds the pitch class that the rotation stands
    for.  A constant chroma has no key: all four are null."""
    flat = F.array_max("total_chroma") == F.array_min("total_chroma")
    best = chromas.withColumn("best", F.when(~flat, F.array_max(_key_scores(F.col("total_chroma")))))
    order = -F.col("best.order")
    names = F.array(*[F.lit(f"{c} {mode}") for c in PITCH_CLASSES for mode in ("major", "minor")])
    number = F.floor(order / 2).cast("int")
    angle = number * (2 * math.pi / 12)
    return best.select(
        "track_id",
        F.get(names, order).alias("key"),
        F.col("best.score").alias("key_strength"),
        F.cos(angle).alias("key_cos"),
        F.sin(angle).alias("key_sin"),
        F.get(F.array(*[F.lit(c) for c in PITCH_CLASSES]), F.pmod(12 - number, F.lit(12))).alias("tonic"),
    )


def _entropies(song: DataFrame, bins: int) -> DataFrame:
    """track_id, kind, entropy where there are values."""
    order = W.partitionBy("track_id").orderBy("onset", "note_seq")
    values = song.where(~F.col("is_drum")).select(
        "track_id",
        F.col("pitch").cast("double").alias("pitch"),
        (F.col("release") - F.col("onset")).alias("duration"),
        (F.col("onset") - F.lag("onset").over(order)).alias("ioi"),
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("pitch", "duration", "ioi")])).alias("pair")
    long = values.select("track_id", pairs).select("track_id", "pair.kind", "pair.value").where(F.col("value").isNotNull())
    whole = W.partitionBy("track_id", "kind")
    ranged = long.select("track_id", "kind", "value", F.min("value").over(whole).alias("low"), F.max("value").over(whole).alias("high"))
    placed = ranged.select("track_id", "kind", equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
    counted = placed.groupBy("track_id", "kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    part = F.col("n") / F.sum("n").over(whole)
    terms = counted.select("track_id", "kind", (-part * F.ln(part)).alias("term"))
    # Summed in one order (there are at most as many terms as bins), so that equal tracks have equal entropies to the last bit.
    return terms.groupBy("track_id", "kind").agg(total(F.array_sort(F.collect_list("term"))).alias("entropy"))


def entropies(song: DataFrame, bins: int = ENTROPY_BINS) -> DataFrame:
    """kind (pitch, duration, ioi) and the entropy, in nats, of its histogram of equal-width bins."""
    found = _entropies(song, bins)
    kinds = song.where(~F.col("is_drum")).select("track_id").distinct().select("track_id", F.explode(F.array(F.lit("pitch"), F.lit("duration"), F.lit("ioi"))).alias("kind"))
    return kinds.join(found, ["track_id", "kind"], "left").select("track_id", "kind", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def _log_counts(song: DataFrame) -> DataFrame:
    """track_id, kind, counts where there are values: every note under all kinds that it belongs to, so that one reading of the
    notes serves all of them."""
    plain, top = ~F.col("is_drum"), F.row_number().over(W.partitionBy("track_id", "onset", "is_drum").orderBy(F.desc("pitch"), "note_seq")) == 1
    held = {"ioi": plain, "duration": plain, "drum_ioi": F.col("is_drum"), "bass_ioi": plain & (F.col("pitch") < N.LOW_MAX), "melody_ioi": plain & F.col("top")}
    kinds = F.explode(F.array_compact(F.array(*[F.when(is_in, F.lit(kind)) for kind, is_in in held.items()]))).alias("kind")
    notes = song.withColumn("top", top).select("track_id", "onset", "release", kinds)
    gap = F.col("onset") - F.lag("onset").over(W.partitionBy("track_id", "kind").orderBy("onset"))
    values = notes.select("track_id", "kind", F.when(F.col("kind") == "duration", F.col("release") - F.col("onset")).otherwise(gap).alias("value"))
    values = values.where(F.col("value").isNotNull())
    return values.groupBy("track_id", "kind").agg(F.array(*edge_counts(F.col("value"), LOG_EDGES)).alias("counts"))


def log_histograms(song: DataFrame) -> DataFrame:
    """kind (ioi, duration, drum_ioi, bass_ioi, melody_ioi) and shares of its values in ten log-spaced bins."""
    counted = _log_counts(song)
    kinds = [F.lit(k) for k in ("ioi", "duration", "drum_ioi", "bass_ioi", "melody_ioi")]
    wanted = song.select("track_id").distinct().select("track_id", F.explode(F.array(*kinds)).alias("kind"))
    empty = F.array_repeat(F.lit(0.0), 10)
    return wanted.join(counted, ["track_id", "kind"], "left").select("track_id", "kind", F.coalesce(share(F.col("counts")), empty).alias("hist"))


def densities(song: DataFrame) -> DataFrame:
    """Notes a second over the sounding span of all, drum, bass and melody notes; 0 below two notes."""
    def density(rows: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        span = F.max("release") - F.min("onset") + TINY
        return rows.groupBy("track_id").agg(F.when(n >= 2, n / span).otherwise(0.0).alias(name))

    plain = song.where(~F.col("is_drum"))
    out = density(plain, "note_density")
    parts = {"drum_density": song.where("is_drum"), "bass_density": N.melodic(song).where("register = 'low'"), "melody_density": N.melody(song)}
    for name, rows in parts.items():
        out = out.join(density(rows, name), "track_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def structure(song: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Segment chroma (one array for each of `segments` equal spans between first and last onset), chord roots,
    harmonic rhythm and mean variation.  The last onset belongs to no segment.  Songs under ten notes have no row."""
    whole = W.partitionBy("track_id")
    notes = song.where(~F.col("is_drum")).select(
        "track_id", "pitch", "onset", F.min("onset").over(whole).alias("low"), F.max("onset").over(whole).alias("high"), F.count(F.lit(1)).over(whole).alias("n")
    )
    notes = notes.where(F.col("n") >= LEAST_SEGMENT_NOTES)
    placed = notes.withColumn("segment", equal_width_bin(F.col("onset"), F.col("low"), F.col("high"), segments, closed=False))
    counted = placed.groupBy("track_id", "segment").agg(pitch_class_counts(F.col("pitch"), F.lit(True)).alias("counts"))
    found = F.map_from_entries(F.filter(F.collect_list(F.struct("segment", "counts")), lambda s: s["segment"].isNotNull()))
    silent = F.array_repeat(F.lit(0).cast("long"), 12)
    rows = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: share(F.coalesce(F.col("found")[s], silent)))
    chromas = counted.groupBy("track_id").agg(found.alias("found")).select("track_id", rows.alias("segment_chroma"))
    roots = chromas.withColumn("chord_progression", F.transform("segment_chroma", first_argmax))
    first = F.slice("chord_progression", 1, segments - 1)
    rest = F.slice("chord_progression", 2, segments - 1)
    changed = F.zip_with(first, rest, lambda a, b: (a != b).cast("double"))
    step = F.zip_with(
        F.slice("segment_chroma", 1, segments - 1), F.slice("segment_chroma", 2, segments - 1), lambda a, b: norm(F.zip_with(a, b, lambda x, y: x - y))
    )
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / (segments - 1)
    return roots.withColumn("harmonic_rhythm", mean(changed)).withColumn("segment_variation", mean(step))


def vector_features(song: DataFrame) -> DataFrame:
    """The features that enter a vector, one row for each track; structure columns are null under ten notes.

    Over a note_table no part of it moves a row: all groupings, windows and joins are on the track."""
    sounds = ("pitch", "duration", "ioi")
    kinds = ("ioi", "duration", "drum_ioi", "bass_ioi", "melody_ioi")
    entropy = _entropies(song, ENTROPY_BINS).groupBy("track_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("entropy"))).alias(f"{k}_entropy") for k in sounds])
    hists = _log_counts(song).groupBy("track_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("counts"))).alias(k) for k in kinds])
    chromas = chroma(song)
    out = basic_stats(song)
    for part in (chromas, key(chromas), entropy, hists, densities(song), structure(song)):
        out = out.join(part, "track_id", "left")
    filled = {f"{k}_entropy": F.coalesce(f"{k}_entropy", F.lit(0.0)) for k in sounds}
    filled |= {f"{k}_hist": F.coalesce(share(F.col(k)), F.array_repeat(F.lit(0.0), 10)) for k in kinds}
    return out.withColumns(filled).drop(*kinds)


def song_features(song: DataFrame) -> DataFrame:
    """All features of a song: those of vector_features, the interval lines and the raw n-gram counts."""
    steps = N.intervals(N.streams(song))
    listed = F.array_sort(F.collect_list(F.struct("pos", "step")))
    lines = steps.groupBy("track_id").pivot("stream", ["melody", *REGISTERS]).agg(F.transform(listed, lambda s: s["step"]))
    lines = lines.select("track_id", *[F.col(k).alias(f"{k}_intervals") for k in ("melody", *REGISTERS)])
    counts = N.ngram_counts(N.ngrams(steps)).groupBy("track_id").pivot("stream", ["melody", *REGISTERS]).agg(F.map_from_entries(F.collect_list(F.struct("ngram", F.col("n").cast("int")))))
    counts = counts.select("track_id", *[F.col(k).alias(f"{k}_ngrams") for k in ("melody", *REGISTERS)])
    return vector_features(song).join(lines, "track_id", "left").join(counts, "track_id", "left")
