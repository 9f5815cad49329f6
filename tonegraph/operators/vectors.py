"""From features to weighted unit vectors: vocabularies, nine groups, standardisation, weights, norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import unit
from ..schemas import DEFAULT_WEIGHTS, GROUPS, VOCABULARY

#: Columns of the dense groups in vector order.
STATS = ("note_count", "mean_pitch", "std_pitch", "pitch_range", "mean_duration", "std_duration", "mean_velocity", "std_velocity", "mean_instruments")


#: Distance from 1 to the next double.
EPSILON = 2.0**-52


def vocabulary(counts: DataFrame, sizes: dict[str, int] = VOCABULARY) -> DataFrame:
    """stream, ngram, df, idx: the n-grams of most tracks; ties go to the one seen first (track, then place)."""
    seen = counts.groupBy("stream", "ngram").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("track_id", "first_pos")).alias("first_seen"))
    order = W.partitionBy("stream").orderBy(F.desc("df"), "first_seen", "ngram")
    most = F.element_at(F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))]), F.col("stream"))
    # The limit is on the rank itself, so that Spark keeps the best of each task before the exchange.
    ranked = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(sizes.values()))
    return ranked.where(F.col("rank") <= most).select("stream", "ngram", "df", (F.col("rank") - 1).alias("idx"))


def relative_frequencies(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """track_id, stream, idx, value: an n-gram's share of all n-grams of the stream, known or not."""
    whole = W.partitionBy("track_id", "stream")
    shared = counts.withColumn("value", F.col("n") / F.sum("n").over(whole))
    small = F.broadcast(vocab.select("stream", "ngram", "idx"))  # at most the sum of VOCABULARY
    return shared.join(small, ["stream", "ngram"]).select("track_id", "stream", "idx", "value")


def feature_groups(features: DataFrame, counts: DataFrame, vocab: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """One row for each track with structure features: nine arrays of doubles.

    sizes: length of each n-gram group; by default as long as its vocabulary."""
    if sizes is None:
        sizes = {r["stream"]: r["n"] for r in vocab.groupBy("stream").agg((F.max("idx") + 1).alias("n")).collect()}
    doubles = lambda *cs: F.array(*[F.col(c).cast("double") for c in cs])
    dense = features.where(F.col("segment_chroma").isNotNull()).select(
        "track_id",
        doubles(*STATS).alias("stats"),
        F.concat("total_chroma", "low_chroma", "mid_chroma", "high_chroma", doubles("key_strength", "key_cos", "key_sin")).alias("chroma"),
        doubles("pitch_entropy", "duration_entropy", "ioi_entropy").alias("entropy"),
        F.concat("ioi_hist", "duration_hist", "drum_ioi_hist", "bass_ioi_hist", "melody_ioi_hist", doubles("note_density", "drum_density", "bass_density", "melody_density")).alias("rhythm"),
        F.concat(F.flatten("segment_chroma"), F.transform("chord_progression", lambda x: x.cast("double")), doubles("harmonic_rhythm", "segment_variation")).alias("structure"),
    )
    found = relative_frequencies(counts, vocab)
    pairs = F.map_from_entries(F.collect_list(F.struct("idx", "value")))
    maps = found.groupBy("track_id").pivot("stream", list(VOCABULARY)).agg(pairs)

    def scattered(stream: str):
        n = sizes.get(stream, 0)
        places = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.expr("cast(array() as array<int>)")
        return F.transform(places, lambda i: F.coalesce(F.col(stream)[i], F.lit(0.0)))

    filled = dense.join(maps, "track_id", "left").withColumns({s: scattered(s) for s in VOCABULARY})
    return filled.select("track_id", *GROUPS)


def dimension_stats(grouped: DataFrame, groups=GROUPS, id_column: str = "track_id") -> DataFrame:
    """grp, pos, mean, std (population) of each dimension, and n, the rows."""
    out = None
    for g in groups:
        part = grouped.select(F.lit(g).alias("grp"), F.posexplode(g).alias("pos", "value"))
        out = part if out is None else out.union(part)
    return out.groupBy("grp", "pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def constant(s: Column) -> Column:
    """Whether a deviation is no more than rounding makes of equal values.  s: mean, std, n."""
    noise = s["n"] * EPSILON * s["mean"]
    return s["std"] * s["std"] <= s["n"] * EPSILON * s["std"] * s["std"] + noise * noise


def standardise(grouped: DataFrame, skip=("chroma",), groups=GROUPS) -> DataFrame:
    """Each group but those in skip as z-scores; a dimension that is constant but for rounding is only centred.

    The means and deviations are one row of arrays, as long as a vector, and are broadcast."""
    stats = dimension_stats(grouped, [g for g in groups if g not in skip])
    listed = F.array_sort(F.collect_list(F.struct("pos", "mean", "std", "n")))
    row = stats.groupBy().pivot("grp", [g for g in groups if g not in skip]).agg(listed)
    row = row.select(*[F.col(g).alias(f"__{g}") for g in groups if g not in skip])

    def scaled(g: str):
        divisor = lambda s: F.when(constant(s), 1.0).otherwise(s["std"])
        return F.zip_with(F.col(g), F.col(f"__{g}"), lambda x, s: (x - s["mean"]) / divisor(s)).alias(g)

    rest = [c for c in grouped.columns if c not in groups]
    return grouped.join(F.broadcast(row)).select(*rest, *[g if g in skip else scaled(g) for g in groups])


def resolve_weights(weights: dict[str, float] | None, defaults: dict[str, float] = DEFAULT_WEIGHTS) -> dict[str, float]:
    """A weight for each group: defaults for missing keys, unknown keys ignored, not all zero."""
    out = {g: float((weights or {}).get(g, defaults[g])) for g in GROUPS}
    if not any(out.values()):
        raise ValueError("at least one weight must differ from zero")
    return out


def embed(grouped: DataFrame, weights: dict[str, float], groups=GROUPS) -> DataFrame:
    """Weighted groups in order, as one unit vector."""
    def scaled(group: str):
        weight = F.lit(float(weights.get(group, 1.0)))
        return F.transform(group, lambda x: x * weight)

    parts = [scaled(g) for g in groups]
    rest = [c for c in grouped.columns if c not in groups]
    return grouped.select(*rest, unit(F.concat(*parts)).alias("embedding"))


def index_weights(best: DataFrame | None = None) -> dict[str, float]:
    """The weights an index is built with: those of a saved best weighting (its first row), else 1 for each group."""
    row = best.limit(1).first() if best is not None else None
    return {g: float(row[f"weight_{g}"]) if row else 1.0 for g in GROUPS}
