"""The batch build: notes to features, groups, vectors and the neighbour graph, a Parquet table at each stage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..operators import notes as N
from ..operators.features import song_features
from ..operators.knn import nearest
from ..operators.vectors import embed, feature_groups, index_weights, standardise, vocabulary
from ..schemas import GROUPS
from ..sources.scratch import materialize
from ..sources.stages import Stages, made_from, rows_digest


#: To be raised when the rows that a stage makes from the same input change.
VERSION = 1


def build(
    spark: SparkSession,
    notes: DataFrame,
    tracks: DataFrame,
    folder: str,
    weights: dict[str, float] | None = None,
    best_weighting: DataFrame | None = None,
    k: int = 10,
    force: bool = False,
    extract: Callable[[DataFrame], DataFrame] = song_features,
    version: str | None = None,
    stages: Stages | None = None,
) -> dict[str, DataFrame]:
    """Write and return features, metadata, groups, embeddings and knn_edges below folder, and write the weights in use.

    A stage is read instead of built if it was made from the same: the inputs' rows, extract's name and code, VERSION, the stages
    before it and its own parameters.  So new weights make embeddings and edges anew, another k only edges, other notes all that
    follows from them.  The inputs' state is a digest of their rows (one reading of notes and tracks), or
    version, where the caller has a name for it, such as a snapshot's.  force builds all.  The vectors are weighted by weights,
    else by a saved best weighting, else evenly.  extract: any function from song
    notes to one row a track.  tracks: track_id, title, artist_name, file_order."""
    stages = stages or Stages(spark, folder, force)
    seen, named = (version, version) if version is not None else (rows_digest(notes), rows_digest(tracks))
    song = functools.cache(lambda: materialize(N.song_notes(notes), "song"))
    made = {"features": made_from(version=VERSION, notes=seen, tracks=named, extract=_name(extract))}
    features = stages.get("features", made["features"], lambda: cleaning.drop_duplicates(extract(song()), tracks))
    made["metadata"] = made_from(features=made["features"], tracks=named)
    metadata = stages.get("metadata", made["metadata"], lambda: cleaning.reindex(tracks, features).withColumn("id", F.col("faiss_id")))

    def grouped() -> DataFrame:
        kept = song().join(features.select("track_id"), "track_id", "left_semi")
        counts = materialize(N.ngram_counts(N.ngrams(N.intervals(N.streams(kept)))), "counts")
        return _numbered(standardise(feature_groups(features, counts, materialize(vocabulary(counts), "vocab"))), metadata)

    made["groups"] = made_from(metadata=made["metadata"], notes=seen)
    groups = stages.get("groups", made["groups"], grouped)
    used = {g: float((weights or {}).get(g, 1.0)) for g in GROUPS} if weights else index_weights(best_weighting)
    made["embeddings"] = made_from(groups=made["groups"], weights=used)
    embeddings = stages.get("embeddings", made["embeddings"], lambda: embed(groups, used).select("id", "track_id", "embedding"))
    row = lambda: spark.createDataFrame([tuple(used.values())], ", ".join(f"weight_{g} double" for g in used))
    stages.get("weights", made_from(weights=used), row)
    edges = stages.get("knn_edges", made_from(embeddings=made["embeddings"], k=k), lambda: nearest(embeddings, embeddings, k))
    return {"features": features, "metadata": metadata, "groups": groups, "embeddings": embeddings, "knn_edges": edges}


def _name(function: Callable) -> str:
    """Module, name and compiled code of a function; of other callables what they print as, which may build anew too often."""
    code = getattr(function, "__code__", None)
    return f"{function.__module__}.{function.__qualname__}:{code.co_code.hex()}" if code else repr(function)


def _numbered(grouped: DataFrame, metadata: DataFrame) -> DataFrame:
    return grouped.join(metadata.select("track_id", "id"), "track_id")
