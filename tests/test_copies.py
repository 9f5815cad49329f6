"""Equal vectors are compared once, with the rows and the order of comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.operators import features, knn
from tonegraph.operators.metric_index import MetricIndex


def corpus(kind):
    rng = np.random.default_rng(8)
    if kind == "many":  # 25 different ones, of 1 to 60 copies, in no order
        x = np.repeat(rng.normal(size=(25, 12)), rng.integers(1, 60, 25), axis=0)
    elif kind == "hot":  # most are one vector, some zero (of either sign)
        x = np.concatenate((np.repeat(rng.normal(size=(1, 12)), 300, axis=0), np.zeros((40, 12)), -np.zeros((40, 12)), rng.normal(size=(60, 12))))
    else:  # different vectors of equal scores: unit vectors along axes, which no score tells apart
        x = np.repeat(np.eye(12), 9, axis=0)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("kind", ["many", "hot", "axes"])
@pytest.mark.parametrize("k", [1, 4, 70])
def test_copies_take_the_places_of_those_they_equal(spark, kind, k):
    x = corpus(kind)
    df = spark.createDataFrame([(3 * i + 1, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    every, n = np.arange(len(x)), len(x)
    score = knn.dots(x, x, np.repeat(every, n), np.tile(every, n)).reshape(n, n)
    np.fill_diagonal(score, -np.inf)
    want = np.lexsort((np.broadcast_to(every, score.shape), -score), axis=1)[:, : min(k, n - 1)]
    asked = knn.Corpus(df, block=16, broadcast_bytes=8 * 12 * 8)
    found = asked.nearest(df, k)
    got = {}
    for r in found.orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.score))
    assert got == {3 * i + 1: [(p + 1, 3 * j + 1, score[i, j]) for p, j in enumerate(want[i].tolist())] for i in range(n)}
    assert found.dtypes == knn.nearest(df, df, k).dtypes
    assert asked.copies[2].size[0] < n / 2  # only these were compared


def test_copies_are_not_looked_for_among_few_queries_and_different_vectors(spark):
    x = np.random.default_rng(2).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = knn.Corpus(df, block=16, broadcast_bytes=8 * 8 * 8)
    key = lambda r: (r.src, r["rank"], r.dst)
    assert sorted(map(key, asked.nearest(df, 3).collect())) == sorted(map(key, MetricIndex(df, block=16).search(df, 3).collect()))
    assert asked.copies is None


def test_equal_tracks_have_equal_entropies(spark):
    """The order in which a track's bins are met differs with its name."""
    rng = np.random.default_rng(6)
    notes = [(int(p), float(on), float(on + d)) for p, on, d in zip(rng.integers(20, 110, 60), np.cumsum(rng.uniform(0.1, 2, 60)), rng.uniform(0.1, 4, 60), strict=True)]
    one = spark.createDataFrame([(n, False, on, off, p, 80) for n, (p, on, off) in enumerate(notes)], "note_seq long, is_drum boolean, onset double, release double, pitch int, velocity int")
    song = spark.range(300).select(F.col("id").alias("track_id")).crossJoin(one).repartition(16)
    found = features.entropies(song).groupBy("kind").agg(F.countDistinct("entropy").alias("n"), F.first("entropy").alias("e")).collect()
    assert len(found) == 3 and all(r.n == 1 and r.e > 0 for r in found)
