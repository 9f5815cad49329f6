"""Neighbours by blocks around pivots are those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.operators import knn
from tonegraph.operators.metric_index import MetricIndex, Report, bounds
from tonegraph.sources.scratch import materialize


def table(kind, n=700, d=12, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        x = rng.normal(size=(n, d))
    elif kind == "clustered":
        x = rng.normal(size=(25, d))[rng.integers(0, 25, n)] + 0.02 * rng.normal(size=(n, d))
    else:  # a third of all rows are one vector, some are zero, norms differ
        x = rng.normal(size=(n, d)) * rng.choice([0.0, 0.1, 1.0, 5.0], (n, 1))
        x[: n // 3] = x[-1]
        return x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies"])
def test_equal_to_brute_force(spark, kind):
    x = table(kind)
    df, report = frame(spark, x), Report()
    got = MetricIndex(df, block=32).search(df, 5, report)
    want = knn.nearest(df, df, 5)  # every pair
    key = lambda r: (r.src, r["rank"], round(r.score, 9), r.dst if kind != "copies" else 0)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert report.pairs and report.searched <= report.pairs
    if kind == "clustered":
        assert report.skipped_share > 0.7  # most blocks are never compared
    if kind == "copies":
        first = [r.dst for r in got.where("src = 0").orderBy("rank").collect()]
        assert first == [1, 2, 3, 4, 5] or x[0] @ x[0] < max(x[0] @ v for v in x)  # ties go by id


def test_bounds_hold(spark):
    x = table("copies", 300)
    index = MetricIndex(frame(spark, x), block=16)
    names, rings = index.rings.value
    bound = bounds(x, index.pivots.value, rings)
    rows = index.blocks.collect()
    assert len(rows) == len(x) and max(index.blocks.groupBy("block").count().toPandas()["count"]) <= 16
    at = {b: i for i, b in enumerate(names)}
    for r in rows:
        assert (x @ np.array(r.embedding) <= bound[:, at[r.block]] + 1e-12).all()


def test_few_rows_and_none(spark):
    df = frame(spark, table("uniform", 3))
    index = MetricIndex(df, block=2)
    assert index.search(df, 10).groupBy("src").count().agg(F.max("count")).first()[0] == 2
    assert index.search(df.limit(0), 3).collect() == []
    assert MetricIndex(df.limit(0)).search(df, 3).collect() == []


def test_a_corpus_is_sent_once(spark):
    df = frame(spark, table("uniform", 50))
    corpus = knn.Corpus(df)
    a, shared = corpus.nearest(df.where("id < 5"), 2).count(), corpus._shared
    assert corpus.nearest(df.where("id >= 5"), 2).count() + a == 100 and corpus._shared is shared
    corpus.close()
    assert corpus._shared is None


def test_no_vector_is_copied_for_a_block(spark):
    """What is exchanged and written grows with the rows, not with pairs of a query and a block, also where no bound rules out anything."""
    tasks = lambda: spark._jsparkSession.sharedState().statusStore()
    moved = {}
    for n in (400, 1600):
        x = table("uniform", n, 32)
        df = materialize(frame(spark, x), "given")
        before = executions(tasks())
        report = Report()
        found = MetricIndex(df, block=8).search(df, 3, report)
        assert found.count() == 3 * n and report.skipped_share < 0.5
        moved[n] = sum(rows for i, rows in executions(tasks()).items() if i not in before)
    assert moved[1600] < 6 * moved[400]  # 16 times as many pairs


def executions(store):
    """Rows that each execution's plan exchanged."""
    out = {}
    listed = store.executionsList()
    for i in range(listed.size()):
        e = listed.apply(i)
        values = store.executionMetrics(e.executionId())
        total = 0
        for j in range(e.metrics().size()):
            m = e.metrics().apply(j)
            if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                total += int(values.apply(m.accumulatorId()).replace(",", ""))
        out[e.executionId()] = total
    return out


@pytest.mark.parametrize("d", [64, 301])
def test_equal_vectors_tie_wherever_they_stand(spark, d):
    """A matrix product may give equal vectors scores that differ in the last bit, and so a wrong order."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, d)), 7, axis=0)[rng.permutation(280)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x)
    same = {i: [j for j in range(280) if j != i and (x[j] == x[i]).all()] for i in range(280)}
    for found in (MetricIndex(df, block=16).search(df, 6), knn.nearest(df, df, 6)):
        got = {}
        for r in found.orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == same


def test_distances_are_taken_in_pieces(spark):
    """Chunks are cut by bytes, other queries than the corpus are found too, and several chunks ask at once."""
    x = table("uniform", 500, 16)
    df = frame(spark, x)
    index = MetricIndex(df, block=16, chunk_bytes=40 * 16 * 8)
    assert index.n_chunks >= 13 and index.chunks.agg(F.max(F.length("vectors"))).first()[0] <= 40 * 16 * 8
    asked = df.where("id % 3 = 0")
    key = lambda r: (r.src, r["rank"], r.dst)
    assert sorted(map(key, index.search(asked, 4).collect())) == sorted(map(key, knn.nearest(asked, df, 4).collect()))


def test_a_worker_holds_little_of_a_large_corpus(spark):
    """What is compared at once has a bound, and a corpus of more than 8 MiB is not sent whole."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(60_000, 4)), np.arange(60_000)
    tracemalloc.start()
    found = knn.best_of(ids[:256], x[:256], ids, x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3 * 256 and peak < 100 << 20
    corpus = knn.Corpus(spark.range(20_000).select("id", F.array_repeat(F.col("id").cast("double"), 64).alias("embedding")))
    assert not corpus.small()
    assert [r.dst for r in corpus.nearest(corpus.vectors.where("id = 5"), 2).orderBy("rank").collect()] == [19_999, 19_998] and corpus._shared is None
