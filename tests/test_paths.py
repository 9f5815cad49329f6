"""A search for a path asks for few edges, and compares all songs at once where it meets many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.explorer import Explorer
from tonegraph.operators import graph, knn
from tonegraph.operators.metric_index import MetricIndex

from .test_graph import dijkstra, vectors


def test_no_node_is_asked_for_twice_nor_beyond_the_end(spark):
    steps = [(0, 1, 0.1), (0, 6, 0.5), (1, 3, 0.1), (1, 2, 0.9), (1, 5, 0.05), (5, 6, 0.01), (6, 7, 0.01), (2, 8, 0.1)]
    table = spark.createDataFrame([(a, b, 1 - c) for a, b, c in steps], "src long, dst long, score double")
    named = spark.createDataFrame([(k, "t", "a") for k in range(9)], "id long, title string, artist_name string")
    asked = []

    def expand(nodes):
        asked.extend(r.id for r in nodes.collect())
        return table

    nodes, edges, total = graph.shortest_path(expand, 0, 3, named)
    assert math.isclose(total, 0.2) and [r.id for r in nodes.orderBy("position").collect()] == [0, 1, 3]
    assert len(asked) == len(set(asked))  # 6 comes nearer after it was asked for
    assert 2 not in asked and 8 not in asked


def test_many_nodes_are_compared_at_once(spark, monkeypatch):
    x, df = vectors(spark)
    e, calls = Explorer(df.drop("embedding"), df.select("id", "embedding")), []
    whole = knn.Corpus.nearest
    monkeypatch.setattr(knn.Corpus, "nearest", lambda self, queries, k, report=None: calls.append(1) or whole(self, queries, k, report))
    nodes, _, total = e.path(3, 44, 4)
    want = dijkstra(x, 3, 44, 4)
    assert math.isclose(total, want[0], abs_tol=1e-9) and [r.id for r in nodes.orderBy("position").collect()] == want[1]
    assert len(calls) <= 2  # not one for each round


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e17])
def test_order_is_that_of_double_precision(spark, scale):
    """Scores that single precision can't tell apart, and lengths it can't hold."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(6, 40))[rng.integers(0, 6, 300)] + 1e-7 * rng.normal(size=(300, 40))) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    score = (x[:, None, :] * x[None, :, :]).sum(2)
    np.fill_diagonal(score, -np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(300), score.shape), -score), axis=1)[:, :5].tolist()
    few = df.where("id < 7")
    for found in (knn.nearest(df, df, 5), knn.nearest(few, df, 5, broadcast_bytes=40 * 8 * 7), MetricIndex(df, block=32).search(few, 5), MetricIndex(df, block=32).search(df, 5)):
        got = found.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda r: r["dst"]).alias("d")).collect()
        assert len(got) in (7, 300) and {r.src: r.d for r in got} == {r.src: want[r.src] for r in got}
