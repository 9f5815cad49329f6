"""Titles and artists are as many as there are tracks, so no query sends all of them through the driver to name a few."""

import pytest
from pyspark.sql import functions as F

from tonegraph import queries as core

TIMES = 100


@pytest.fixture(scope="module")
def grown(spark, small, tmp_path_factory):
    """The tables with many tracks: they are still small files, which Spark likes to broadcast."""
    folder = str(tmp_path_factory.mktemp("grown"))
    copies = spark.range(TIMES).select(F.col("id").alias("k"))
    part = spark.read.parquet(f"{small}/part.parquet")
    most = part.agg(F.max("p_partkey") + 1).first()[0]
    part.crossJoin(copies).withColumn("p_partkey", F.col("p_partkey") + most * F.col("k")).drop("k").write.parquet(f"{folder}/part.parquet")
    for name in ("embeddings", "orders"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, part.count() * TIMES


def broadcast_rows(spark):
    """Rows that each execution's broadcasts collected."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    listed = store.executionsList()
    for i in range(listed.size()):
        key = listed.apply(i).executionId()
        values, nodes, total = store.executionMetrics(key), store.planGraph(key).allNodes(), 0
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for m in range(node.metrics().size()) if node.name() == "BroadcastExchange" else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
        out[key] = total
    return out


@pytest.mark.parametrize("name", ["two_hop_graph", "explorer_weights", "one_hop_graph", "edge_hops", "explorer_neighbours", "explorer_two_hop", "explorer_path", "shortest_path", "knn_topk"])
def test_few_rows_are_broadcast(spark, grown, name):
    folder, all_names = grown
    before = broadcast_rows(spark)
    assert core.queries()[name](spark, folder).count() > 0
    sent = sum(n for key, n in broadcast_rows(spark).items() if key not in before)
    assert sent < all_names  # neighbours and nodes met, never the names
