"""Neighbourhood graphs and shortest paths over the directed nearest-neighbour graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .knn import Corpus

_TYPES = ("query", "hop_1", "hop_2")


def named(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """ids with title and artist_name.  They are few (a path, or up to two hops), so they go to the metadata, which is not sent anywhere."""
    found = metadata.select("id", "title", "artist_name").join(F.broadcast(ids.select("id")), "id", "left_semi")
    return ids.join(found, "id", "left")


def _typed(ranks: DataFrame, metadata: DataFrame) -> DataFrame:
    best = ranks.groupBy("id").agg(F.min("rank").alias("rank"))
    return named(best.select("id", F.get(F.array(*[F.lit(t) for t in _TYPES]), F.col("rank")).alias("type")), metadata)


def one_hop(edges: DataFrame, root: int, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed edges from root; edges: the root's rows of the neighbour graph."""
    out = edges.where(F.col("src") == root).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("score").alias("weight"))
    spark = edges.sparkSession
    ranks = spark.createDataFrame([(root, 0)], "id long, rank int").union(out.select("target", F.lit(1)))
    return _typed(ranks, metadata), out


def two_hop(edges: DataFrame, root: int, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges (source < target, greatest weight) within two hops; edges back to the
    root are left out of the second hop."""
    first = edges.where(F.col("src") == root)
    second = edges.join(first.select(F.col("dst").alias("src")), "src", "left_semi").where(F.col("dst") != root)
    ends = first.select("src", "dst", "score").union(second.select("src", "dst", "score"))
    undirected = ends.groupBy(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).agg(F.max("score").alias("weight"))
    spark = edges.sparkSession
    ranks = spark.createDataFrame([(root, 0)], "id long, rank int").union(first.select("dst", F.lit(1))).union(second.select("dst", F.lit(2)))
    return _typed(ranks, metadata), undirected


def hop_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with hop "1" where an end is the query, else "2"."""
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"))
    both = edges.join(at("source"), "source", "left").join(at("target"), "target", "left")
    near = (F.col("source_type") == "query") | (F.col("target_type") == "query")
    return both.select("source", "target", "weight", F.when(near, "1").otherwise("2").alias("hop"))


def two_hop_edges(vectors: DataFrame, root: int, k: int) -> DataFrame:
    """The neighbour edges a two-hop graph needs: those of the root, then those of its neighbours."""
    corpus = Corpus(vectors)
    first = materialize(corpus.nearest(vectors.where(F.col("id") == root), k), "edges")
    hop = vectors.join(F.broadcast(first.select(F.col("dst").alias("id"))), "id", "left_semi")
    found = materialize(first.union(corpus.nearest(hop, k)), "edges")
    corpus.close()
    return found


def shortest_path(edges: DataFrame | Callable[[DataFrame], DataFrame], start: int, end: int, metadata: DataFrame):
    """Least total of max(0, 1 - similarity) along directed edges.

    edges: src, dst, score; or a function that takes nodes (id) that it hasn't been given before and returns a table that holds the
    edges of all it was given, so that only the part of the graph that the search meets need be made.

    A frontier of improved nodes is relaxed by joins until no open node could still shorten the way to end; costs only
    fall, so that ends.  Once end is reached, nodes that are farther than it are neither kept open nor asked for.
    Each node keeps its least (cost, hops, predecessor), so zero-cost edges can't make a cycle.  Only
    single numbers and the path itself, one row a step, reach the driver; each round's distances are fixed in
    a written table.  Returns nodes, edges and the total; if end can't be reached, empty tables and None."""
    spark = metadata.sparkSession
    walk = "position int, source long, target long, similarity double, cost double"
    node = lambda i, t, p: (i, t, p)
    if start == end:
        nodes = spark.createDataFrame([node(start, "start", 0)], "id long, type string, position int")
        return named(nodes, metadata), spark.createDataFrame([], walk), 0.0
    known = spark.createDataFrame([(start, 0.0, 0, -1, True, False)], "id long, cost double, hops int, previous long, open boolean, asked boolean")
    total = None
    while True:
        near = F.col("open") if total is None else F.col("open") & (F.col("cost") <= total)
        frontier = known.where(near)
        table = edges(frontier.where(~F.col("asked")).select("id")) if callable(edges) else edges
        costs = table.select("src", "dst", F.greatest(F.lit(0.0), 1 - F.col("score")).alias("step"))
        offers = frontier.join(costs, frontier.id == costs.src).select(
            F.col("dst").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("previous"), F.lit(False).alias("asked"), F.lit(False).alias("old")
        )
        if total is not None:
            offers = offers.where(F.col("cost") <= total)
        order = F.struct("cost", "hops", "previous")
        both = known.select("id", "cost", "hops", "previous", (F.col("asked") | near).alias("asked"), F.lit(True).alias("old")).union(offers)
        best = both.groupBy("id").agg(F.min(order).alias("b"), F.min(F.when(F.col("old"), order)).alias("was"), F.max("asked").alias("asked"))
        known = materialize(best.select("id", "b.cost", "b.hops", "b.previous", (F.col("was").isNull() | (F.col("was") != F.col("b"))).alias("open"), "asked"), "distances")
        row = known.agg(F.min(F.when(F.col("open"), F.col("cost"))).alias("least"), F.min(F.when(F.col("id") == end, F.col("cost"))).alias("total")).first()
        total = row["total"]
        if row["least"] is None or (total is not None and total < row["least"]):
            break
    if total is None:
        return named(spark.createDataFrame([], "id long, type string, position int"), metadata), spark.createDataFrame([], walk), None
    path, at = [end], end
    while at != start:  # one look-up for each step of the path
        at = known.where(F.col("id") == at).select("previous").first()[0]
        path.append(at)
    path.reverse()
    typed = [node(i, "start" if i == start else "end" if i == end else "path", p) for p, i in enumerate(path)]
    nodes = named(spark.createDataFrame(typed, "id long, type string, position int"), metadata)
    pairs = spark.createDataFrame([(p, a, b) for p, (a, b) in enumerate(zip(path, path[1:], strict=False))], "position int, source long, target long")
    joined = F.broadcast(pairs).join(table, (F.col("source") == F.col("src")) & (F.col("target") == F.col("dst")))
    walked = joined.select("position", "source", "target", F.col("score").alias("similarity"), (1 - F.col("score")).alias("cost"))
    return nodes, walked, total
