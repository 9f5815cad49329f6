"""Neighbours, graphs, paths, triplets and trials on small made-up inputs."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.explorer import Explorer
from tonegraph.operators import analytics as A
from tonegraph.operators import cleaning, evaluation, graph, knn
from tonegraph.operators.vectors import index_weights, standardise, vocabulary
from tonegraph.plans.weight_search import evaluate
from tonegraph.schemas import GROUPS


def vectors(spark, n=60, d=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[4]  # a duplicate: ties go by id
    rows = [(i, v.tolist(), f"title {i}", f"artist {i % 7}") for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>, title string, artist_name string")


def expected(x, k):
    out = {}
    for i in range(len(x)):
        scores = [(-round(float(x[i] @ x[j]), 12), j) for j in range(len(x)) if j != i]
        out[i] = [j for _, j in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize(("broadcast_bytes", "block"), [(1 << 20, 16), (0, 16), (60 * 64 - 1, 16), (60 * 64 - 1, 64)])
def test_nearest(spark, broadcast_bytes, block):
    x, df = vectors(spark)
    for queries in (df, df.where("id in (4, 5, 17)")):
        got = {}
        for r in knn.nearest(queries, df.repartition(5), 4, block=block, broadcast_bytes=broadcast_bytes).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == {k: v for k, v in expected(x, 4).items() if k in {r.id for r in queries.collect()}}


def test_one_query_reads_a_large_corpus_where_it_lies(spark):
    _, df = vectors(spark)
    plan = knn.nearest(df.where("id = 3"), df, 4, broadcast_bytes=1000)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "Exchange" not in below and "Generate" not in plan  # the corpus is neither copied nor moved


def test_nearest_with_few_vectors(spark):
    _, df = vectors(spark, n=6)
    assert knn.nearest(df, df, 50).groupBy("src").count().select(F.max("count")).first()[0] == 5
    with pytest.raises(ValueError):
        knn.nearest(df, df, 0)


def dijkstra(x, start, end, k):
    near = expected(x, k)
    queue, seen = [(0.0, start, [start])], set()
    while queue:
        cost, at, path = heapq.heappop(queue)
        if at == end:
            return cost, path
        if at in seen:
            continue
        seen.add(at)
        for j in near[at]:
            heapq.heappush(queue, (cost + max(0.0, 1 - float(x[at] @ x[j])), j, [*path, j]))
    return None


def test_a_path_by_edges_made_on_the_way(spark):
    chain = spark.createDataFrame([(k, k + 1, 0.5) for k in range(9)], "src long, dst long, score double")
    named = spark.createDataFrame([(k, "t", "a") for k in range(10)], "id long, title string, artist_name string")
    asked = []

    def expand(nodes):
        asked.extend(r.id for r in nodes.collect())
        return chain

    nodes, edges, total = graph.shortest_path(expand, 0, 4, named)
    assert total == 2.0 and nodes.count() == 5 and edges.count() == 4 and max(asked) <= 4


def test_shortest_path(spark):
    x, df = vectors(spark)
    edges = {k: knn.nearest(df, df, k).persist() for k in (2, 4)}
    reached = 0
    for k, start, end in [(2, 0, 17), (4, 0, 17), (4, 3, 44), (4, 8, 8)]:
        nodes, steps, total = graph.shortest_path(edges[k], start, end, df)
        want = dijkstra(x, start, end, k)
        if want is None:
            assert nodes.count() == 0 and steps.count() == 0 and total is None
            continue
        reached += 1
        assert math.isclose(total, want[0], abs_tol=1e-9)
        assert [r.id for r in nodes.orderBy("position").collect()] == want[1]
        assert steps.count() == len(want[1]) - 1
    assert reached >= 2


def test_two_hop(spark):
    x, df = vectors(spark)
    near = expected(x, 3)
    nodes, edges = graph.two_hop(graph.two_hop_edges(df, 7, 3), 7, df)
    want = {}
    for a, b in [(7, b) for b in near[7]] + [(a, b) for a in near[7] for b in near[a] if b != 7]:
        want[min(a, b), max(a, b)] = max(want.get((min(a, b), max(a, b)), -2), round(float(x[a] @ x[b]), 9))
    assert {(r.source, r.target): round(r.weight, 9) for r in edges.collect()} == want
    types = {r.id: r.type for r in nodes.collect()}
    assert types[7] == "query" and all(types[b] == "hop_1" for b in near[7]) and set(types) == {i for e in want for i in e}
    hops = {(r.source, r.target): r.hop for r in graph.hop_labels(nodes, edges).collect()}
    assert all((h == "1") == (7 in e) for e, h in hops.items())


def grouped(spark, n=30):
    rng = np.random.default_rng(2)
    rows = [(i, *[rng.normal(size=3).tolist() for _ in GROUPS]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, " + ", ".join(f"{g} array<double>" for g in GROUPS))


def test_group_dots_equal_the_cosine_of_joined_vectors(spark):
    rows, df = grouped(spark)
    weights = {g: k * 0.7 for k, g in enumerate(GROUPS)}
    pairs = spark.createDataFrame([(0, 1), (5, 9)], "root long, closer long")
    scored = knn.group_dots(pairs, df, "root", "closer").withColumn("c", knn.weighted_cosine(lambda g: F.lit(weights[g])))
    for r in scored.collect():
        a, b = (np.concatenate([np.array(v) * weights[g] for g, v in zip(GROUPS, rows[i][1:])]) for i in (r.root, r.closer))
        assert math.isclose(r.c, a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs_tol=1e-12)


def test_trials(spark, monkeypatch):
    rows, df = grouped(spark)
    triplets = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(20)], "triplet long, root long, closer long, further long")
    dots = evaluation.triplet_dots(triplets, df)
    grid = evaluation.weight_grid(spark).where("trial in (0, 1, 777, 19682)")
    got = {r.trial: r for r in evaluation.score_trials(grid, dots).collect()}
    assert got[0].accuracy == 0.0 and got[0].mean_margin == 0.0  # no weight at all
    assert [got[1][f"weight_{g}"] for g in GROUPS] == [0.0] * 8 + [2.5]
    x = {i: np.concatenate([np.array(v) * got[777][f"weight_{g}"] for g, v in zip(GROUPS, r)]) for i, *r in rows}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    margins = np.array([x[k] @ x[k + 1] - x[k] @ x[k + 2] for k in range(20)])
    r = got[777]
    assert math.isclose(r.accuracy, (margins > 0).mean()) and math.isclose(r.median_margin, np.median(margins), abs_tol=1e-12)
    assert math.isclose(r.std_margin, margins.std(), abs_tol=1e-12)
    monkeypatch.setattr(evaluation, "BROADCAST_TRIPLETS", 7)
    again = {r.trial: r for r in evaluation.score_trials(grid, dots).collect()}
    assert again.keys() == got.keys() and math.isclose(again[777].mean_margin, r.mean_margin, abs_tol=1e-12)


def test_weights(spark):
    assert evaluation.weight_grid(spark).count() == 3**9
    drawn = evaluation.random_weights(spark, trials=4000)
    assert A.weight_dispersion(drawn.withColumn("accuracy", F.lit(1.0)), 4000).select(F.avg("dispersion")).first()[0] == pytest.approx(12**-0.5, abs=0.01)


def test_weight_evaluation_is_saved(spark, tmp_path):
    _, df = grouped(spark)
    triplets = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(20)], "triplet long, root long, closer long, further long")
    scored, best = evaluate(df, triplets, trials=50, folder=str(tmp_path))
    rows = scored.collect()
    assert len(rows) == 50 + 3**9 and {r.trial for r in rows} == set(range(50 + 3**9))
    assert sorted(((-r.accuracy, r.trial) for r in rows)) == [(-r.accuracy, r.trial) for r in spark.read.parquet(str(tmp_path / "weight_evaluation")).orderBy(F.desc("accuracy"), "trial").collect()]
    top = min(rows, key=lambda r: (-r.accuracy, r.trial))
    assert best.collect() == [tuple(top[f"weight_{g}"] for g in GROUPS)]
    assert index_weights(spark.read.parquet(str(tmp_path / "best_weighting"))) == {g: top[f"weight_{g}"] for g in GROUPS}
    none = evaluation.score_trials(evaluation.weight_grid(spark).limit(3), evaluation.triplet_dots(triplets.limit(0), df))
    assert none.count() == 3


def test_the_vocabulary_is_limited_before_the_exchange(spark):
    counts = spark.createDataFrame([("t", "melody", "1,2,3", 1, 0)], "track_id string, stream string, ngram string, n long, first_pos long")
    assert "WindowGroupLimit" in vocabulary(counts)._jdf.queryExecution().executedPlan().toString()


def test_a_dimension_of_rounding_noise_is_constant(spark):
    rows = [(k, [0.1 * 3 if k % 2 else 0.3, float(k)]) for k in range(50)]
    z = standardise(spark.createDataFrame(rows, "id long, stats array<double>"), skip=(), groups=("stats",)).collect()
    assert max(abs(r.stats[0]) for r in z) < 1e-12 and max(r.stats[1] for r in z) > 1


def test_triplets(spark):
    numbered = spark.createDataFrame([(i, f"t{i}", f"T{i}", f"A{i}") for i in range(14)], "faiss_id long, track_id string, title string, artist_name string")
    choices = spark.createDataFrame([(0, "a"), (1, "B"), (2, "c"), (3, ""), (4, "a")], "comparison long, choice string")
    t = evaluation.build_triplets(numbered, choices)
    got = {r.comparison: (r.root_track_id, r.closer_track_id, r.further_track_id) for r in t.collect()}
    assert got == {0: ("t0", "t1", "t2"), 1: ("t3", "t5", "t4"), 2: ("t7", "t8", "t6")}
    known = numbered.where("faiss_id < 8").select("track_id", "faiss_id")
    assert evaluation.index_triplets(t, known).count() == 2


def test_duplicates_and_numbers(spark):
    rows = [("a", " Straße ", "X", 0), ("b", "STRASSE", "x", 1), ("c", None, None, 2), ("d", "", "", 3), ("e", "other", "X", 4)]
    tracks = spark.createDataFrame(rows, "track_id string, title string, artist_name string, file_order long")
    got = {r.track_id: (r.kept_track_id, r.is_duplicate) for r in cleaning.duplicate_tracks(tracks).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("c", False), "d": ("c", True), "e": ("e", False)}
    features = tracks.where("track_id <> 'a'").select("track_id")
    assert {r.track_id for r in cleaning.drop_duplicates(features, tracks).collect()} == {"c", "e"}
    assert {r.track_id for r in cleaning.drop_duplicates(features, tracks, after_extract=True).collect()} == {"b", "c", "e"}
    numbers = cleaning.reindex(tracks, features)
    assert [(r.track_id, r.faiss_id) for r in numbers.orderBy("faiss_id").collect()] == [("b", 0), ("c", 1), ("d", 2), ("e", 3)]


def test_search_and_lookup(spark):
    tracks = spark.createDataFrame([("a", "Die Straße", "P.Q"), ("b", "x.y", "z"), ("b", None, None)], "track_id string, title string, artist_name string")
    assert [r.track_id for r in cleaning.search(tracks, "STRASSE").collect()] == ["a"]
    assert [r.track_id for r in cleaning.search(tracks, ".", "title").collect()] == ["b"]
    assert cleaning.search(tracks, "", limit=1).count() == 1 and cleaning.search(tracks, "", limit=0).count() == 2
    assert cleaning.lookup(tracks, "a").first().title == "Die Straße"
    for bad in ("b", "missing"):
        with pytest.raises(ValueError):
            cleaning.lookup(tracks, bad)


def test_explorer(spark):
    x, df = vectors(spark)
    rows, groups = grouped(spark, 60)
    e = Explorer(df.drop("embedding"), df.select("id", "embedding"), groups)
    assert e.search().count() == 0 and e.search("title 1", "artist", 3).count() == 3
    assert [r.id for r in e.neighbours(7, 3).collect()] == expected(x, 3)[7]
    assert e.graph(7, 3)[1].count() == 3 and e.two_hop_graph(7, 2)[0].count() >= 3
    assert e.path(7, 7)[2] == 0.0
    kept = Explorer(df.drop("embedding"), df.select("id", "embedding"), groups, {g: 2.0 for g in GROUPS}, knn.nearest(df, df, 5).persist())
    assert kept.status()["weights"] == {g: 2.0 for g in GROUPS}
    for k in (4, 6):  # from the kept edges, and beyond them
        assert math.isclose(kept.path(3, 44, k)[2], dijkstra(x, 3, 44, k)[0], abs_tol=1e-9)
        assert [r.id for r in kept.neighbours(7, k).collect()] == expected(x, k)[7]
    for call in (lambda: e.song(999), lambda: e.neighbours(7, 0), lambda: e.build_custom(dict.fromkeys(GROUPS, 0))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(RuntimeError):
        e.use_custom()
    assert e.build_custom({"stats": 3})["mode"] == "custom" and e.status()["custom_available"]
    first = [r.id for r in e.neighbours(7, 3).collect()]
    w = e.status()["weights"]
    y = np.array([np.concatenate([np.array(v) * w[g] for g, v in zip(GROUPS, r[1:])]) for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert first == expected(y, 3)[7]
    assert e.use_default()["mode"] == "default" and e.use_custom()["mode"] == "custom"


def test_analytics_guards(spark):
    rows = [(1, 0.5, 1.0, 0.0), (2, 0.7, 1.0, 2.5), (3, 0.0, 1.0, 1.1)]
    trials = spark.createDataFrame(rows, "trial long, accuracy double, std_margin double, weight_a double")
    corr = {(r.column_a, r.column_b): r.corr for r in A.correlations(trials).collect()}
    assert corr["std_margin", "accuracy"] is None and corr["accuracy", "accuracy"] == pytest.approx(1)
    assert A.drop_zero_accuracy(trials).count() == 2
    assert {r.sampling_strategy: r.trials for r in A.strategy_counts(trials).collect()} == {"gridsearch": 2, "uniform_sampled": 1}
    assert A.top_share(trials, 2).first().share == pytest.approx(2 / 3)
