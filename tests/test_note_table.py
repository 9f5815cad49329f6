"""The bucketed note table: same features as from loose notes, and no row moves."""

import re

import pytest

from tonegraph.operators import features as X
from tonegraph.operators import notes as N
from tonegraph.sources.tables import notes


@pytest.fixture(scope="module")
def table(spark, small):
    return N.note_table(notes(spark, small), buckets=4)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (?:hash|range|Round|Single)\w*\(?[^\n]*", plan)


def test_it_holds_the_song_notes(spark, small, table):
    key = lambda df: sorted(tuple(r) for r in df.select("track_id", "note_seq", "onset", "pitch").collect())
    assert key(table) == key(N.song_notes(notes(spark, small)))


@pytest.mark.parametrize("family", [X.basic_stats, X.chroma, X.densities, X.structure, X.vector_features])
def test_features_move_no_rows(spark, table, family):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to send
    try:
        assert exchanges(family(table)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_features_equal_those_of_loose_notes(spark, small, table):
    loose = N.song_notes(notes(spark, small))
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(X.vector_features(table)) == plain(X.vector_features(loose))


def test_tasks_hold_a_bounded_number_of_notes(spark, small, monkeypatch):
    """Partitions by track grow in number with the notes, and nothing joins them again on the way to the n-gram counts."""
    from tonegraph import queries as core

    monkeypatch.setattr(N, "TASK_NOTES", 25)
    found = notes(spark, small)
    parts = N.task_count(found)
    assert parts == -(-found.count() // 25) > 8
    counted = core.queries()["ngram_counts"](spark, small)
    assert counted.rdd.getNumPartitions() == 2 * parts or counted.rdd.getNumPartitions() == parts


def test_buckets_grow_with_the_notes(spark, small, monkeypatch):
    """A bucket is a task in which all families of features sort their notes."""
    monkeypatch.setattr(N, "TASK_NOTES", 25)
    found = notes(spark, small)
    held = N.note_table(found)
    assert len({name.rsplit("_", 1)[1] for name in held.inputFiles()}) > 8 and held.count() == N.song_notes(found).count()
