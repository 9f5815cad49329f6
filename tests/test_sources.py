"""Files in and out, the batch build, MIDI parsing, and the streaming extension."""

import importlib.util
import json
import struct

import pytest

from tonegraph.explorer import Explorer
from tonegraph.plans.build import build
from tonegraph.schemas import GROUPS
from tonegraph.sources import midi, scratch, tables
from tonegraph.sources.keyed import KeyedTable
from tonegraph.sources.stages import Stages, rows_digest
from tonegraph.streaming.running_stats import windowed_note_stats


def midi_file(events, division=480, tempo=None):
    """events: (delta, bytes)."""
    body = b"".join(bytes([d]) + e for d, e in ([(0, b"\xff\x51\x03" + tempo.to_bytes(3, "big"))] if tempo else []) + events)
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


SONG = midi_file([(0, b"\xc0\x05"), (0, b"\x90\x3c\x40"), (96, b"\x3c\x00"), (0, b"\x99\x24\x50"), (96, b"\x89\x24\x00")], division=96, tempo=1_000_000)


def test_parse_midi():
    assert midi.parse_notes(SONG) == [(0, 0, 5, 0.0, 1.0, 60, 64), (0, 9, 0, 1.0, 2.0, 36, 80)]
    for bad in (b"", b"RIFF", SONG[:20] + b"\x80"):
        try:
            midi.parse_notes(bad)
        except (ValueError, IndexError, struct.error):
            pass


def test_read_midi(spark, tmp_path):
    for track, name, data in [("T1", "a.mid", SONG), ("T1", "b.mid", b"broken"), ("T2", "c.mid", SONG), ("T2", "d.txt", b"")]:
        (tmp_path / track).mkdir(exist_ok=True)
        (tmp_path / track / name).write_bytes(data)
    rows = midi.read_midi(spark, str(tmp_path)).collect()
    assert {(r.track_id, r.pitch, r.is_drum) for r in rows} == {("T1", 60, False), ("T1", 36, True), ("T1", None, False), ("T2", 60, False), ("T2", 36, True)}


def test_csv(spark, tmp_path):
    rows = [("t", 'a "quoted", name', "i", "None", "s", None, "g", "p\nq")]
    df = spark.createDataFrame(rows, tables.METADATA)
    tables.write_csv(df, str(tmp_path / "m"))
    assert tables.read_metadata_csv(spark, str(tmp_path / "m")).collect() == df.collect()


def test_append_distinct(spark, tmp_path):
    a = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    tables.write_parquet(a, str(tmp_path / "a"))
    assert tables.append_distinct(spark.createDataFrame([(1, 3), (4, 4)], "x int, y int"), str(tmp_path / "a"), ["x", "y"], str(tmp_path / "b")).count() == 3


def test_keyed_append_touches_only_its_buckets(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "keyed"), ["x", "y"])
    with pytest.raises(FileNotFoundError):
        table.read()
    schema = "x int, y string, v int"
    assert len(table.append(spark.createDataFrame([(k, None if k % 5 == 0 else "a", k) for k in range(200)] * 2, schema))) > 1
    before = table.manifest()
    assert table.append(spark.createDataFrame([(5, None, -1), (6, "a", -1)], schema)) == [] and table.manifest() == before
    written = table.append(spark.createDataFrame([(-1, 5, None), (7, 1000, "b")], "v int, x int, y string"))
    after = table.manifest()
    assert {b for b in after["where"] if after["where"][b] != before["where"].get(b)} == {str(b) for b in written} and len(written) == 1
    rows = sorted(map(tuple, table.read().collect()), key=str)
    expected = [(k, None if k % 5 == 0 else "a", k) for k in range(200)] + [(1000, "b", 7)]
    assert rows == sorted(expected, key=str)
    assert len(table.append(spark.createDataFrame([(1001, "c", 1)], schema))) == 1
    opened = table.read()
    monkeypatch.setattr(table, "_commit", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(spark.createDataFrame([(2000 + k, "z", k) for k in range(50)], schema))
    monkeypatch.undo()
    assert table.read().count() == opened.count() == 202
    assert table.vacuum() >= 1 and table.read().count() == 202 and table.vacuum() == 0
    late = after | {"version": table.manifest()["version"]}
    with pytest.raises(RuntimeError, match="another"):
        table._commit(late)


def test_keyed_table_may_be_empty(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "keyed"), ["x"])
    none = spark.createDataFrame([], "x int, v string")
    assert table.append(none) == [] and table.read().count() == 0 and table.append(none) == []
    assert table.append(spark.createDataFrame([(None, "n"), (None, "m")], "x int, v string")) and table.read().count() == 1


def test_rows_digest(spark):
    a = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None)], "x int, y string, z map<string,int>")
    same = spark.createDataFrame([(2, None, None), (1, "a", {"k": 1})], a.schema).repartition(3)
    assert rows_digest(a) == rows_digest(same) == rows_digest(a)
    others = [a.union(a), a.where("x = 1"), a.withColumn("x", a.x.cast("long")), a.withColumnRenamed("y", "w"), a.limit(0)]
    assert len({rows_digest(d) for d in [a, *others]}) == 6


def test_stages_are_built_again_where_what_they_were_made_from_differs(spark, small, tmp_path):
    notes, tracks = tables.notes(spark, small), tables.tracks(spark, small)
    folder = str(tmp_path / "built")

    def built(notes=notes, tracks=tracks, **options):
        stages = Stages(spark, folder, options.pop("force", False))
        build(spark, notes, tracks, folder, stages=stages, **options)
        return stages.built

    every = ["features", "metadata", "groups", "embeddings", "weights", "knn_edges"]
    assert built(k=3) == every
    assert built(k=3) == []
    assert built(k=2) == ["knn_edges"]
    assert built(k=2, weights={"stats": 4.0}) == ["embeddings", "weights", "knn_edges"]
    fresh = build(spark, notes, tracks, str(tmp_path / "fresh"), weights={"stats": 4.0}, k=2)
    read = lambda name: sorted(map(tuple, spark.read.parquet(f"{folder}/{name}").collect()))
    assert read("knn_edges") == sorted(map(tuple, fresh["knn_edges"].collect()))
    assert Explorer.load(spark, folder).status()["weights"]["stats"] == 4.0
    (tmp_path / "built" / "groups" / "_made_from").unlink()  # as after a build that broke off
    assert built(k=2, weights={"stats": 4.0}) == ["groups"]
    assert built(notes=notes.where("note_seq % 50 <> 0"), k=2, weights={"stats": 4.0}) == [s for s in every if s != "weights"]
    assert built(version="snapshot 9", k=2)[0] == "features" and built(version="snapshot 9", k=2) == []


def test_settled_removes_what_led_to_a_table(spark):
    made = []

    def make():
        first = scratch.materialize(spark.range(10), "first")
        second = scratch.settled(spark, "second", lambda: scratch.materialize(first.where("id > 2"), "within").where("id > 3"))
        made.extend([first, second])
        return second.where("id > 4")

    before = scratch.materialize(spark.range(3), "before")
    last = scratch.settled(spark, "last", make)
    assert sorted(r.id for r in last.collect()) == [5, 6, 7, 8, 9] and before.count() == 3
    for gone in made:
        with pytest.raises(Exception, match="(?i)exist|not found"):
            gone.collect()


def test_build_and_load(spark, small, tmp_path):
    folder = str(tmp_path / "built")
    made = build(spark, tables.notes(spark, small), tables.tracks(spark, small), folder, k=3)
    assert made["embeddings"].count() == made["metadata"].count() > 3
    assert made["knn_edges"].groupBy("src").count().where("count <> 3").isEmpty()
    again = build(spark, tables.notes(spark, small), tables.tracks(spark, small), folder, k=3)
    assert again["knn_edges"].count() == made["knn_edges"].count()
    e = Explorer.load(spark, folder)
    assert e.neighbours(0, 2).count() == 2 and e.kept == 3
    assert set(e.status()["weights"].values()) == {1.0}
    best = spark.createDataFrame([tuple(float(k) for k in range(1, 10))], ", ".join(f"weight_{g} double" for g in GROUPS))
    other = str(tmp_path / "other")
    build(spark, tables.notes(spark, small), tables.tracks(spark, small), other, best_weighting=best, k=2)
    assert Explorer.load(spark, other).status()["weights"] == {g: float(k) for k, g in enumerate(GROUPS, 1)}
    assert e.build_custom({"melody": 0.0})["weights"]["melody"] == 0.0


def test_stream_equals_batch(spark, small, tmp_path):
    events = tables.read_table(spark, small, "events")
    notes = tables.notes(spark, small).join(events.selectExpr("event_id AS note_seq", "cast(ts as timestamp) ts"), "note_seq")
    columns = ["track_id", "pitch", "is_drum", "ts"]
    notes.select(columns).repartition(4).write.parquet(str(tmp_path / "in"))
    batch = windowed_note_stats(spark.read.parquet(str(tmp_path / "in")))
    source = spark.readStream.schema("track_id long, pitch int, is_drum boolean, ts timestamp").parquet(str(tmp_path / "in"))
    stream = windowed_note_stats(source, late="10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("name", ["notes", "tracks", "vectors"])
def test_bindings(spark, small, name):
    assert getattr(tables, name)(spark, small).count() > 0


def test_h5_metadata_rows(spark, tmp_path):
    """The row building of the HDF5 reader, with a module that reads JSON in place of h5py."""
    if importlib.util.find_spec("h5py"):
        pytest.skip("h5py is installed")
    stub = tmp_path / "h5py.py"
    stub.write_text(
        "import json\n"
        "class File(dict):\n"
        "    def __init__(self, file, mode):\n"
        "        entry = {k: v.encode() if k == 'title' else v for k, v in json.load(file).items()}\n"
        "        super().__init__({'metadata/songs': [entry]})\n"
        "    def __enter__(self):\n"
        "        return self\n"
        "    def __exit__(self, *error):\n"
        "        return False\n"
    )
    spark.sparkContext.addPyFile(str(stub))
    folder = tmp_path / "h5"
    entry = {"artist_name": "Ann", "artist_id": "a1", "title": "Größe", "song_id": "s1", "release": "R", "genre": ""}
    for place in ("A/B/TR1", "A/C/TR2"):
        path = folder / f"{place}.h5"
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps(entry))
    (folder / "A/B/notes.txt").write_text("not read")
    rows = {r["track_id"]: r for r in tables.read_h5_metadata(spark, str(folder), "/midi").collect()}
    assert sorted(rows) == ["TR1", "TR2"]
    assert rows["TR1"].asDict() == {**entry, "track_id": "TR1", "midi_path": "/midi/A/B/TR1"}
    assert rows["TR2"]["midi_path"] == "/midi/A/C/TR2"
