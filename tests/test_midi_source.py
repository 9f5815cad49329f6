"""The MIDI data source: pairing of notes, packing of files, filters, and a round trip."""

import pytest
from pyspark.sql import functions as F

from tests.test_sources import SONG, midi_file
from tonegraph.sources import midi


def on(wait, pitch, velocity=64, channel=0):
    return wait, bytes([0x90 | channel, pitch, velocity])


def off(wait, pitch, channel=0):
    return wait, bytes([0x80 | channel, pitch, 0])


def spans(*events, **options):
    return sorted((n[3], n[4], n[5]) for n in midi.parse_notes(midi_file(list(events), division=96, tempo=1_000_000, **options)))


def test_notes_struck_again():
    # On the tick at which the old note ends: before or behind its end.
    assert spans(on(0, 60), on(48, 60), off(0, 60), off(48, 60)) == [(0.0, 0.5, 60), (0.5, 1.0, 60)]
    assert spans(on(0, 60), off(48, 60), on(0, 60), off(48, 60)) == [(0.0, 0.5, 60), (0.5, 1.0, 60)]
    # While the old one sounds: one end closes both.
    assert spans(on(0, 60), on(48, 60), off(48, 60), off(48, 60)) == [(0.0, 1.0, 60), (0.5, 1.0, 60)]
    # No length, no end, an end without a beginning; other pitches and channels don't matter.
    assert spans(on(0, 60), off(0, 60), off(48, 60)) == []
    assert spans(on(0, 60), off(48, 61), off(0, 60, channel=1)) == []


def test_running_status_and_programs():
    rows = midi.parse_notes(midi_file([(0, b"\xc0\x05"), on(0, 60), (48, b"\x3e\x40"), (0, b"\xc0\x07"), (48, b"\x90\x3c\x00"), (0, b"\x3e\x00")], division=96, tempo=1_000_000))
    assert sorted((n[2], n[3], n[4], n[5]) for n in rows) == [(7, 0.0, 1.0, 60), (7, 0.5, 1.0, 62)]  # the program of the end


def test_tempo_changes_on_another_track():
    head = midi_file([(0, b"\xff\x51\x03" + (1_000_000).to_bytes(3, "big")), (96, b"\xff\x51\x03" + (500_000).to_bytes(3, "big"))], division=96)
    notes = midi_file([on(0, 60), off(96, 60), on(0, 62), off(96, 62)], division=96)
    both = head[:10] + b"\x00\x02" + head[12:] + notes[14:]
    assert sorted(n[3:5] for n in midi.parse_notes(both)) == [(0.0, 1.0), (1.0, 1.5)]


def test_packing_by_bytes():
    files = [(f"f{k}", 10) for k in range(7)] + [("g", 500)]
    groups = midi.packed(files, 60, 10)
    assert [len(g) for g in groups] == [3, 3, 1, 1] and [p for g in groups for p in g] == [f for f, _ in files]
    assert midi.packed([], 60, 10) == []


@pytest.fixture
def folder(tmp_path):
    for track in ("A", "B", "C"):
        (tmp_path / "x" / track).mkdir(parents=True)
        (tmp_path / "x" / track / "1.mid").write_bytes(SONG)
    (tmp_path / "x" / "B" / "2.mid").write_bytes(b"no midi at all")
    (tmp_path / "x" / "B" / "3.txt").write_bytes(SONG)
    return str(tmp_path)


def test_read(spark, folder):
    rows = midi.read_midi(spark, folder).collect()
    assert sorted((r.track_id, r.pitch or 0) for r in rows) == [("A", 36), ("A", 60), ("B", 0), ("B", 36), ("B", 60), ("C", 36), ("C", 60)]
    assert len({(r.track_id, r.file_no) for r in rows}) == 4  # a file that can't be read still counts
    assert spark.read.format("midi").option("maxPartitionBytes", 1).load(folder).rdd.getNumPartitions() == 4
    assert midi.read_midi(spark, f"file://{folder}").count() == len(rows)
    assert midi.read_midi(spark, f"{folder}/none").count() == 0


def test_a_filter_on_tracks_leaves_files_unread(spark, folder):
    found = midi.read_midi(spark, folder)
    assert {r.track_id for r in found.where("track_id = 'A'").collect()} == {"A"}
    assert {r.track_id for r in found.where("track_id in ('A', 'C') and pitch > 40").collect()} == {"A", "C"}
    spark.read.format("midi").load(folder)
    reader = midi.MidiReader({"path": folder})
    left = list(reader.pushFilters([midi.EqualTo(("track_id",), "A"), midi.EqualTo(("pitch",), 60)]))
    assert [f.attribute for f in left] == [("pitch",)] and [p.paths[0].rsplit("/", 2)[1] for p in reader.partitions()] == ["A"]


def test_round_trip(spark, tmp_path):
    columns = "track_id long, note_seq long, file_no int, instrument string, program int, is_drum boolean, onset double, release double, pitch int, velocity int"
    rows = [(t, k, k % 2, "i", k % 20, k % 5 == 0, k / 16, k / 16 + 0.03125, 40 + k % 50, 1 + k) for t in range(3) for k in range(100)]
    midi.write_midi(spark.createDataFrame(rows, columns), str(tmp_path))
    got = midi.read_midi(spark, str(tmp_path)).select(F.col("track_id").cast("long"), "is_drum", "onset", "release", "pitch", "velocity").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *r[5:]) for r in rows)
