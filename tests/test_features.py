"""Hand-made songs: values worked out with numpy, and the edges of each definition."""

import math

import numpy as np
import pytest

from tonegraph.operators import features as X
from tonegraph.operators import notes as N
from tonegraph.operators import vectors as V

SCHEMA = "track_id string, note_seq long, file_no int, instrument string, is_drum boolean, onset double, release double, pitch int, velocity int"


def make(spark, rows):
    """rows: (track, onset, release, pitch, drum)."""
    return spark.createDataFrame(
        [(t, k, k % 2, "piano" if not d else "drums", d, float(a), float(b), p, 64 + k % 5) for k, (t, a, b, p, d) in enumerate(rows)], SCHEMA
    )


def line(track, pitches, step=0.5, length=0.5, drum=False):
    return [(track, k * step, k * step + length, p, drum) for k, p in enumerate(pitches)]


def test_basic_stats(spark):
    pitches, durations, velocities = [60, 62, 64, 65, 67], [0.5, 0.25, 0.75, 0.5, 1.0], [80, 90, 70, 85, 95]
    rows = [("t", k, k % 2, "a", False, k * 0.5, k * 0.5 + d, p, v) for k, (p, d, v) in enumerate(zip(pitches, durations, velocities))]
    r = X.basic_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.note_count, r.mean_pitch, r.pitch_range, r.mean_duration, r.mean_velocity) == (5, 63.6, 7, 0.6, 84.0)
    assert math.isclose(r.std_pitch, np.std(pitches)) and math.isclose(r.std_velocity, np.std(velocities))
    assert (r.num_files, r.mean_instruments) == (2, 1.0)


def test_tracks_under_five_notes_are_dropped(spark):
    notes = make(spark, line("four", [60] * 4) + line("five", [60] * 5) + line("drums", [40] * 9, drum=True))
    assert {r.track_id for r in N.song_notes(notes).select("track_id").distinct().collect()} == {"five"}


def test_registers_and_chroma(spark):
    notes = make(spark, line("t", [60, 62, 64, 65, 67, 69, 71, 72, 74]))
    r = X.chroma(notes).first()
    assert r.low_chroma == [0.0] * 12
    assert np.allclose(r.mid_chroma, np.bincount([0, 2, 4, 5, 7, 9, 11], minlength=12) / (7 + 1e-9))
    both = np.array(r.mid_chroma) + np.array(r.high_chroma)
    assert np.allclose(r.total_chroma, both / (both.sum() + 1e-9))


@pytest.mark.parametrize(("tonic", "label"), [(0, "C"), (2, "A#"), (7, "F"), (9, "D#")])
def test_key_label_mirrors_the_tonic(spark, tonic, label):
    profile = np.roll(X.MAJOR_PROFILE, tonic)
    pitches = [60 + c for c in range(12) for _ in range(int(profile[c] * 20))]
    notes = make(spark, [("t", k, k + 1, p, False) for k, p in enumerate(pitches)])
    r = X.key(X.chroma(notes)).first()
    assert r.key == f"{label} major" and r.tonic == X.PITCH_CLASSES[tonic] and r.key_strength > 0.99


def test_constant_chroma_has_no_key(spark):
    notes = make(spark, line("t", range(48, 60)))
    r = X.key(X.chroma(notes)).first()
    assert r.key is None and r.key_strength is None and r.key_cos is None and r.tonic is None


def numpy_entropy(values):
    h = np.histogram(values, bins=20)[0]
    p = h[h > 0] / h.sum()
    return float(-(p * np.log(p)).sum())


def test_entropy(spark):
    rng = np.random.default_rng(3)
    onsets = np.sort(rng.integers(0, 400, 60)) / 16
    rows = [("t", o, o + d / 16, int(p), False) for o, d, p in zip(onsets, rng.integers(1, 9, 60), rng.integers(20, 100, 60))]
    rows += line("flat", [64] * 6)
    got = {(r.track_id, r.kind): r.entropy for r in X.entropies(make(spark, rows)).collect()}
    assert math.isclose(got["t", "pitch"], numpy_entropy([r[3] for r in rows[:60]]), abs_tol=1e-9)
    assert math.isclose(got["t", "ioi"], numpy_entropy(np.diff(onsets)), abs_tol=1e-9)
    assert got["flat", "pitch"] == got["flat", "duration"] == got["flat", "ioi"] == 0
    assert all(-1e-12 <= v <= math.log(20) for v in got.values())


def test_log_histogram_edges(spark):
    onsets = np.cumsum([0, 0, 0.0005, 0.001, 0.01, 10, 11])
    rows = [("t", float(o), float(o) + 0.5, 60, False) for o in onsets]
    hist = {r.kind: r.hist for r in X.log_histograms(make(spark, rows)).collect()}
    assert sum(h > 0 for h in hist["ioi"]) >= 2 and hist["drum_ioi"] == [0.0] * 10
    assert np.allclose(hist["duration"], np.histogram([0.5] * 7, bins=np.logspace(-3, 1, 11))[0] / (7 + 1e-9))


def test_densities(spark):
    rows = line("t", [60] * 5) + [("t", 0.0, 0.5, 40, True), ("t", 1.0, 1.5, 40, True), ("t", 3.0, 3.5, 40, False)]
    r = X.densities(make(spark, rows)).first()
    assert math.isclose(r.drum_density, 2 / (1.5 + 1e-9)) and r.bass_density == 0 and r.note_density > 0


def test_intervals_and_ngrams(spark):
    notes = make(spark, line("t", [60, 62, 64, 65, 67]) + line("low", [40, 42, 44]))
    steps = N.intervals(N.streams(notes))
    got = [r.step for r in steps.where("track_id = 't' and stream = 'melody'").orderBy("pos").collect()]
    assert got == [2, 2, 1, 2]
    counts = {(r.track_id, r.stream, r.ngram): r.n for r in N.ngram_counts(N.ngrams(steps)).collect()}
    assert counts["t", "melody", "2,2,1"] == counts["t", "melody", "2,1,2"] == 1
    assert not any(t == "low" for t, _, _ in counts)


def test_melody_takes_the_highest_and_then_the_first(spark):
    notes = make(spark, [("t", 0, 1, 60, False), ("t", 0, 2, 72, False), ("t", 0, 3, 72, False), ("t", 1, 2, 50, False)])
    assert [(r.onset, r.pitch, r.note_seq) for r in N.melody(notes).orderBy("onset").collect()] == [(0.0, 72, 1), (1.0, 50, 3)]


def numpy_structure(onsets, pitches):
    edges = np.linspace(min(onsets), max(onsets), 17)
    rows = []
    for a, b in zip(edges, edges[1:]):
        inside = [p % 12 for o, p in zip(onsets, pitches) if a <= o < b]
        c = np.bincount(inside, minlength=12) if inside else np.zeros(12)
        rows.append(c / (c.sum() + 1e-9))
    rows = np.array(rows)
    roots = rows.argmax(axis=1)
    return rows, roots, (roots[1:] != roots[:-1]).mean(), np.linalg.norm(rows[1:] - rows[:-1], axis=1).mean()


def test_structure(spark):
    pitches = [60, 62, 64, 65, 67, 69, 71, 72, 74, 76, 77, 79, 81, 83, 84, 86]
    notes = make(spark, line("t", pitches) + line("nine", pitches[:9]) + [("still", 1.0, 2.0, 60 + k, False) for k in range(10)])
    got = {r.track_id: r for r in X.structure(notes).collect()}
    rows, roots, rhythm, variation = numpy_structure([k * 0.5 for k in range(16)], pitches)
    assert np.array(got["t"].segment_chroma).shape == (16, 12) and np.allclose(got["t"].segment_chroma, rows)
    assert got["t"].chord_progression == roots.tolist()
    assert math.isclose(got["t"].harmonic_rhythm, rhythm) and math.isclose(got["t"].segment_variation, variation)
    assert "nine" not in got and got["still"].chord_progression == [0] * 16 and got["still"].segment_variation == 0


def test_all_features_have_one_row_a_track(spark):
    notes = make(spark, line("a", [60 + k % 9 for k in range(20)]) + line("b", [40, 50, 70, 71, 72]) + line("a", [36] * 4, drum=True))
    r = {x.track_id: x for x in X.song_features(N.song_notes(notes)).collect()}
    assert set(r) == {"a", "b"} and r["b"].segment_chroma is None and r["a"].melody_ngrams and len(r["a"].drum_ioi_hist) == 10


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in "abcd":
        rows += line(t, [int(p) for p in rng.integers(30, 90, 40)])
    song = N.song_notes(make(spark, rows + line("short", [50] * 6)))
    counts = N.ngram_counts(N.ngrams(N.intervals(N.streams(song)), coarse=12))
    grouped = V.feature_groups(X.vector_features(song), counts, V.vocabulary(counts))
    z = V.standardise(grouped)
    got = {r.track_id: r for r in z.collect()}
    assert set(got) == set("abcd")  # without structure features there is no vector
    raw = {r.track_id: r for r in grouped.collect()}
    for g, width in (("stats", 9), ("chroma", 51), ("entropy", 3), ("rhythm", 54), ("structure", 210)):
        x = np.array([raw[t][g] for t in "abcd"], float)
        assert x.shape[1] == width
        if g != "chroma":
            s = x.std(axis=0)
            x = (x - x.mean(axis=0)) / np.where(s > 1e-12, s, 1)
        assert np.allclose([got[t][g] for t in "abcd"], x, atol=1e-6)
    weights = V.resolve_weights({"stats": 2, "unknown": 5})
    unit = {r.track_id: np.array(r.embedding) for r in V.embed(z, weights).collect()}
    assert all(math.isclose(np.linalg.norm(v), 1) for v in unit.values())
    with pytest.raises(ValueError):
        V.resolve_weights(dict.fromkeys(("stats", "chroma", "entropy", "rhythm", "structure", "melody", "low", "mid", "high"), 0))
