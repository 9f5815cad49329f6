"""Explicit schemas of the tables that stages exchange."""

METADATA = "track_id string, artist_name string, artist_id string, title string, song_id string, release string, genre string, midi_path string"
METADATA_INDEXED = METADATA + ", faiss_id long"
NOTES = (
    "track_id string, note_seq long, file_no int, instrument string, program int, is_drum boolean, "
    "onset double, release double, pitch int, velocity int"
)
TRIPLETS = (
    "root_track string, closer_track string, further_track string, root_track_id string, closer_track_id string, further_track_id string"
)

#: The nine feature groups in their fixed order.
GROUPS = ("stats", "chroma", "entropy", "rhythm", "structure", "melody", "low", "mid", "high")

# Weights of groups that a weighting leaves out.
DEFAULT_WEIGHTS = {
    "stats": 1.0,
    "chroma": 1.0,
    "entropy": 0.5,
    "rhythm": 1.0,
    "structure": 0.5,
    "melody": 0.5,
    "low": 0.5,
    "mid": 0.5,
    "high": 0.5,
}

#: Longest n-gram vocabulary by stream.
VOCABULARY = {"melody": 500, "low": 300, "mid": 300, "high": 300}
