"""Near dedup where a node holds far more unlike rows than a task compares at once, and very long texts."""

import tracemalloc

import numpy as np
import pytest

from tonegraph.llm import simhash


def test_wide_nodes_of_unlike_rows_lose_no_pair(spark, tmp_path):
    """120 unlike pairs under one fingerprint, a node of 8 rows: passes by chance never narrow it, the last one meets all."""
    rng = np.random.default_rng(5)
    sketches = rng.integers(-(1 << 63), 1 << 63, (120, 4), dtype="i8")
    close = sketches ^ np.int64(1 << 20)
    rows = [(n, [7, 7, 7], list(range(n * 16, n * 16 + 16)), *map(int, s)) for n, s in enumerate(np.concatenate((sketches, close)))]
    schema = "name long, fps array<long>, bands array<int>, s0 long, s1 long, s2 long, s3 long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/named")
    named = spark.read.parquet(f"{tmp_path}/named")
    found = {(r.u, r.v) for r in simhash.candidates(named, 49, node_rows=8).collect()}
    assert found == {(n + 120, n) for n in range(120)}


def test_bits_of_long_texts_are_summed_in_parts():
    """The bits that are unpacked at once don't grow with the text; parts give the same fingerprints."""
    words = [f"word{k % 9973}x{k % 7}".encode() for k in range(60_000)]
    text = b" ".join(words).decode()
    whole, parts = simhash.HASHES_AT_ONCE, 100
    expected = simhash.fingerprint(text), simhash.word_hash_fingerprints(words)
    try:
        simhash.HASHES_AT_ONCE = parts
        assert (simhash.fingerprint(text), simhash.word_hash_fingerprints(words)) == expected
        simhash.HASHES_AT_ONCE = 1 << 30
        assert (simhash.fingerprint(text), simhash.word_hash_fingerprints(words)) == expected
    finally:
        simhash.HASHES_AT_ONCE = whole


@pytest.mark.parametrize("text", ["", " ", "A", " a\t\x0b B\r\n", "É\u00a0x  \x1cy\x85", "a" * 50 + "\n" * 50 + "b", "\x00 \x1f z "])
def test_words_are_joined_as_by_splitting(text):
    assert simhash._joined_words(text) == b" ".join(text.encode().lower().split())


def test_a_text_of_10_mb():
    """Its fingerprint takes some times its bytes, where a list of words and their bits took over 30 times."""
    text = " ".join(f"w{k % 999_983}" for k in range(1_400_000))
    assert len(text) > 10_000_000
    tracemalloc.start()
    try:
        found = simhash.fingerprint(text)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(text)
    finally:
        tracemalloc.stop()
    assert found != 0
