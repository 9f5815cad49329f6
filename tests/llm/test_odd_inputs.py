"""Every operator on nulls, empty and long texts, ties, repeated rows, strange extra columns, and on no rows at all."""

import hashlib

import pytest

import corpus_pipeline
from tonegraph.llm import exact_dedup, html_extract, language_id, mixing, packing, secret_scan, sharding, simhash, token_counts, weighted_fingerprint

OPERATORS = {
    "packing": packing.pack_documents,
    "mixing": mixing.mix,
    "fingerprint": weighted_fingerprint.fingerprint_edits,
    "texts": weighted_fingerprint.fingerprint_texts,
    "language": language_id.identify_languages,
    "dedup": exact_dedup.exact_dedup,
    "counts": token_counts.count_tokens,
    "sharding": sharding.shard_documents,
    "secrets": secret_scan.scan_secrets,
    "simhash": simhash.simhash_components,
}


@pytest.fixture(scope="module")
def found(odd):
    return {name: f(odd).collect() for name, f in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"packing"}))
def test_a_row_for_each_row(found, odd_rows, name):
    assert sorted(str(r.doc_id) for r in found[name]) == sorted(str(r[0]) for r in odd_rows)


def test_packing(found, odd_rows):
    got = found["packing"]
    assert {r.doc_id for r in got} == {r[0] for r in odd_rows}
    null = [r for r in got if r.doc_id == 3]
    assert [(r.start, r.length) for r in null] == [(0, 1)]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_mixing(found):
    for r in found["mixing"]:
        assert 0 <= r.taken <= 2 * r.size
    assert all(r.size == 0 and r.taken == 0 for r in found["mixing"] if r.doc_id in (3, 4, 5))
    by_source = {r.source: r.target for r in found["mixing"]}
    assert sum(by_source.values()) == pytest.approx(1.5 * sum(r.size for r in found["mixing"]))


def test_fingerprints_of_equal_texts_are_equal(found, odd_rows):
    by_id = {}
    for r in found["texts"]:
        by_id.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(by_id[1]) == 1 and by_id[1] == by_id[2] == by_id[9]  # the same words
    assert by_id[3] == by_id[4] == by_id[5] and by_id[6] != by_id[1]
    edits = {r.doc_id: r for r in found["fingerprint"]}
    assert edits[4].n_chars == 0 and edits[4].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found["fingerprint"])


def test_language(found):
    got = {r.doc_id: r for r in found["language"]}
    for k in (3, 4, 5, 7):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[1].lang_pred in ("en", "fr", "de") and 0 < got[1].score <= 1


def test_language_without_labels(odd):
    from pyspark.sql import functions as F

    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_dedup(found, odd_rows):
    got = found["dedup"]
    # Of equal texts the longest original stays: 9 has one blank more; 5 is the longest of the white ones.
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2, 9)} == {(9, 4)}
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (3, 4, 5)} == {(5, 4)}
    assert sum(r.kept for r in got) == len({"".join((r[1] or "").split()) for r in odd_rows})
    assert {r.text_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}


def test_counts(found):
    got = {r.doc_id: r for r in found["counts"]}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[6].n_chars == max(r.n_chars for r in found["counts"])
    assert got[6].reencoded < 300  # of some 700,000


def test_sharding(found):
    assert {r.size for r in found["sharding"] if r.doc_id == 3} == {8}
    slots = {}
    for r in found["sharding"]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))


def test_secrets(found):
    got = {r.doc_id: r for r in found["secrets"]}
    assert (got[8].n_assign, got[8].n_access, got[8].n_hex) == (1, 1, 1)
    assert got[8].spans == "access:0:20,hex:21:37,assign:48:70"
    text = "Ünïcödé ﷽ 漢字 🎉 password = abcdefghijkl"
    start = text.index("password")
    assert f"assign:{start}:{len(text)}" in {r.spans for r in found["secrets"] if r.doc_id is None}
    assert got[3].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_simhash(found):
    got = {r.doc_id: r for r in found["simhash"]}
    assert {r.fingerprint for r in found["simhash"] if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert got[3].component_id == got[4].component_id == 3 and got[9].component_id == got[1].component_id == 1


def test_pages(spark):
    rows = [(1, "http://a.com/x", None), (2, None, ""), (2, None, "<p>one<p>two  &amp;amp;"), (None, "nonsense", "plain\n text"), (3, "http://a.com/y", "<div " * 5000), (3, "http://a.com/y", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS text")
    got = html_extract.extract_pages(pages).collect()
    assert sorted(r.text for r in got) == sorted(["", "", "one\ntwo &amp;", "plain text", "", "deep"])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_pipeline_stages(spark, odd, none, tmp_path):
    for table in (odd, none):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
            path = str(tmp_path / f"{'none' if table is none else 'odd'}{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (table is odd)
    # repeated rows: exactly one of each group is left
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "odd1")).collect()]
    assert len(texts) == len({"".join(t.split()) for t in texts}) and any("quick" in t for t in texts)
    assert {r.digest for r in spark.read.parquet(str(tmp_path / "odd3")).collect()} == {"stranger"}
