"""Benchmark passages in documents, found by winnowing; DataFrame operations only.

A window is `window` consecutive words of an item, or the whole of a shorter item.  For windows of m words, k-grams of
k = ceil(m / 2) words are hashed and each window keeps the least of its m - k + 1 hashes, its fingerprint.  Wherever a
document holds a window of an item, the document's window there keeps the same least hash, so every shared span of m words
and more shares a fingerprint: none is missed.  Windows that overlap mostly keep the same hash, so that a document sends
about one fingerprint for every three words, and only those that a bitmap of the benchmark's fingerprints (at most 16 MiB, whatever the
benchmark) can't clear leave their task.  Those are joined with the benchmark's fingerprints; the windows of a hit are then compared
word by word, and windows that hold extend one another to spans.

Documents are cut into segments of SEGMENT words, each with the first words of the next one, so a text of any length is
many small rows.  A passage that a third of all documents share is a hot key of joins whose other side has one row a key;
adaptive execution splits those.  What one document's rows bring together is its own spans and items.

Defined edge cases: words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII; a null text has no
words; an item without words has no window and is never found; item rows with the same item_id are one item, and null ids are one item,
written as the empty string; repeated document rows are judged one by one; an empty table of documents gives an empty result, an
empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, with_row_ids
from .membership import marked, without

#: Words of a window.
WINDOW = 10
#: Words of a segment.
SEGMENT = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upto(n: Column) -> Column:
    """1 to n, empty if n is less than 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))


def normal_words(text: Column) -> Column:
    """The words of a text, joined by blanks."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BETWEEN, " "))


def segments(rows: DataFrame, carry: list[str], window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """row_id, carry, n_words, seg, body: each text in segments of that many words, each followed by the next one's first
    window - 1 words; a text without words has one row without seg and body.  A written table."""
    named = rows.select(F.monotonically_increasing_id().alias("row_id"), *carry, normal_words(text_or_empty()).alias("norm"))
    parts = F.regexp_extract_all(F.concat("norm", F.lit(" ")), F.lit(rf"(?:[^ ]++ ){{1,{segment}}}+"), F.lit(0))

    def followed(found: Column) -> Column:
        return F.transform(found, lambda part, k: F.rtrim(F.concat(part, F.coalesce(F.substring_index(F.get(found, k + 1), " ", window - 1), F.lit("")))))

    n_words = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1)
    cut = named.select("row_id", *carry, n_words.cast("long").alias("n_words"), F.posexplode_outer(_bound(parts, followed)).alias("seg", "body"))
    return materialize(cut, "segments")


def _grams(m: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window, for windows of m words."""
    k = (m + 1) // 2
    return k, m - k + 1


def kept_hashes(words: Column, m: int) -> Column:
    """The least k-gram hash of each window of m words, in order."""
    k, w = _grams(m)
    empty = F.expr("cast(array() as array<bigint>)")

    def grams(h: Column) -> Column:
        return F.transform(_upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))

    def least(g: Column) -> Column:
        return F.transform(_upto(F.size(g) - (w - 1)), lambda i: F.array_min(F.slice(g, i, w)))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) >= m, _bound(hashes, lambda h: _bound(grams(h), least))).otherwise(empty)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """m, words (joined by blanks), item: the distinct windows of each item.  A written table."""
    parts = segments(benchmark, ["item_id"], window).where("seg is not null")
    m = F.least(F.lit(window), F.col("n_words")).cast("int")
    split = parts.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), m.alias("m"), F.split("body", " ").alias("all"))
    starts = F.transform(_upto(F.size("all") - F.col("m") + 1), lambda i: F.array_join(F.slice("all", i, F.col("m")), " "))
    return materialize(split.select("m", F.explode(starts).alias("words"), "item").distinct(), "windows")


def _marks(m: int, hashes: Column) -> Column:
    """The fingerprints of a segment, each once."""
    return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(m).alias("m"), h.alias("mark")))


def _places(m: int) -> Column:
    """start, m, words of the windows of a segment (seg, all: its words) that keep one of the hashes in marks."""
    empty = F.expr("cast(array() as array<int>)")
    wanted = F.transform(F.filter("marks", lambda x: x["m"] == m), lambda x: x["mark"])

    def standing(mine: Column) -> Column:
        hit = lambda h: F.filter(_upto(F.least(F.size(h), F.lit(SEGMENT))), lambda i: F.array_contains(mine, F.element_at(h, i)))
        return F.when(F.size(mine) > 0, _bound(kept_hashes(F.col("all"), m), hit)).otherwise(empty)

    def window(i: Column) -> Column:
        return F.struct((F.col("seg") * SEGMENT + i - 1).alias("start"), F.lit(m).alias("m"), F.array_join(F.slice("all", i, m), " ").alias("words"))

    return F.transform(_bound(wanted, standing), window)


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """row_id, start, m, words: every place of docs (a table of segments) where one of the windows stands.  A written table."""
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most as many as a window has words
    words = F.split("body", " ")
    texts = materialize(windows.select("m", "words").distinct(), "texts")
    if not lengths:
        return texts.limit(0).select(F.lit(0).cast("long").alias("row_id"), F.lit(0).alias("start"), "m", "words")
    kept = lambda column: [(m, kept_hashes(column, m)) for m in lengths]
    # The k-gram hashes of a window are at hand once its fingerprint is asked for: a window of m words has one.
    marks = reduce(DataFrame.union, [texts.where(F.col("m") == m).select("m", F.element_at(hashes, 1).alias("mark")) for m, hashes in kept(F.split("words", " "))])
    marks = materialize(marks.distinct(), "marks")
    sent = docs.where("seg is not null").select("row_id", "seg", F.inline(F.concat(*[_marks(m, hashes) for m, hashes in kept(words)])))
    doubtful = marked(sent, marks, "mark", "maybe").where("maybe").drop("maybe")
    shared = materialize(doubtful.join(marks, ["m", "mark"], "left_semi"), "shared")

    held = materialize(shared.groupBy("row_id", "seg").agg(F.collect_set(F.struct("m", "mark")).alias("marks")).withColumn("at", _place()), "held")
    near = marked(docs.where("seg is not null").select("row_id", "seg", "body", _place().alias("at")), held, "at", "maybe").where("maybe")
    opened = near.join(held.select("row_id", "seg", "marks"), ["row_id", "seg"]).select("row_id", "seg", "marks", words.alias("all"))
    places = opened.select("row_id", F.inline(F.concat(*[_places(m) for m in lengths])))
    return materialize(places.join(texts, ["m", "words"], "left_semi").select("row_id", "start", "m", "words"), "hits")


def _place() -> Column:
    return F.xxhash64("row_id", "seg")


def _runs(positions: Column) -> Column:
    """Spans (start, end exclusive) of sorted distinct positions."""
    firsts = F.filter(positions, lambda x, i: (i == 0) | (F.get(positions, i - 1) < x - 1))
    lasts = F.filter(positions, lambda x, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) > x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def hit_spans(hits: DataFrame) -> DataFrame:
    """row_id, spans: the words that hits cover, as disjoint spans in order."""
    end = F.col("start") + F.col("m")
    border = (F.floor(F.col("start") / SEGMENT) + 1) * SEGMENT
    parts = F.array(F.struct(F.col("start").alias("a"), F.least(end, border).cast("int").alias("b")), F.struct(border.cast("int").alias("a"), end.cast("int").alias("b")))
    pieces = hits.select("row_id", F.inline(F.filter(parts, lambda x: x["a"] < x["b"]))).distinct()
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("a", F.col("b") - 1)))))
    by_segment = pieces.groupBy("row_id", F.floor(F.col("a") / SEGMENT).alias("seg")).agg(covered.alias("covered"))
    spans = by_segment.select("row_id", "seg", _bound(F.col("covered"), _runs).alias("spans"))
    whole = spans.groupBy("row_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "spans"))), lambda x: x["spans"])).alias("spans"))

    def joined(found: Column) -> Column:
        """Spans that touch at a segment's border become one."""
        firsts = F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["end"] < x["start"]))
        lasts = F.filter(found, lambda x, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["start"] > x["end"]))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return whole.select("row_id", _bound(F.col("spans"), joined).alias("spans"))


def found_items(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """row_id, items: the items with windows in each row, sorted.

    Windows of the same items are one set, so a row meets each set of items once and not once a window."""
    sets = windows.groupBy("m", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = materialize(sets.select("m", "words", F.sha2(F.to_json(F.struct("items")), 256).alias("set"), "items"), "sets")
    met = hits.select("row_id", "m", "words").distinct().join(named.select("m", "words", "set"), ["m", "words"]).select("row_id", "set").distinct()
    listed = materialize(named.groupBy("set").agg(F.first("items").alias("items")), "listed")
    pairs = met.join(listed, "set").select("row_id", F.explode("items").alias("item"))
    return pairs.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word positions, end exclusive) and the items found there."""
    cut = segments(docs, ["doc_id"], window)
    windows = item_windows(benchmark, window)
    hits = window_hits(cut, windows)
    found = materialize(hit_spans(hits).join(found_items(hits, windows), "row_id"), "found")
    rows = cut.where("seg is null or seg = 0").select("row_id", "doc_id", "n_words")
    empty = lambda name, kind: F.coalesce(name, F.expr(f"cast(array() as {kind})")).alias(name)
    return rows.join(found, "row_id", "left").select("doc_id", "n_words", empty("spans", "array<struct<start:int,end:int>>"), empty("items", "array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contaminated_spans(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item stands, with their columns."""
    rows, row = with_row_ids(docs)
    judged = contaminated_spans(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window)
    return without(rows, materialize(judged.where(F.size("spans") > 0).select(F.col("doc_id").alias(row)), "gone"), row).drop(row)


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0))),
o AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
h AS (SELECT r, s, m, item FROM o JOIN i USING (m, g)),
c AS (SELECT r, count(DISTINCT s + k) AS n_hit FROM h, range(0, {WINDOW}) t(k) WHERE k < m GROUP BY r),
n AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""
