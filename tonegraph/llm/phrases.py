"""Phrases of words that stand together more often than apart, mined level by level.

Pass k counts k-grams.  A task emits a k-gram only where both of its overlapping (k - 1)-grams are frequent, which they must be if
it is (a phrase is no more frequent than its parts), so rare text dies at low levels.  What is broadcast of a level is a bitmap over its
frequent grams, of at most 16 MiB whatever the corpus: a gram that it lets through by chance is counted exactly and falls at the
threshold, so no level loses or gains one.  Inside a task grams are told apart by the numbers of their parts, never by hashes.

Candidates are cut after each word; both sides of a cut are looked up in the level tables, and scores are exact (38 digits).  A
candidate goes if a longer one that holds it is (nearly) as frequent; then every gram between the two is as well, so only grams one word
longer are looked at.

From the third pass on a pass also writes the runs of text in which two k-grams in a row may be frequent, and the next reads those alone.

Texts go through a task in chunks that end between words, with the words that follow, so a very long text takes memory for its bytes
and one chunk's words.  Counts are added map-side, so a phrase in every document is one row a task; the first of each language are
taken from the first of SALTS parts, so a language with all candidates is no one task's.

Defined edge cases: a null text is empty, a null lang is "und"; languages that hold nothing frequent have no rows; repeated rows count
each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .membership import bitmap, bits_for

#: Words of the longest phrase, occurrences of a frequent one, and rows returned for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one has this percentage of its occurrences.
ABSORB = 100
#: Bytes of a chunk of text, words that are counted at once, and parts in which a language's first are found.
CHUNK, BUFFER, SALTS = 1 << 20, 1_200_000, 64
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BREAKS = b",;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _BREAKS, _LOWER + b"." * len(_BREAKS))
_TOKEN, _GAP = re.compile(rb"\.|[^ \t.]+"), re.compile(rb"[ \t.]")


class _Numbers(dict):
    """Numbers keys in order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _chunks(text: str, ahead: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Words of a text and breaks ("."), in chunks, each with the `ahead` that follow it."""
    data, at = text.encode().translate(_TABLE), 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        tokens = data[at:end].replace(b".", b" . ").split()
        yield tokens, [m.group() for m in islice(_TOKEN.finditer(data, end), ahead)]
        at = end


def _held(texts: list[bytes], lang: bytes, bits: np.ndarray) -> np.ndarray:
    """Whether a level's bitmap holds each text."""
    from xxhash import xxh64_intdigest

    slots = np.fromiter((xxh64_intdigest(lang + b"\0" + t, 42) for t in texts), np.uint64, len(texts)) % np.uint64(8 * len(bits))
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_grams(at: np.ndarray, own: np.ndarray, words: list[bytes], k: int, lang: bytes, levels: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, bytes]:
    """The k-grams of a text whose parts are in the bitmaps of the levels below k, how often each starts at one of its own places,
    and (k > 2) the text's runs that may hold longer frequent grams.  at: the text as numbers of words; 0 is a break."""
    if k == 1:
        return words[1:], np.bincount(at[own], minlength=len(words))[1:], b""
    text, texts, last = at, words, np.arange(len(words))  # of each gram: its text and the number of its last word; gram 0 is none
    for level in range(1, k):
        good = _held(texts, lang, levels[level - 1])
        good[0] = False
        fine = good[at]
        where = np.flatnonzero(fine[:-1] & fine[1:])
        runs = b""
        if level == k - 1:
            runs = _runs(text, where, words, k) if k > 2 else b""
            where = where[own[where]]
        pairs = at[where] * len(texts) + at[where + 1]
        found, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        left, ends = found // len(texts), last[found % len(texts)]
        grams = [texts[a] + b" " + words[b] for a, b in zip(left.tolist(), ends.tolist(), strict=True)]
        if level == k - 1:
            return grams, counts, runs
        at = np.zeros(len(at) - 1, np.int64)
        at[where] = inverse + 1
        texts, last = [b"", *grams], np.concatenate(([0], ends))
    raise AssertionError


def _runs(text: np.ndarray, where: np.ndarray, words: list[bytes], k: int) -> bytes:
    """The words of all k-grams that start at two places of `where` in a row, with a break between those that don't touch."""
    twice = where[:-1][np.diff(where) == 1]
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + k + 1, -1)
    covered = np.flatnonzero(np.cumsum(edges[:-1]))
    apart = np.flatnonzero(np.diff(covered) > 1) + 1
    return b" ".join([words[x] for x in np.insert(text[covered], apart, 0).tolist()])


def _pass(docs: DataFrame, k: int, levels: list[np.ndarray]) -> DataFrame:
    """lang, gram, n: partial counts of k-grams; in the first pass, gram null counts all words; from the third on, gram with n null is
    what the next pass has to read."""
    shared, ahead = docs.sparkSession.sparkContext.broadcast(levels), k if k > 2 else k - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, tuple[_Numbers, list[np.ndarray], list[np.ndarray]]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, parts, own) in waiting.items():
                grams, n, runs = count_grams(np.concatenate(parts), np.concatenate(own), list(numbers), k, lang.encode(), shared.value)
                n = n.tolist()
                if k == 1:
                    grams, n = [None, *grams], [sum(n), *n]
                if runs:
                    grams, n = [*grams, runs], [*n, None]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for tokens, following in _chunks(text.as_py(), ahead):
                    numbers, parts, own = waiting.setdefault(lang.as_py(), (_Numbers({b".": 0}), [], []))
                    parts.append(np.fromiter(map(numbers.__getitem__, [b".", *tokens, *following]), np.int64, len(tokens) + len(following) + 1))
                    own.append(np.arange(len(parts[-1])) <= len(tokens))
                    size += len(tokens)
                    if size >= BUFFER:
                        yield from counted()
                        size = 0
        yield from counted()

    return docs.mapInArrow(run, "lang string, gram string, n long")


def _bits(level: DataFrame) -> np.ndarray:
    """Bitmap of a level table's grams; at most 16 MiB."""
    named = level.where("gram is not null").select(F.concat("lang", F.lit("\0"), "gram").alias("key"))
    bits = bits_for(named.count())
    out = np.zeros(bits // 8, np.uint8)
    for row in bitmap(named, "key", bits).collect():  # at most as many bytes as the bitmap has
        part = np.frombuffer(row["__bits"], np.uint8)
        out[row["__bucket"] * 4096 : row["__bucket"] * 4096 + len(part)] = part
    return out


def level_tables(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """For each k up to longest: lang, gram, n of the frequent k-grams; the first table has all words of each language under a null
    gram.  Written tables."""
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tables, levels = [], []
    for k in range(1, longest + 1):
        part = _pass(read, k, levels)
        if 2 < k < longest:
            part = materialize(part, f"pass-{k}")
            read = part.where("n is null").select("lang", F.col("gram").alias("text"))
        counts = part.where("n is not null").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        tables.append(materialize(counts.where((F.col("n") >= least) | F.col("gram").isNull()), f"level-{k}"))
        if k < longest:
            levels.append(_bits(tables[-1]))
    return tables


def _exact(*factors: Column | int) -> Column:
    return reduce(lambda a, b: a * b, [(F.lit(f) if isinstance(f, int) else f).cast("decimal(19,0)") for f in factors])


def score_cuts(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate at its lowest-scoring cut.  A written table."""
    words = [t.where("gram is not null") for t in tables]
    totals = tables[0].where("gram is null").select("lang", F.col("n").alias("total"))
    candidates = reduce(DataFrame.union, words[1:]).withColumn("parts", F.split("gram", " "))
    join = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    cuts = candidates.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.size("parts") - F.col("cut")).alias("right"))
    known = reduce(DataFrame.union, words[:-1])
    side = lambda name, n: known.select("lang", F.col("gram").alias(name), F.col("n").alias(n))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.call_function("div", _exact(1000, F.col("a"), F.col("total")), _exact(F.col("l"), F.col("r")))
    scored = both.select("lang", "phrase", "a", F.col("total").alias("n"), F.struct(score.alias("score"), "cut", "l", "r").alias("at"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("at").alias("at"))
    return materialize(best.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score"), "scored")


def absorbed(tables: list[DataFrame], percent: int = ABSORB) -> DataFrame:
    """lang, phrase: candidates that stand in one a word longer which has that percentage of their occurrences.  A written table."""
    longer = reduce(DataFrame.union, tables[2:]).withColumn("parts", F.split("gram", " "))
    inner = F.array(F.array_join(F.slice("parts", 1, F.size("parts") - 1), " "), F.array_join(F.slice("parts", 2, F.size("parts") - 1), " "))
    most = longer.select("lang", F.explode(inner).alias("gram"), F.col("n").alias("most")).groupBy("lang", "gram").agg(F.max("most").alias("most"))
    shorter = reduce(DataFrame.union, tables[1:-1])
    gone = shorter.join(materialize(most, "most"), ["lang", "gram"]).where(100 * F.col("most") >= percent * F.col("n"))
    return materialize(gone.select("lang", F.col("gram").alias("phrase")), "absorbed")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorb: int = ABSORB) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one absorbs.  longest: 3 words at least."""
    tables = level_tables(docs, longest, least)
    return score_cuts(tables).join(absorbed(tables, absorb), ["lang", "phrase"], "left_anti")


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = collocations(docs).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, g, f, string_split(g, ' ') AS parts FROM g WHERE k > 1),
i AS (SELECT lang, array_to_string(parts[s:s + m - 1], ' ') AS g, max(f) AS most
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM c, range(2, {LONGEST}) r(m) WHERE m < k) GROUP BY ALL),
u AS (SELECT lang, k, g, f, cut, array_to_string(parts[1:cut], ' ') AS lt, array_to_string(parts[cut + 1:], ' ') AS rt
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.g, u.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * u.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
      FROM u JOIN g AS x ON x.lang = u.lang AND x.g = lt JOIN g AS y ON y.lang = u.lang AND y.g = rt JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
k AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE i.most IS NULL OR 100 * i.most < {ABSORB} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM k QUALIFY rank <= {TOP}"""
