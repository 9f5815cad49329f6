"""One query for each operator over the driver's tables, with DuckDB SQL for the same rows.

Arrays are exploded to (id, pos, value) rows and doubles are rounded to six places on both sides."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .explorer import Explorer
from .operators import analytics as A
from .operators import cleaning, evaluation, graph, knn
from .operators import features as X
from .operators import notes as N
from .operators import vectors as V
from .operators.metric_index import MetricIndex
from .operators.text_index import TextIndex
from .plans.weight_search import evaluate
from .schemas import DEFAULT_WEIGHTS, GROUPS, VOCABULARY
from .sources.arrays import read_arrays, write_arrays
from .sources.keyed import KeyedTable
from .sources.midi import read_midi, write_midi
from .sources.scratch import materialize, work_path
from .sources.tables import (
    NOTES_SQL,
    SLICES,
    names,
    notes,
    read_metadata_csv,
    read_table,
    tracks,
    vector_groups,
    vector_names,
    vectors,
    write_csv,
    write_parquet,
)
from .streaming.running_stats import windowed_note_stats

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: Steps are floored to this multiple where a vocabulary is wanted: raw 3-grams hardly repeat in the tables.
COARSE = 32
ROOT, K_GRAPH, K = 7, 5, 10
PATH = (3, 411)
CUSTOM = {"stats": 2.0, "chroma": 0.0, "entropy": 3.5, "rhythm": 1.25, "structure": 0.75, "unknown": 9.0}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(column: str):
    return F.round(column, 6).alias(column)


def song(spark: SparkSession, sf: str) -> DataFrame:
    found = notes(spark, sf)
    return N.song_notes(found, parts=N.task_count(found))


def fixed_song(spark: SparkSession, sf: str) -> DataFrame:
    """The notes as a table, for queries that read them many times."""
    return materialize(song(spark, sf), "song")


def exploded(df: DataFrame, ids: list[str], column: str) -> DataFrame:
    return df.select(*ids, F.posexplode(column).alias("pos", "value")).select(*ids, "pos", r6("value"))


# ---------------------------------------------------------------- notes and features

_STATS_SQL = """
f AS (SELECT track_id, count(*) AS num_files, avg(c) AS mean_instruments
      FROM (SELECT track_id, file_no, count(DISTINCT instrument) AS c FROM song GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT track_id, count(*) AS note_count, avg(pitch) AS mean_pitch, stddev_pop(pitch) AS std_pitch,
              (max(pitch) - min(pitch))::BIGINT AS pitch_range, avg("release" - onset) AS mean_duration,
              stddev_pop("release" - onset) AS std_duration, avg(velocity) AS mean_velocity, stddev_pop(velocity) AS std_velocity
       FROM m GROUP BY 1)"""


@query(f"""WITH {NOTES_SQL}, {_STATS_SQL}
SELECT track_id, note_count, round(mean_pitch, 6) AS mean_pitch, round(std_pitch, 6) AS std_pitch, pitch_range,
       round(mean_duration, 6) AS mean_duration, round(std_duration, 6) AS std_duration, round(mean_velocity, 6) AS mean_velocity,
       round(std_velocity, 6) AS std_velocity, num_files, round(mean_instruments, 6) AS mean_instruments
FROM st JOIN f USING (track_id)""")
def basic_stats(spark, sf):
    s = X.basic_stats(song(spark, sf))
    return s.select([r6(c) if kind == "double" else F.col(c) for c, kind in s.dtypes])


@query(f"WITH {NOTES_SQL} SELECT track_id, reg AS register, count(*) AS notes FROM m GROUP BY 1, 2")
def register_counts(spark, sf):
    return X.register_counts(song(spark, sf))


_CHROMA_SQL = """
grid AS (SELECT track_id, reg, pos FROM (SELECT DISTINCT track_id FROM m), (VALUES ('low'), ('mid'), ('high')) v(reg), range(12) p(pos)),
rc AS (SELECT track_id, reg, pos, c / (sum(c) OVER (PARTITION BY track_id, reg) + 1e-9::DOUBLE) AS value
       FROM (SELECT g.track_id, g.reg, g.pos, count(m.pitch)::DOUBLE AS c FROM grid g
             LEFT JOIN m ON m.track_id = g.track_id AND m.reg = g.reg AND m.pitch % 12 = g.pos GROUP BY 1, 2, 3)),
tc AS (SELECT track_id, pos, v / (sum(v) OVER (PARTITION BY track_id) + 1e-9::DOUBLE) AS value
       FROM (SELECT track_id, pos, sum(value ORDER BY CASE reg WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END) AS v FROM rc GROUP BY 1, 2))"""


@query(f"WITH {NOTES_SQL}, {_CHROMA_SQL} SELECT track_id, reg AS register, pos::INT AS pos, round(value, 6) AS value FROM rc")
def register_chroma(spark, sf):
    c = X.chroma(song(spark, sf))
    long = c.unpivot("track_id", [f"{r}_chroma" for r in X.REGISTERS], "register", "value")
    long = long.withColumn("register", F.split("register", "_")[0])
    return exploded(long.withColumnRenamed("value", "chroma"), ["track_id", "register"], "chroma")


@query(f"WITH {NOTES_SQL}, {_CHROMA_SQL} SELECT track_id, pos::INT AS pos, round(value, 6) AS value FROM tc")
def total_chroma(spark, sf):
    return exploded(X.chroma(song(spark, sf)), ["track_id"], "total_chroma")


_NAMES = ", ".join(f"'{c}'" for c in X.PITCH_CLASSES)
_PROFILES = ", ".join(f"({k}, '{n}', [{', '.join(map(str, p))}]::DOUBLE[])" for k, (n, p) in enumerate((("major", X.MAJOR_PROFILE), ("minor", X.MINOR_PROFILE))))
_KEY_SQL = f"""
ch AS (SELECT track_id, list(value ORDER BY pos) AS x FROM tc GROUP BY 1 HAVING max(value) > min(value)),
sc AS (SELECT track_id, i, k, mode,
              (SELECT corr(x[((j - i + 12) % 12) + 1], p[j + 1]) FROM range(12) t(j)) AS score
       FROM ch, range(12) r(i), (VALUES {_PROFILES}) v(k, mode, p)),
ky AS (SELECT track_id, i, mode, score FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, i, k) = 1)"""


@query(f"""WITH {NOTES_SQL}, {_CHROMA_SQL}, {_KEY_SQL}
SELECT s.track_id, [{_NAMES}][i + 1] || ' ' || mode AS key, round(score, 6) AS key_strength, round(cos(i * 2 * pi() / 12), 6) AS key_cos,
       round(sin(i * 2 * pi() / 12), 6) AS key_sin, [{_NAMES}][((12 - i) % 12) + 1] AS tonic
FROM (SELECT DISTINCT track_id FROM m) s LEFT JOIN ky USING (track_id)""")
def chroma_key(spark, sf):
    k = X.key(X.chroma(song(spark, sf)))
    return k.select("track_id", "key", r6("key_strength"), r6("key_cos"), r6("key_sin"), "tonic")


_ENTROPY_SQL = """
vals AS (SELECT track_id, 'pitch' AS kind, pitch::DOUBLE AS v FROM m UNION ALL SELECT track_id, 'duration', "release" - onset FROM m
         UNION ALL SELECT * FROM (SELECT track_id, 'ioi', onset - lag(onset) OVER (PARTITION BY track_id ORDER BY onset, note_seq) AS v FROM m) WHERE v IS NOT NULL),
lim AS (SELECT track_id, kind, v, CASE WHEN a = b THEN a - 0.5::DOUBLE ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5::DOUBLE ELSE b END AS hi
        FROM (SELECT *, min(v) OVER (PARTITION BY track_id, kind) AS a, max(v) OVER (PARTITION BY track_id, kind) AS b FROM vals)),
bn AS (SELECT track_id, kind, least(19, len(list_filter(range(1, 21), lambda i: v >= CASE WHEN i = 20 THEN hi ELSE lo + i * ((hi - lo) / 20) END))) AS bin FROM lim),
en AS (SELECT track_id, kind, sum(-p * ln(p)) AS entropy
       FROM (SELECT track_id, kind, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY track_id, kind) AS p FROM bn GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _entropy(kind: str):
    def run(spark, sf):
        e = X.entropies(song(spark, sf)).where(F.col("kind") == kind)
        return e.select("track_id", r6("entropy"))

    run.__name__ = f"{kind}_entropy"
    query(f"WITH {NOTES_SQL}, {_ENTROPY_SQL} SELECT track_id, round(entropy, 6) AS entropy FROM en WHERE kind = '{kind}'")(run)


for _kind in ("pitch", "duration", "ioi"):
    _entropy(_kind)

_STREAM_SQL = """
mel AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY track_id, onset ORDER BY pitch DESC, note_seq) = 1),
strm AS (SELECT track_id, note_seq, onset, "release", pitch, reg AS stream FROM m
         UNION ALL SELECT track_id, note_seq, onset, "release", pitch, 'melody' FROM mel),
iv AS (SELECT * FROM (SELECT track_id, stream, row_number() OVER w - 2 AS pos, pitch - lag(pitch) OVER w AS step
       FROM strm WINDOW w AS (PARTITION BY track_id, stream ORDER BY onset, note_seq)) WHERE step IS NOT NULL)"""


def _grams_sql(coarse: int) -> str:
    step = "step" if coarse == 1 else f"floor(step / {coarse}.0)::INT"
    return f"""
gr AS (SELECT * FROM (SELECT track_id, stream, pos, s || ',' || lead(s) OVER w || ',' || lead(s, 2) OVER w AS ngram
       FROM (SELECT *, {step} AS s FROM iv) WINDOW w AS (PARTITION BY track_id, stream ORDER BY pos)) WHERE ngram IS NOT NULL),
gc AS (SELECT track_id, stream, ngram, count(*) AS n, min(pos) AS first_pos FROM gr GROUP BY 1, 2, 3)"""


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL} SELECT track_id, onset, pitch FROM mel")
def melody_line(spark, sf):
    return N.melody(song(spark, sf)).select("track_id", "onset", "pitch")


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL} SELECT track_id, stream, pos::INT AS pos, step FROM iv")
def melody_intervals(spark, sf):
    return N.intervals(N.streams(song(spark, sf))).select("track_id", "stream", "pos", "step")


def _counts(spark, sf, coarse=1):
    return N.ngram_counts(N.ngrams(N.intervals(N.streams(song(spark, sf))), coarse=coarse))


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL}, {_grams_sql(1)} SELECT track_id, stream, ngram, n FROM gc")
def ngram_counts(spark, sf):
    return _counts(spark, sf).select("track_id", "stream", "ngram", "n")


_SIZES = ", ".join(f"('{s}', {n})" for s, n in VOCABULARY.items())
_VOCAB_SQL = f"""
df AS (SELECT stream, ngram, count(*) AS df, min((track_id, first_pos)) AS seen FROM gc GROUP BY 1, 2),
vo AS (SELECT stream, ngram, df, row_number() OVER (PARTITION BY stream ORDER BY df DESC, seen, ngram) - 1 AS idx FROM df),
vocab AS (SELECT vo.* FROM vo JOIN (VALUES {_SIZES}) z(stream, most) USING (stream) WHERE idx < most)"""


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL}, {_grams_sql(COARSE)}, {_VOCAB_SQL} SELECT stream, ngram, df, idx::INT AS idx FROM vocab")
def ngram_vocab(spark, sf):
    return V.vocabulary(_counts(spark, sf, COARSE))


_FREQ_SQL = "fr AS (SELECT track_id, stream, idx, n / s AS value FROM (SELECT *, sum(n) OVER (PARTITION BY track_id, stream)::DOUBLE AS s FROM gc) JOIN vocab USING (stream, ngram))"


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL}, {_grams_sql(COARSE)}, {_VOCAB_SQL}, {_FREQ_SQL} SELECT track_id, stream, idx::INT AS idx, round(value, 6) AS value FROM fr")
def ngram_rel_freq(spark, sf):
    counts = _counts(spark, sf, COARSE)
    return V.relative_frequencies(counts, V.vocabulary(counts)).select("track_id", "stream", "idx", r6("value"))


_EDGES = ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(zip(X.LOG_EDGES, X.LOG_EDGES[1:], strict=False)))
_HIST_SQL = f"""
gaps AS (SELECT * FROM (
  SELECT track_id, 'ioi' AS kind, onset - lag(onset) OVER (PARTITION BY track_id ORDER BY onset) AS v FROM m
  UNION ALL SELECT track_id, 'drum_ioi', onset - lag(onset) OVER (PARTITION BY track_id ORDER BY onset) FROM song WHERE is_drum
  UNION ALL SELECT track_id, 'bass_ioi', onset - lag(onset) OVER (PARTITION BY track_id ORDER BY onset) FROM m WHERE reg = 'low'
  UNION ALL SELECT track_id, 'melody_ioi', onset - lag(onset) OVER (PARTITION BY track_id ORDER BY onset) FROM mel
  UNION ALL SELECT track_id, 'duration', "release" - onset FROM m) WHERE v IS NOT NULL),
hg AS (SELECT track_id, kind, pos, c / (sum(c) OVER (PARTITION BY track_id, kind) + 1e-9::DOUBLE) AS value FROM (
  SELECT t.track_id, k.kind, b.pos, count(g.v)::DOUBLE AS c
  FROM (SELECT DISTINCT track_id FROM song) t, (VALUES ('ioi'), ('duration'), ('drum_ioi'), ('bass_ioi'), ('melody_ioi')) k(kind), (VALUES {_EDGES}) b(pos, lo, hi)
  LEFT JOIN gaps g ON g.track_id = t.track_id AND g.kind = k.kind AND g.v >= b.lo AND (g.v < b.hi OR (b.pos = 9 AND g.v = b.hi)) GROUP BY 1, 2, 3))"""


def _hist(name: str, kinds: tuple[str, ...]):
    def run(spark, sf):
        h = X.log_histograms(song(spark, sf)).where(F.col("kind").isin(*kinds))
        return exploded(h, ["track_id", "kind"], "hist")

    run.__name__ = name
    listed = ", ".join(f"'{k}'" for k in kinds)
    query(f"WITH {NOTES_SQL}, {_STREAM_SQL}, {_HIST_SQL} SELECT track_id, kind, pos, round(value, 6) AS value FROM hg WHERE kind IN ({listed})")(run)


_hist("ioi_hist", ("ioi", "bass_ioi", "melody_ioi"))
_hist("duration_hist", ("duration",))
_hist("drum_ioi_hist", ("drum_ioi",))


def _density_sql(rows: str) -> str:
    return f'(SELECT track_id, CASE WHEN count(*) >= 2 THEN count(*) / (max("release") - min(onset) + 1e-9::DOUBLE) ELSE 0 END AS d FROM {rows} GROUP BY 1)'


_DENSITY_SQL = f"""
dn AS (SELECT a.track_id, a.d AS note_density, coalesce(b.d, 0) AS drum_density, coalesce(c.d, 0) AS bass_density, coalesce(e.d, 0) AS melody_density
       FROM {_density_sql("m")} a LEFT JOIN {_density_sql("(SELECT * FROM song WHERE is_drum)")} b USING (track_id)
       LEFT JOIN {_density_sql("(SELECT * FROM m WHERE reg = 'low')")} c USING (track_id) LEFT JOIN {_density_sql("mel")} e USING (track_id))"""
_DENSITIES = ("note_density", "drum_density", "bass_density", "melody_density")


@query(f"WITH {NOTES_SQL}, {_STREAM_SQL}, {_DENSITY_SQL} SELECT track_id, {', '.join(f'round({c}, 6) AS {c}' for c in _DENSITIES)} FROM dn")
def note_density(spark, sf):
    return X.densities(song(spark, sf)).select("track_id", *[r6(c) for c in _DENSITIES])


_SEGMENT_SQL = """
sn AS (SELECT * FROM (SELECT track_id, pitch, onset, min(onset) OVER w AS a, max(onset) OVER w AS b, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY track_id)) WHERE n >= 10),
ss AS (SELECT track_id, pitch % 12 AS pc, len(list_filter(range(1, 17), lambda i: onset >= CASE WHEN i = 16 THEN b ELSE a + i * ((b - a) / 16) END)) AS seg FROM sn WHERE a < b),
sg AS (SELECT track_id, seg, pos, c / (sum(c) OVER (PARTITION BY track_id, seg) + 1e-9::DOUBLE) AS value FROM (
  SELECT t.track_id, g.seg, p.pos, count(ss.pc)::DOUBLE AS c FROM (SELECT DISTINCT track_id FROM sn) t, range(16) g(seg), range(12) p(pos)
  LEFT JOIN ss ON ss.track_id = t.track_id AND ss.seg = g.seg AND ss.pc = p.pos GROUP BY 1, 2, 3)),
sr AS (SELECT track_id, seg, arg_max(pos, (value, -pos)) AS root, list(value ORDER BY pos) AS x FROM sg GROUP BY 1, 2),
sv AS (SELECT track_id, avg((root <> p)::INT) AS harmonic_rhythm, avg(list_distance(x, px)) AS segment_variation FROM (
  SELECT *, lag(root) OVER w AS p, lag(x) OVER w AS px FROM sr WINDOW w AS (PARTITION BY track_id ORDER BY seg)) WHERE p IS NOT NULL GROUP BY 1)"""


@query(f"WITH {NOTES_SQL}, {_SEGMENT_SQL} SELECT track_id, seg::INT AS segment, pos::INT AS pos, round(value, 6) AS value FROM sg")
def segment_chroma(spark, sf):
    s = X.structure(song(spark, sf)).select("track_id", F.posexplode("segment_chroma").alias("segment", "chroma"))
    return exploded(s, ["track_id", "segment"], "chroma")


@query(f"WITH {NOTES_SQL}, {_SEGMENT_SQL} SELECT track_id, seg::INT AS segment, root::INT AS root FROM sr")
def chord_progression(spark, sf):
    return X.structure(song(spark, sf)).select("track_id", F.posexplode("chord_progression").alias("segment", "root"))


@query(f"WITH {NOTES_SQL}, {_SEGMENT_SQL} SELECT track_id, round(harmonic_rhythm, 6) AS harmonic_rhythm FROM sv")
def harmonic_rhythm(spark, sf):
    return X.structure(song(spark, sf)).select("track_id", r6("harmonic_rhythm"))


@query(f"WITH {NOTES_SQL}, {_SEGMENT_SQL} SELECT track_id, round(segment_variation, 6) AS segment_variation FROM sv")
def segment_variation(spark, sf):
    return X.structure(song(spark, sf)).select("track_id", r6("segment_variation"))


# ---------------------------------------------------------------- tracks

_DUP_SQL = """
d AS (SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist_name, p_type AS "release",
             upper(trim(coalesce(p_name, ''))) AS a, upper(trim(coalesce(p_brand, ''))) AS b FROM part),
u AS (SELECT *, first_value(track_id) OVER w AS kept_track_id, row_number() OVER w > 1 AS is_duplicate FROM d WINDOW w AS (PARTITION BY a, b ORDER BY track_id))"""


@query(f"WITH {_DUP_SQL} SELECT track_id, kept_track_id, is_duplicate FROM u")
def dedup_tracks(spark, sf):
    return cleaning.duplicate_tracks(tracks(spark, sf))


@query(f"""WITH {NOTES_SQL}, {_DUP_SQL}
SELECT track_id, title, artist_name, row_number() OVER (ORDER BY track_id) - 1 AS faiss_id
FROM d WHERE track_id IN (SELECT track_id FROM m WHERE track_id NOT IN (SELECT track_id FROM u WHERE is_duplicate))""")
def reindex_tracks(spark, sf):
    named = tracks(spark, sf)
    features = cleaning.drop_duplicates(X.basic_stats(song(spark, sf)), named)
    return cleaning.reindex(named, features).select("track_id", "title", "artist_name", "faiss_id")


@query("SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist_name FROM part WHERE contains(upper(p_name), 'ING')")
def search_title(spark, sf):
    return cleaning.search(tracks(spark, sf), "iNg", "title", limit=0).select("track_id", "title", "artist_name")


_SOUGHT = ("red", "nut PL", "a", "#4", "e B", "no such title")


@query(f"""WITH s(sought) AS (VALUES {", ".join(f"('{t}')" for t in _SOUGHT)})
SELECT sought, p_partkey AS track_id, p_name AS title FROM part JOIN s ON contains(upper(p_name), upper(sought))""")
def search_indexed(spark, sf):
    """Several searches through one trigram index of all titles."""
    index = TextIndex(tracks(spark, sf), "title", "track_id")
    hits = [index.search(text)[0].select(F.lit(text).alias("sought"), "track_id", "title") for text in _SOUGHT]
    return functools.reduce(DataFrame.union, hits)


@query("SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist_name FROM part WHERE contains(upper(p_brand), 'BRAND#1') ORDER BY 1 LIMIT 25")
def search_artist(spark, sf):
    return cleaning.search(tracks(spark, sf), "brand#1", "artist_name", limit=25).select("track_id", "title", "artist_name")


@query("SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist_name, p_type AS \"release\" FROM part WHERE p_partkey = 42")
def song_lookup(spark, sf):
    return cleaning.lookup(tracks(spark, sf), 42).select("track_id", "title", "artist_name", "release")


# ---------------------------------------------------------------- vectors and neighbours

_CUTS = []
_at = 1
for _g, _w in SLICES.items():
    _CUTS.append((_g, _at, _at + _w - 1))
    _at += _w
_GROUPS_SQL = "gv AS (SELECT vec_id AS id, label, " + ", ".join(f"(embedding::DOUBLE[])[{a}:{b}] AS {g}" for g, a, b in _CUTS) + " FROM embeddings)"
_LONG_SQL = "gl AS (" + " UNION ALL ".join(f"SELECT id, '{g}' AS grp, unnest(range({b - a + 1}))::INT AS pos, unnest({g}) AS value FROM gv" for g, a, b in _CUTS) + ")"
_Z_SQL = "zs AS (SELECT grp, pos, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM gl GROUP BY 1, 2)"


@query(f"WITH {_GROUPS_SQL}, {_LONG_SQL}, {_Z_SQL} SELECT grp, pos, round(mean, 6) AS mean, round(std, 6) AS std FROM zs")
def zscore_stats(spark, sf):
    return V.dimension_stats(vector_groups(vectors(spark, sf))).select("grp", "pos", r6("mean"), r6("std"))


_CONSTANT = f"std * std <= n * {V.EPSILON!r}::DOUBLE * std * std + (n * {V.EPSILON!r}::DOUBLE * mean) * (n * {V.EPSILON!r}::DOUBLE * mean)"
_W = ", ".join(f"('{g}', {w}::DOUBLE)" for g, w in DEFAULT_WEIGHTS.items())
_OFFSETS = ", ".join(f"('{g}', {a - 1})" for g, a, b in _CUTS)
_EMBED_SQL = f"""
wv AS (SELECT id, o.skip + pos AS pos, w.w * CASE WHEN grp = 'chroma' THEN value ELSE (value - mean) / CASE WHEN {_CONSTANT} THEN 1 ELSE std END END AS value
       FROM gl JOIN zs USING (grp, pos) JOIN (VALUES {_W}) w(grp, w) USING (grp) JOIN (VALUES {_OFFSETS}) o(grp, skip) USING (grp)),
uv AS (SELECT id, pos, value / coalesce(nullif(sqrt(sum(value * value) OVER (PARTITION BY id)), 0), 1) AS value FROM wv)"""


@query(f"WITH {_GROUPS_SQL}, {_LONG_SQL}, {_Z_SQL}, {_EMBED_SQL} SELECT id, pos::INT AS pos, round(value, 6) AS value FROM uv")
def weighted_l2(spark, sf):
    grouped = V.standardise(vector_groups(vectors(spark, sf)))
    return exploded(V.embed(grouped, V.resolve_weights(None)), ["id"], "embedding")


def _knn_sql(k: int, queries: str = "SELECT id FROM v") -> str:
    return f"""
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
nn AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.x, b.x) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id IN ({queries})),
kn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM nn QUALIFY rank <= {k})"""


@query(f"WITH {_knn_sql(K)} SELECT src, dst, rank::INT AS rank, round(score, 6) AS score FROM kn")
def knn_topk(spark, sf):
    found = vectors(spark, sf)
    return knn.nearest(found, found, K).select("src", "dst", "rank", r6("score"))


@query(f"WITH {_knn_sql(K)} SELECT src, dst, rank::INT AS rank, round(score, 6) AS score FROM kn")
def knn_pruned(spark, sf):
    """The same rows by blocks around pivots."""
    found = materialize(vectors(spark, sf).select("id", "embedding"), "vectors")
    return MetricIndex(found, block=64).search(found, K).select("src", "dst", "rank", r6("score"))


_CUSTOM = V.resolve_weights(CUSTOM)


def _sum_sql(kind: str, w: dict[str, float]) -> str:
    pairs = {"ab": ("a", "b"), "aa": ("a", "a"), "bb": ("b", "b")}[kind]
    return " + ".join(f"{w[g] ** 2!r}::DOUBLE * list_dot_product({pairs[0]}.{g}, {pairs[1]}.{g})" for g in GROUPS)


@query(f"""WITH {_GROUPS_SQL},
nn AS (SELECT a.id AS src, b.id AS dst, ({_sum_sql("ab", _CUSTOM)}) / sqrt(({_sum_sql("aa", _CUSTOM)}) * ({_sum_sql("bb", _CUSTOM)})) AS score
       FROM gv a JOIN gv b ON a.id <> b.id)
SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank, round(score, 6) AS score FROM nn QUALIFY rank <= {K}""")
def knn_custom_weights(spark, sf):
    found = V.embed(vector_groups(vectors(spark, sf)), _CUSTOM)
    return knn.nearest(found, found, K).select("src", "dst", "rank", r6("score"))


_NAMED_SQL = "LEFT JOIN part ON p_partkey = id"


@query(f"""WITH {_knn_sql(K_GRAPH, str(ROOT))}
SELECT src AS source, dst AS target, round(score, 6) AS weight, p_name AS target_title, p_brand AS target_artist FROM kn LEFT JOIN part ON p_partkey = dst""")
def one_hop_graph(spark, sf):
    found = vectors(spark, sf)
    edges = materialize(knn.nearest(found.where(F.col("id") == ROOT), found, K_GRAPH), "edges")
    nodes, out = graph.one_hop(edges, ROOT, names(spark, sf))
    targets = nodes.select(F.col("id").alias("target"), F.col("title").alias("target_title"), F.col("artist_name").alias("target_artist"))
    return out.join(targets, "target").select("source", "target", r6("weight"), "target_title", "target_artist")


_TWO_HOP_SQL = f"""
{_knn_sql(K_GRAPH)},
h1 AS (SELECT src, dst, score FROM kn WHERE src = {ROOT}),
h2 AS (SELECT src, dst, score FROM kn WHERE src IN (SELECT dst FROM h1) AND dst <> {ROOT}),
ed AS (SELECT least(src, dst) AS source, greatest(src, dst) AS target, max(score) AS weight FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2),
no AS (SELECT id, min(r) AS r FROM (SELECT {ROOT} AS id, 0 AS r UNION ALL SELECT dst, 1 FROM h1 UNION ALL SELECT dst, 2 FROM h2) GROUP BY 1)"""


def _two_hop(spark, sf):
    return graph.two_hop(graph.two_hop_edges(vectors(spark, sf), ROOT, K_GRAPH), ROOT, names(spark, sf))


@query(f"WITH {_TWO_HOP_SQL} SELECT id::BIGINT AS id, ['query', 'hop_1', 'hop_2'][r + 1] AS type, p_name AS title, p_brand AS artist_name FROM no {_NAMED_SQL}")
def two_hop_graph(spark, sf):
    return _two_hop(spark, sf)[0].select("id", "type", "title", "artist_name")


@query(f"""WITH {_TWO_HOP_SQL} SELECT source, target, round(weight, 6) AS weight, CASE WHEN {ROOT} IN (source, target) THEN '1' ELSE '2' END AS hop FROM ed""")
def edge_hops(spark, sf):
    return graph.hop_labels(*_two_hop(spark, sf)).select("source", "target", r6("weight"), "hop")


_PATH_SQL = f"""{_knn_sql(K)},
pa(node, cost, path) AS (
  SELECT {PATH[0]}::BIGINT, 0::DOUBLE, [{PATH[0]}::BIGINT]
  UNION ALL SELECT dst, cost + greatest(0, 1 - score), list_append(path, dst) FROM pa JOIN kn ON src = node
  WHERE node <> {PATH[1]} AND len(path) < 6 AND NOT list_contains(path, dst)),
best AS (SELECT path, cost FROM pa WHERE node = {PATH[1]} ORDER BY cost, len(path) LIMIT 1)"""


@query(f"""WITH RECURSIVE {_PATH_SQL},
st AS (SELECT cost AS total, i - 1 AS position, path[i] AS source, path[i + 1] AS target FROM best, unnest(range(1, len(path))) t(i))
SELECT position::INT AS position, source, target, round(score, 6) AS similarity, round(1 - score, 6) AS cost, round(total, 6) AS total_cost
FROM st JOIN kn ON src = source AND dst = target""")
def shortest_path(spark, sf):
    found = vectors(spark, sf)
    known = materialize(knn.nearest(found, found, K), "edges")
    nodes, edges, total = graph.shortest_path(known, *PATH, names(spark, sf))
    return edges.select("position", "source", "target", r6("similarity"), r6("cost"), F.round(F.lit(total).cast("double"), 6).alias("total_cost"))


# ---------------------------------------------------------------- the library's calls as one object


def _explorer(spark, sf, k: int | None = None) -> Explorer:
    """Over the tables; with k, its neighbour edges are kept as a build keeps them."""
    found = vectors(spark, sf)
    edges = materialize(knn.nearest(found, found, k), "edges") if k else None
    return Explorer(vector_names(spark, sf), found.select("id", "embedding"), vector_groups(found).drop("label"), {g: 1.0 for g in GROUPS}, edges)


@query(f"WITH {_knn_sql(K, str(ROOT))} SELECT dst AS id, p_name AS title, p_brand AS artist_name, round(score, 6) AS score FROM kn LEFT JOIN part ON p_partkey = dst")
def explorer_neighbours(spark, sf):
    return _explorer(spark, sf, K).neighbours(ROOT, K).select("id", "title", "artist_name", r6("score"))


@query(f"""WITH {_GROUPS_SQL},
nn AS (SELECT b.id AS dst, ({_sum_sql("ab", _CUSTOM)}) / sqrt(({_sum_sql("aa", _CUSTOM)}) * ({_sum_sql("bb", _CUSTOM)})) AS score FROM gv a JOIN gv b ON a.id <> b.id WHERE a.id = {ROOT})
SELECT dst AS id, p_name AS title, p_brand AS artist_name, round(score, 6) AS score FROM nn LEFT JOIN part ON p_partkey = dst ORDER BY nn.score DESC, dst LIMIT {K}""")
def explorer_custom_neighbours(spark, sf):
    explorer = _explorer(spark, sf, K)
    explorer.build_custom(CUSTOM)
    return explorer.neighbours(ROOT, K).select("id", "title", "artist_name", r6("score"))


@query(f"WITH {_TWO_HOP_SQL} SELECT source, target, round(weight, 6) AS weight FROM ed")
def explorer_two_hop(spark, sf):
    return _explorer(spark, sf, K).two_hop_graph(ROOT, K_GRAPH)[1].select("source", "target", r6("weight"))


@query(f"""WITH RECURSIVE {_PATH_SQL}
SELECT i - 1 AS position, path[i] AS id, CASE WHEN i = 1 THEN 'start' WHEN i = len(path) THEN 'end' ELSE 'path' END AS type, p_name AS title, p_brand AS artist_name
FROM best, unnest(range(1, len(path) + 1)) t(i) LEFT JOIN part ON p_partkey = path[i]""")
def explorer_path(spark, sf):
    """Without kept edges: only the part of the graph that the search meets is made."""
    return _explorer(spark, sf).path(*PATH, K)[0].select("position", "id", "type", "title", "artist_name")


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS artist_name FROM part WHERE contains(upper(p_name), 'RED') AND p_partkey IN (SELECT vec_id FROM embeddings)")
def explorer_search(spark, sf):
    explorer = _explorer(spark, sf)
    explorer.index_search()
    return explorer.search("red").select("id", "title", "artist_name")


@query(f"""WITH {NOTES_SQL.split(",\nsong AS")[0]}
SELECT track_id, is_drum, pitch, velocity, onset, min("end") AS "release"
FROM (SELECT a.*, b."release" AS "end", a.note_seq AS k FROM e a JOIN e b ON b.track_id = a.track_id AND b.file_no = a.file_no AND b.is_drum = a.is_drum AND b.pitch = a.pitch AND b."release" > a.onset)
GROUP BY track_id, is_drum, pitch, velocity, onset, k""")
def midi_files(spark, sf):
    """All notes written as MIDI files and read again.  In a file the next end of a pitch ends all its open notes."""
    folder = work_path(spark, "midi")
    write_midi(notes(spark, sf), folder)
    return read_midi(spark, folder).select(F.col("track_id").cast("long").alias("track_id"), "is_drum", "pitch", "velocity", "onset", "release")


@query("""SELECT vec_id AS id, len(embedding) AS dims, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, list_min(embedding)::DOUBLE AS least,
       list_max(embedding)::DOUBLE AS most FROM embeddings""")
def array_files(spark, sf):
    """All vectors, each behind its id, written as npy files and read again."""
    folder = work_path(spark, "arrays")
    numbered = read_table(spark, sf, "embeddings").select("vec_id", F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("numbers"))
    write_arrays(numbered, folder, "numbers", "vec_id")
    values = F.slice("values", 2, F.size("values") - 1)
    back = read_arrays(spark, folder).select(F.element_at("values", 1).cast("long").alias("id"), values.alias("v"))
    return back.select("id", F.size("v").cast("long").alias("dims"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))


@query("""SELECT p_partkey::VARCHAR AS track_id, p_brand AS artist_name, 'a"b, c' AS artist_id, p_name AS title, 'None' AS song_id, p_type AS "release", NULL::VARCHAR AS genre,
       'x/' || p_partkey || '.mid' AS midi_path FROM part""")
def metadata_csv(spark, sf):
    """Metadata written as CSV and read again."""
    text = lambda c: F.lit(c).cast("string")
    rows = tracks(spark, sf).select(
        F.col("track_id").cast("string").alias("track_id"), "artist_name", text('a"b, c').alias("artist_id"), "title", text("None").alias("song_id"), "release",
        text(None).alias("genre"), F.concat(F.lit("x/"), "track_id", F.lit(".mid")).alias("midi_path"),
    )
    path = work_path(spark, "metadata")
    write_csv(rows, path)
    return read_metadata_csv(spark, path)


@query("SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders")
def append_unique(spark, sf):
    """Two overlapping parts appended to one keyed table, one row for each key (SET1 and SET3)."""
    rows = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    table = KeyedTable(spark, work_path(spark, "keyed"), ["k", "v"])
    table.append(rows.where("k % 3 <> 0"))
    table.append(rows.where("k % 2 = 0 OR k % 3 = 0"))
    return table.read()


# ---------------------------------------------------------------- evaluation

_CHOICE = "CASE comparison % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN 'c' ELSE '' END"
_NUMBERED_SQL = "nu AS (SELECT p_partkey AS track_id, p_brand || ' - ' || p_name AS label, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)"


def _roles(column: str) -> str:
    return ", ".join(
        f"CASE lower(choice) WHEN 'a' THEN {column}{a} WHEN 'b' THEN {column}{b} ELSE {column}{c} END AS {role}_track{'' if column == 'l' else '_id'}"
        for role, (a, b, c) in {"root": (0, 0, 1), "closer": (1, 2, 2), "further": (2, 1, 0)}.items()
    )


@query(f"""WITH {_NUMBERED_SQL},
tr AS (SELECT i // 3 AS comparison, max(track_id) FILTER (i % 3 = 0) AS t0, max(track_id) FILTER (i % 3 = 1) AS t1, max(track_id) FILTER (i % 3 = 2) AS t2,
              max(label) FILTER (i % 3 = 0) AS l0, max(label) FILTER (i % 3 = 1) AS l1, max(label) FILTER (i % 3 = 2) AS l2 FROM nu GROUP BY 1 HAVING count(*) = 3),
ju AS (SELECT *, {_CHOICE} AS choice FROM tr)
SELECT comparison, {_roles("l")}, {_roles("t")} FROM ju WHERE choice <> ''""")
def triplet_build(spark, sf):
    named = tracks(spark, sf)
    numbered = cleaning.reindex(named, named)
    choices = numbered.select(F.floor(F.col("faiss_id") / 3).alias("comparison")).distinct().withColumn("choice", F.expr(_CHOICE))
    return evaluation.build_triplets(numbered, choices)


@query(f"WITH {_NUMBERED_SQL} SELECT track_id, label, i - 40 AS place FROM nu WHERE i >= 40 AND i < 70")
def metadata_page(spark, sf):
    named = tracks(spark, sf)
    rows = evaluation.page(cleaning.reindex(named, named), 30, 40)
    return rows.select("track_id", F.concat_ws(" - ", "artist_name", "title").alias("label"), F.col("faiss_id").alias("place"))


@query(f"""WITH {_NUMBERED_SQL},
tr AS (SELECT i // 3 AS comparison, max(track_id) FILTER (i % 3 = 0) AS t0, max(track_id) FILTER (i % 3 = 1) AS t1, max(track_id) FILTER (i % 3 = 2) AS t2 FROM nu GROUP BY 1 HAVING count(*) = 3),
ju AS (SELECT *, {_CHOICE} AS choice FROM tr), ro AS (SELECT comparison, {_roles("t")} FROM ju WHERE choice <> ''), ev AS (SELECT vec_id FROM embeddings)
SELECT comparison, a.i AS root_embedding_index, b.i AS closer_embedding_index, c.i AS further_embedding_index
FROM ro JOIN nu a ON a.track_id = root_track_id JOIN nu b ON b.track_id = closer_track_id JOIN nu c ON c.track_id = further_track_id WHERE a.i IN (FROM ev) AND b.i IN (FROM ev) AND c.i IN (FROM ev)""")
def triplet_index(spark, sf):
    named = tracks(spark, sf)
    numbered = cleaning.reindex(named, named)
    choices = numbered.select(F.floor(F.col("faiss_id") / 3).alias("comparison")).distinct().withColumn("choice", F.expr(_CHOICE))
    mapping = evaluation.track_mapping(numbered, read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))
    found = evaluation.index_triplets(evaluation.build_triplets(numbered, choices), mapping)
    return found.select("comparison", "root_embedding_index", "closer_embedding_index", "further_embedding_index")


#: Triplets over the vectors: rows of three, judged in turn a, b, c.
_TRIPLET_SQL = f"""{_GROUPS_SQL},
tp AS (SELECT id // 3 AS triplet, id + CASE WHEN id // 3 % 3 = 2 THEN 1 ELSE 0 END AS root, id + CASE WHEN id // 3 % 3 = 0 THEN 1 ELSE 2 END AS closer,
              id + CASE id // 3 % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS further FROM gv WHERE id % 3 = 0 AND id + 2 <= (SELECT max(id) FROM gv)),
td AS (SELECT triplet, {", ".join(f"list_dot_product(r.{g}, c.{g}) AS rc_{g}, list_dot_product(r.{g}, f.{g}) AS rf_{g}, list_dot_product(r.{g}, r.{g}) AS rr_{g}, list_dot_product(c.{g}, c.{g}) AS cc_{g}, list_dot_product(f.{g}, f.{g}) AS ff_{g}" for g in GROUPS)}
       FROM tp JOIN gv r ON r.id = root JOIN gv c ON c.id = closer JOIN gv f ON f.id = further)"""


def _triplets(grouped: DataFrame) -> DataFrame:
    turn = F.floor(F.col("id") / 3) % 3
    last = grouped.agg(F.max("id").alias("last"))
    rows = grouped.join(F.broadcast(last)).where((F.col("id") % 3 == 0) & (F.col("id") + 2 <= F.col("last")))
    return rows.select(
        F.floor(F.col("id") / 3).alias("triplet"),
        (F.col("id") + F.when(turn == 2, 1).otherwise(0)).alias("root"),
        (F.col("id") + F.when(turn == 0, 1).otherwise(2)).alias("closer"),
        (F.col("id") + F.when(turn == 0, 2).when(turn == 1, 1).otherwise(0)).alias("further"),
    )


def _margin_sql(weight) -> str:
    total = lambda kind: " + ".join(f"{weight(g)} * {weight(g)} * {kind}_{g}" for g in GROUPS)
    one = lambda d, o: f"coalesce(({total(d)}) / nullif(sqrt(({total('rr')}) * ({total(o)})), 0), 0)"
    return f"{one('rc', 'cc')} - {one('rf', 'ff')}"


_METRIC_SQL = "avg((margin > 0)::INT) AS accuracy, round(avg(margin), 6) AS mean_margin, round(median(margin), 6) AS median_margin, round(stddev_pop(margin), 6) AS std_margin"


def _scored(trials: DataFrame, spark, sf) -> DataFrame:
    grouped = vector_groups(vectors(spark, sf))
    return evaluation.score_trials(trials, evaluation.triplet_dots(_triplets(grouped), grouped))


@query(f"WITH {_TRIPLET_SQL}, mg AS (SELECT {_margin_sql(lambda g: f'{DEFAULT_WEIGHTS[g]}::DOUBLE')} AS margin FROM td) SELECT {_METRIC_SQL} FROM mg")
def triplet_accuracy(spark, sf):
    one = spark.range(1).select(F.col("id").alias("trial"), *[F.lit(DEFAULT_WEIGHTS[g]).alias(f"weight_{g}") for g in GROUPS])
    return _scored(one, spark, sf).select("accuracy", r6("mean_margin"), r6("median_margin"), r6("std_margin"))


_GRID_SQL = "gd AS (SELECT trial, " + ", ".join(f"([0.0, 2.5, 5.0]::DOUBLE[])[(trial // {3 ** (8 - k)}) % 3 + 1] AS weight_{g}" for k, g in enumerate(GROUPS)) + " FROM range(19683) t(trial))"
_WEIGHTS = [f"weight_{g}" for g in GROUPS]


@query(f"""WITH {_TRIPLET_SQL}, {_GRID_SQL}, mg AS (SELECT trial, {_margin_sql(lambda g: f"weight_{g}")} AS margin FROM gd, td) SELECT trial, {_METRIC_SQL} FROM mg GROUP BY 1""")
def weight_search(spark, sf):
    return _scored(evaluation.weight_grid(spark), spark, sf).select("trial", "accuracy", r6("mean_margin"), r6("median_margin"), r6("std_margin"))


_RANDOM_SQL = "rw AS (SELECT trial, " + ", ".join(f"('0x' || md5('19:' || trial || ':{g}')[1:13])::BIGINT / {1 << 52}.0::DOUBLE * 5.0::DOUBLE AS weight_{g}" for g in GROUPS) + " FROM range(20000) t(trial))"
_RANDOM_SCORED_SQL = f"""{_TRIPLET_SQL}, {_RANDOM_SQL}, mg AS (SELECT trial, {_margin_sql(lambda g: f"weight_{g}")} AS margin FROM rw, td),
sc AS (SELECT trial, {_METRIC_SQL} FROM mg GROUP BY 1)"""


@query(f"WITH {_RANDOM_SCORED_SQL} SELECT trial, {', '.join(f'round({w}, 6) AS {w}' for w in _WEIGHTS)}, accuracy, mean_margin FROM rw JOIN sc USING (trial)")
def weight_random(spark, sf):
    """The random trials, scored over the triplets of the given vectors."""
    return _scored(evaluation.random_weights(spark), spark, sf).select("trial", *map(r6, _WEIGHTS), "accuracy", r6("mean_margin"))


@query(f"""WITH {_RANDOM_SCORED_SQL}, lg AS (UNPIVOT (SELECT {", ".join(_WEIGHTS)}, accuracy FROM rw JOIN sc USING (trial)) ON {", ".join(_WEIGHTS)} INTO NAME weight VALUE v)
SELECT weight, accuracy, count(*) AS trials, count(DISTINCT v) AS distinct_values, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM lg GROUP BY 1, 2""")
def weight_random_ranges(spark, sf):
    """Of each weight, the range and mean that the trials of one accuracy have: which weights an accuracy asks for."""
    scored = _scored(evaluation.random_weights(spark), spark, sf)
    long = scored.unpivot("accuracy", _WEIGHTS, "weight", "value")
    return long.groupBy("weight", "accuracy").agg(
        F.count(F.lit(1)).alias("trials"),
        F.countDistinct("value").alias("distinct_values"),
        F.round(F.min("value"), 6).alias("least"),
        F.round(F.max("value"), 6).alias("most"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


@query(f"""WITH {_TRIPLET_SQL}, {_GRID_SQL}, mg AS (SELECT trial + 500 AS trial, {", ".join(_WEIGHTS)}, {_margin_sql(lambda g: f"weight_{g}")} AS margin FROM gd, td)
SELECT trial, {_METRIC_SQL}, {", ".join(f"any_value({w}) AS {w}" for w in _WEIGHTS)} FROM mg GROUP BY trial
UNION ALL SELECT -1, 500 + 19683, NULL, NULL, NULL, {", ".join("NULL" for _ in _WEIGHTS)}""")
def weight_evaluation(spark, sf):
    """evaluate() over 500 random and all grid trials: the grid's rows, and one row (trial -1) with the number of all."""
    grouped = vector_groups(vectors(spark, sf))
    scored, _ = evaluate(grouped, _triplets(grouped), trials=500)
    columns = ["trial", "accuracy", *[r6(c) for c in ("mean_margin", "median_margin", "std_margin")], *_WEIGHTS]
    nulls = [F.lit(None).cast("double").alias(c) for c in ("mean_margin", "median_margin", "std_margin", *_WEIGHTS)]
    counted = scored.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("long").alias("trial"), F.col("n").cast("double").alias("accuracy"), *nulls)
    return scored.where("trial >= 500").select(columns).union(counted)


# ---------------------------------------------------------------- analytics over a table of trials

_TRIAL_WEIGHT = "CASE WHEN o_orderkey % 3 = 0 THEN ((o_custkey + {k}) % 3) * 2.5 ELSE ((o_orderkey * {k} + o_custkey) % 101) / 20.0 END"
_TRIAL_COLUMNS = {
    "trial": "o_orderkey",
    "accuracy": "((o_custkey * 7 + o_orderkey) % 120) / 120.0",
    "mean_margin": "((o_custkey * 3 + o_orderkey) % 97) / 97.0",
    "median_margin": "(o_custkey % 89) / 89.0",
    "std_margin": "(o_orderkey % 83) * (o_orderkey % 83) / 83.0",
} | {w: _TRIAL_WEIGHT.format(k=k + 1) for k, w in enumerate(_WEIGHTS)}
_TRIALS_SQL = "ts AS (SELECT " + ", ".join(f"({e})::{'BIGINT' if c == 'trial' else 'DOUBLE'} AS {c}" for c, e in _TRIAL_COLUMNS.items()) + " FROM orders)"
_STRATEGY_SQL = f"{_TRIALS_SQL}, sy AS (SELECT *, CASE WHEN {' AND '.join(f'{w} IN (0, 2.5, 5)' for w in _WEIGHTS)} THEN 'gridsearch' ELSE 'uniform_sampled' END AS sampling_strategy FROM ts)"
_MELT_SQL = f"{_STRATEGY_SQL}, ml AS (" + " UNION ALL ".join(f"SELECT sampling_strategy, '{c}' AS metric, {c} AS v FROM sy" for c in A.METRICS) + ")"
_TOP_SQL = f"{_STRATEGY_SQL}, tt AS (SELECT * FROM sy ORDER BY accuracy DESC, trial LIMIT {A.TOP})"


def _trials(spark, sf):
    """Stand-in trials from orders; weights of every third are on the grid."""
    double = lambda e: e.replace("2.5", "2.5D").replace(".0", ".0D")
    return read_table(spark, sf, "orders").select(
        *[F.expr(double(e)).cast("long" if c == "trial" else "double").alias(c) for c, e in _TRIAL_COLUMNS.items()]
    )


@query(f"WITH {_STRATEGY_SQL} SELECT sampling_strategy, count(*) AS trials FROM sy GROUP BY 1")
def strategy_split(spark, sf):
    return A.strategy_counts(_trials(spark, sf))


@query(f"""WITH {_MELT_SQL}, sp AS (SELECT *, min(v) OVER (PARTITION BY sampling_strategy, metric) AS lo, max(v) OVER (PARTITION BY sampling_strategy, metric) AS hi FROM ml)
SELECT sampling_strategy, metric, least(9, len(list_filter(range(1, 11), lambda i: v >= CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END)))::INT AS bin, count(*) AS n
FROM sp GROUP BY 1, 2, 3""")
def metric_hist(spark, sf):
    return A.histograms(_trials(spark, sf))


@query(f"""WITH {_STRATEGY_SQL}, u AS (SELECT * FROM sy ORDER BY accuracy DESC, trial LIMIT {A.TOP}), ml AS ({" UNION ALL ".join(f"SELECT sampling_strategy, '{w}' AS metric, {w} AS v FROM u" for w in _WEIGHTS)}),
sp AS (SELECT *, min(v) OVER (PARTITION BY sampling_strategy, metric) AS lo0, max(v) OVER (PARTITION BY sampling_strategy, metric) AS hi0 FROM ml),
sq AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM sp)
SELECT sampling_strategy, metric, least(2, len(list_filter(range(1, 4), lambda i: v >= CASE WHEN i = 3 THEN hi ELSE lo + i * ((hi - lo) / 3) END)))::INT AS bin, count(*) AS n
FROM sq GROUP BY 1, 2, 3""")
def top100_weight_hist(spark, sf):
    return A.histograms(A.top_trials(_trials(spark, sf)), _WEIGHTS, bins=3)


_FIVE = [("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1)]
_FIVE_SQL = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in _FIVE)


@query(f"WITH {_MELT_SQL} SELECT sampling_strategy, metric, {_FIVE_SQL} FROM ml GROUP BY 1, 2")
def score_boxplot(spark, sf):
    return A.five_numbers(_trials(spark, sf)).select("sampling_strategy", "metric", *[r6(n) for n, _ in _FIVE])


@query(f"WITH {_TRIALS_SQL} SELECT trial, round(accuracy, 6) AS accuracy FROM ts WHERE accuracy <> 0")
def nonzero_accuracy(spark, sf):
    return A.drop_zero_accuracy(_trials(spark, sf)).select("trial", r6("accuracy"))


@query(f"""WITH {_STRATEGY_SQL}, q AS (SELECT sampling_strategy, quantile_cont(std_margin, 0.25) AS a, quantile_cont(std_margin, 0.75) AS b FROM sy GROUP BY 1)
SELECT sampling_strategy, count(*) FILTER (std_margin < a - 1.5 * (b - a) OR std_margin > b + 1.5 * (b - a)) AS outliers FROM sy JOIN q USING (sampling_strategy) GROUP BY 1""")
def iqr_outliers(spark, sf):
    return A.iqr_outliers(_trials(spark, sf))


_CORR = [c for c in _TRIAL_COLUMNS if c != "trial"]


@query(f"WITH {_TRIALS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM ts" for i, a in enumerate(_CORR) for b in _CORR[: i + 1]))
def metric_corr(spark, sf):
    return A.correlations(_trials(spark, sf)).select("column_a", "column_b", r6("corr"))


@query(f"WITH {_TOP_SQL} SELECT count(*) AS top, round(count(*) / (SELECT count(*) FROM ts), 6) AS share FROM tt")
def top100_share(spark, sf):
    return A.top_share(_trials(spark, sf)).select("top", r6("share"))


@query(f"WITH {_TOP_SQL} SELECT sampling_strategy, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tt GROUP BY 1")
def top100_mix(spark, sf):
    return A.top_mix(_trials(spark, sf)).select("sampling_strategy", r6("share"))


@query(f"WITH {_TOP_SQL}, u AS (SELECT * FROM sy WHERE sampling_strategy = 'uniform_sampled' ORDER BY accuracy DESC, trial LIMIT {A.TOP}) " + " UNION ALL ".join(f"SELECT '{w}' AS weight, round(stddev_samp({w}), 6) AS std, round(stddev_samp({w}) / 5, 6) AS dispersion FROM u" for w in _WEIGHTS))
def weight_dispersion(spark, sf):
    return A.weight_dispersion(_trials(spark, sf)).select("weight", r6("std"), r6("dispersion"))


@query(f"WITH {_TOP_SQL}, ml AS (" + " UNION ALL ".join(f"SELECT sampling_strategy, '{c}' AS metric, {c} AS v FROM tt" for c in A.METRICS[1:]) + f") SELECT sampling_strategy, metric, {_FIVE_SQL} FROM ml GROUP BY 1, 2")
def top100_margins(spark, sf):
    return A.top_margins(_trials(spark, sf)).select("sampling_strategy", "metric", *[r6(n) for n, _ in _FIVE])


@query(f"WITH {_TRIALS_SQL} SELECT {', '.join(_WEIGHTS)} FROM ts ORDER BY accuracy DESC, trial LIMIT 1")
def best_weighting(spark, sf):
    return evaluation.best_weighting(_trials(spark, sf))


_BEST_SQL = f"bw AS (SELECT {', '.join(_WEIGHTS)} FROM ts ORDER BY accuracy DESC, trial LIMIT 1)"


@query(f"""WITH {_TRIALS_SQL}, {_GRID_SQL}, n AS (SELECT {", ".join(_WEIGHTS)}, count(*) AS tried FROM ts GROUP BY ALL)
SELECT gd.trial, {", ".join(f"gd.{w}" for w in _WEIGHTS)}, coalesce(tried, 0) AS tried FROM gd LEFT JOIN n USING ({", ".join(_WEIGHTS)})""")
def weight_grid(spark, sf):
    """The grid, and how many of the given trials used each of its weightings."""
    tried = _trials(spark, sf).groupBy(*_WEIGHTS).agg(F.count(F.lit(1)).alias("tried"))
    return evaluation.weight_grid(spark).join(tried, _WEIGHTS, "left").select("trial", *_WEIGHTS, F.coalesce("tried", F.lit(0)).cast("long").alias("tried"))


def _state_sql(mode: str, weight) -> str:
    total = lambda a, b: " + ".join(f"{weight(g)} * {weight(g)} * list_dot_product({a}.{g}, {b}.{g})" for g in GROUPS)
    score = f"({total('a', 'b')}) / sqrt(({total('a', 'a')}) * ({total('b', 'b')}))"
    nearest = f"(SELECT b.id FROM gv a JOIN gv b ON a.id <> b.id, bw WHERE a.id = {ROOT} ORDER BY {score} DESC, b.id LIMIT 1)"
    return " UNION ALL ".join(f"SELECT '{mode}' AS mode, '{g}' AS weight, {weight(g)} AS value, {nearest} AS nearest FROM bw" for g in GROUPS)


@query(f"""WITH {_TRIALS_SQL}, {_BEST_SQL}, {_GROUPS_SQL}
{_state_sql("custom", lambda g: f"bw.weight_{g}")} UNION ALL {_state_sql("default", lambda g: "1.0::DOUBLE")}""")
def explorer_weights(spark, sf):
    """status() once the best weighting of the given trials is in use and after going back, and a song's nearest under each."""
    explorer = _explorer(spark, sf)
    best = evaluation.best_weighting(_trials(spark, sf)).first()
    rows = []
    for state in (lambda: explorer.build_custom({g: best[f"weight_{g}"] for g in GROUPS}), explorer.use_default):
        status, nearest = state(), explorer.neighbours(ROOT, 1).first()["id"]
        rows += [(status["mode"], g, w, nearest) for g, w in status["weights"].items()]
    return spark.createDataFrame(rows, "mode string, weight string, value double, nearest long")


# ---------------------------------------------------------------- whole songs

_VECTOR_SQL = f"""
{NOTES_SQL}, {_STATS_SQL}, {_CHROMA_SQL}, {_KEY_SQL}, {_ENTROPY_SQL}, {_STREAM_SQL}, {_grams_sql(COARSE)}, {_VOCAB_SQL}, {_FREQ_SQL}, {_HIST_SQL}, {_DENSITY_SQL}, {_SEGMENT_SQL},
sx AS (SELECT track_id, list_value(note_count, mean_pitch, std_pitch, pitch_range, mean_duration, std_duration, mean_velocity, std_velocity, mean_instruments)::DOUBLE[] AS x FROM st JOIN f USING (track_id)),
al AS (
  SELECT track_id, 'stats' AS grp, unnest(range(9)) AS pos, unnest(x) AS value FROM sx
  UNION ALL SELECT track_id, 'chroma', pos, value FROM tc
  UNION ALL SELECT track_id, 'chroma', pos + CASE reg WHEN 'low' THEN 12 WHEN 'mid' THEN 24 ELSE 36 END, value FROM rc
  UNION ALL SELECT track_id, 'chroma', unnest([48, 49, 50]), unnest([score, cos(i * 2 * pi() / 12), sin(i * 2 * pi() / 12)]) FROM ky
  UNION ALL SELECT track_id, 'entropy', CASE kind WHEN 'pitch' THEN 0 WHEN 'duration' THEN 1 ELSE 2 END, entropy FROM en
  UNION ALL SELECT track_id, 'rhythm', pos + CASE kind WHEN 'ioi' THEN 0 WHEN 'duration' THEN 10 WHEN 'drum_ioi' THEN 20 WHEN 'bass_ioi' THEN 30 ELSE 40 END, value FROM hg
  UNION ALL SELECT track_id, 'rhythm', unnest([50, 51, 52, 53]), unnest([note_density, drum_density, bass_density, melody_density]) FROM dn
  UNION ALL SELECT track_id, 'structure', seg * 12 + pos, value FROM sg
  UNION ALL SELECT track_id, 'structure', 192 + seg, root FROM sr
  UNION ALL SELECT track_id, 'structure', unnest([208, 209]), unnest([harmonic_rhythm, segment_variation]) FROM sv
  UNION ALL SELECT t.track_id, v.stream, v.idx, coalesce(fr.value, 0) FROM (SELECT DISTINCT track_id FROM m) t CROSS JOIN vocab v
    LEFT JOIN fr ON fr.track_id = t.track_id AND fr.stream = v.stream AND fr.idx = v.idx)"""


def _groups(spark, sf) -> DataFrame:
    s = N.note_table(notes(spark, sf))
    counts = materialize(N.ngram_counts(N.ngrams(N.intervals(N.streams(s)), coarse=COARSE)), "counts")
    vocab = materialize(V.vocabulary(counts), "vocab")
    return materialize(V.feature_groups(X.vector_features(s), counts, vocab), "groups")


@query(f"WITH {_VECTOR_SQL} SELECT track_id, grp, pos::INT AS pos, round(value, 6) AS value FROM al")
def feature_vectors(spark, sf):
    grouped = _groups(spark, sf)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("x")) for g in GROUPS])).alias("g")
    return exploded(grouped.select("track_id", each).select("track_id", "g.grp", "g.x"), ["track_id", "grp"], "x")


_SONG_VECTOR_SQL = f"""{_VECTOR_SQL},
zs AS (SELECT grp, pos, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM al GROUP BY 1, 2),
wv AS (SELECT track_id, grp, pos, w.w * CASE WHEN grp = 'chroma' THEN value ELSE (value - mean) / CASE WHEN {_CONSTANT} THEN 1 ELSE std END END AS value
       FROM al JOIN zs USING (grp, pos) JOIN (VALUES {_W}) w(grp, w) USING (grp)),
uv AS (SELECT track_id, list(value / n ORDER BY grp, pos) AS x FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY track_id)) AS n FROM wv) GROUP BY 1)"""


@query(f"""WITH {_SONG_VECTOR_SQL}, nn AS (SELECT a.track_id AS src, b.track_id AS dst, list_dot_product(a.x, b.x) AS score FROM uv a JOIN uv b ON a.track_id <> b.track_id)
SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank, round(score, 6) AS score FROM nn QUALIFY rank <= {K_GRAPH}""")
def song_neighbours(spark, sf):
    found = V.embed(V.standardise(_groups(spark, sf)), V.resolve_weights(None)).select(F.col("track_id").alias("id"), "embedding")
    found = materialize(found, "embeddings")
    return knn.nearest(found, found, K_GRAPH).select("src", "dst", "rank", r6("score"))


# ---------------------------------------------------------------- the streaming extension, on a static frame


@query(f"""WITH {NOTES_SQL}
SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, track_id, count(*) AS note_count, round(avg(pitch), 6) AS mean_pitch, max(pitch) - min(pitch) AS pitch_range
FROM e JOIN events ON event_id = note_seq WHERE NOT is_drum GROUP BY 1, 2""")
def windowed_stats(spark, sf):
    stamped = notes(spark, sf).join(read_table(spark, sf, "events").select(F.col("event_id").alias("note_seq"), "ts"), "note_seq")
    found = windowed_note_stats(stamped)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("mean_pitch", F.round("mean_pitch", 6))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
