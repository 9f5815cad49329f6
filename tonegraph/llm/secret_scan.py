"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content.  The ledger holds, for each
(blob, rule version) pair scanned so far, the spans found.  A scan picks one carrier for each blob
that the ledger lacks under the present rule version, scans those texts alone, appends them to the
ledger and joins the findings back to every path that holds the blob.  Texts whose blob a bitmap clears (held by one
path, and not in the ledger) are scanned where they lie; only the others move, dealt by the carrier's identifier.

The ledger is a folder with one table for each scan.  A scan counts once its table is complete (Spark's commit
marker), so a scan that failed leaves nothing behind, and a ledger that is opened again knows all earlier scans.  The query sends
its table through one ledger in BATCHES, so that later batches find blobs of earlier ones in it.

Positions of regular-expression matches: split() gives the text between matches and regexp_extract_all() the matches, so a
running sum of their lengths is each match's start in code points.  The sum runs over runs of about sqrt(matches) matches
and then inside each, so that a text of very many matches is not copied for each of them.

Defined edge cases: null text is the empty blob; empty texts have no spans; repeated rows and equal
texts share a blob and each gets its findings; a null doc_id is a path like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, work_path
from .membership import marked, once

# The base rules (kind, pattern, group whose length counts, least length).
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
RULE_VERSION = "base-1"
#: Scans that the query sends its table through the ledger in.
BATCHES = 2
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of spans, leftmost and non-overlapping.

    A match of a single class that is too short is a whole run of that class, so dropping it equals
    never matching it; those rules look for runs that are long enough at once."""
    if group == 0:
        head = pattern[: pattern.index("[")]
        pattern = f"{pattern[:-1]}{{{least - len(head)},}}"
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = lambda texts: F.transform(texts, lambda t: F.length(t).cast("bigint"))
    parts = F.arrays_zip(F.slice(lengths(between), F.lit(1), F.size(whole)).alias("gap"), lengths(whole).alias("hit"), lengths(value).alias("value"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + part["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        found = F.when(part["value"] >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def walk(run: Column, start: Column) -> Column:
        return F.aggregate(run, F.struct(start.alias("at"), empty.alias("found")), step, lambda acc: acc["found"])

    def spans(parts: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(parts))).cast("int"))
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / width).cast("int")), lambda k: F.slice(parts, k * width + 1, width))
        return _bound(runs, walked)

    def walked(runs: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        sums = F.transform(runs, lambda run: F.aggregate(run, zero, lambda n, part: n + part["gap"] + part["hit"]))
        starts = F.aggregate(sums, F.array(zero), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), starts.alias("start")), lambda x: F.when(x["run"].isNull(), empty).otherwise(walk(x["run"], x["start"]))))

    return F.when(text.rlike(pattern), _bound(parts, spans)).otherwise(empty)


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_spans(text: Column, rules=RULES) -> Column:
    """All spans of a text, ordered by start and then by rule."""
    return F.array_sort(F.concat(*[_spans(text, kind, k, *rest) for k, (kind, *rest) in enumerate(rules)]))


class BlobLedger:
    """(blob, rule_version, spans) below a folder; each scan adds a table of what was unseen.  Opened again at the same path
    it knows what was scanned before."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_path(spark, "ledger")

    def scans(self) -> list[str]:
        """Folders of the scans that were completed."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [status.getPath().toString() for status in files.listStatus(root)]
        return sorted(at for at in found if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")))

    def rows(self) -> DataFrame:
        schema, scans = f"blob binary, rule_version string, spans array<{_SPAN}>", self.scans()
        if not scans:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*scans)

    def scan(self, versions: DataFrame, rule_version: str = RULE_VERSION, rules=RULES) -> DataFrame:
        """versions: doc_id, text.  Returns doc_id, blob, spans for each of its rows."""
        paths = versions.select("doc_id", text_or_empty().alias("text")).select("*", once(F.unhex(F.sha2("text", 256)), "blob"))
        heads = materialize(paths.select("doc_id", "blob"), "heads")
        copies = heads.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).withColumn("new", F.lit(True))
        if self.scans():
            seen = self.rows().where(F.col("rule_version") == rule_version).select("blob", F.lit(True).alias("seen")).dropDuplicates(["blob"])
            copies = copies.join(seen, "blob", "left").withColumn("new", F.col("seen").isNull())
        copies = materialize(copies.select("blob", "doc_id", "new", (F.col("n") > 1).alias("copied")), "copies")
        known = materialize(copies.where("copied or not new").select("blob"), "known")
        flagged = marked(paths, known, "blob", "maybe")
        carriers = marked(copies.where("new"), known, "blob", "maybe").where("maybe").select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob"))
        one = flagged.doc_id.eqNullSafe(F.col("__id")) & (flagged.blob == F.col("__blob"))
        carried = flagged.where("maybe").join(carriers, one, "left_semi")
        fresh = flagged.where("not maybe").select("blob", "text").union(carried.select("blob", "text"))
        found = fresh.select("blob", F.lit(rule_version).alias("rule_version"), find_spans(F.col("text"), rules).alias("spans"))
        found.write.option("compression", "zstd").parquet(f"{self.path}/scan-{uuid.uuid4().hex}")
        hits = self.rows().where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
        hits = materialize(hits, "hits")  # else the join lies on the grouping's partitions, which can't be split
        return heads.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("spans"))


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.  Documents go through the ledger in
    batches, by a hash of doc_id."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    scanned = [ledger.scan(docs.where(turn == k).select("doc_id", "text")) for k in range(batches)]
    found = functools.reduce(DataFrame.union, scanned)
    label = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r[0]) for r in RULES], F.sha2(label, 256).alias("base_sha256"), label.alias("spans"))


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start_at, s + length(hit) AS end_at FROM (
  SELECT doc_id, hits[i] AS hit, vals[i] AS val,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals,
           string_split_regex(t, '{p}') AS gaps
    FROM d {"WHERE regexp_matches(t, '[0-9a-f]{16}')" if kind == "hex" else ""}))) WHERE length(val) >= {least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = _oracle()
