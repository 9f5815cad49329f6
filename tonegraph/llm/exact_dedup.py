"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

* **Memtable flush.**  Rows come to the index as (digest, identifier) heads.  A memtable holds the heads of a share of the
  input's tasks, of about MEMTABLE_ROWS rows; it is flushed as one run: an entry for each digest with the smallest
  identifier under (longest original first, then smallest doc_id) and the number of rows, sorted by digest, and a filter (a
  bitmap of bounded size) beside it.  Map-side combine keeps one entry a digest and task, so a digest with a third of
  all rows costs no more than any other.
* **Compaction.**  FANOUT runs of a level merge into one of the next: by digest the smallest identifier stays and row
  numbers add up.  The runs that count are named by the last manifest that was written whole.
* **Lookup.**  A digest is sought in the runs whose filter doesn't rule it out; rows that all filters clear never move.
* **Byte verification.**  A hit counts only after its normalised text is compared byte for byte with
  that of the row that stays.  A bitmap over the digests that occur more than once
  keeps the texts of all other documents out of that shuffle; texts of rows
  that stay are dealt over salts in proportion to their group, so a large group spreads over many
  tasks.  Digests with a mismatch are regrouped by whole normalised text.

`exact_dedup` takes its groups from such an index over its table; `dedup_batch` holds a new batch against an index of
earlier ones and then adds it.

Defined edge cases: null text is the empty text, and empty texts are equal to one another and to
texts of white space only; a null doc_id sorts last; repeated rows are members like any other and
exactly one row of a group is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, settled, text_or_empty, with_row_ids, work_path
from .membership import bitmap, bits_for, marked, once, probed, without

#: Rows of a group that are verified against one copy of the text that stays.
ROWS_PER_SALT = 256
#: Runs of a level that are merged, memtables that a table is flushed in at least, and rows of a memtable.
FANOUT = 4
MEMTABLE_ROWS = 1 << 28
#: An entry of the index: what orders identifiers, and the rows merged into it.
_ENTRY = "struct<shortness:bigint,unnamed:boolean,keep_id:bigint,keep_row:bigint>"


def normalised(text: Column) -> Column:
    """Without every blank and U+0009 to U+000D."""
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def sha256_digest(normal: Column) -> Column:
    return F.unhex(F.sha2(normal, 256))


def _keyed(docs: DataFrame, digest, carry=()) -> DataFrame:
    text = text_or_empty()
    rows = docs.select(*carry, "doc_id", F.length(text).cast("long").alias("n"), once(normalised(text), "normal"))
    return rows.select("*", once(digest(F.col("normal")), "digest"))


def heads(docs: DataFrame, digest=sha256_digest, carry=()) -> DataFrame:
    """What the index sees of each row, fixed in a written table: row_id, doc_id, n, digest, sha."""
    rows = _keyed(docs, digest, carry).select(
        *carry,
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "n",
        "digest",
        (F.col("digest") if digest is sha256_digest else sha256_digest(F.col("normal"))).alias("sha"),
    )
    return materialize(rows, "heads")


def _entry() -> Column:
    return F.struct(
        (-F.col("n")).alias("shortness"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row")
    )


class MergeIndex:
    """Runs of (digest, entry, rows) in levels below a folder.  A run or a merger counts once a manifest names it, so a
    flush that failed leaves nothing behind; an index that is opened again goes on from its last manifest."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_path(spark, "index")

    def runs(self) -> list:
        """level, path, filter, bits of the runs that count, from the last whole manifest."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
        manifests = sorted(p.toString() for p in found if p.getName().startswith("manifest-") and files.exists(path(f"{p.toString()}/_SUCCESS")))
        return self.spark.read.parquet(manifests[-1]).orderBy("level", "path").collect() if manifests else []

    def _commit(self, runs: list[tuple], turn: int) -> None:
        frame = self.spark.createDataFrame(runs, "turn long, level int, path string, filter string, bits long")
        frame.coalesce(1).write.parquet(f"{self.path}/manifest-{turn:012d}")

    def _turn(self, runs: list) -> int:
        return max((r["turn"] for r in runs), default=0) + 1

    def _write(self, entries: DataFrame, tables: int) -> list[tuple[str, str, int]]:
        """Write entries (table, digest, entry, rows) as one sorted run a table, each with its filter."""
        at = f"{self.path}/runs-{uuid.uuid4().hex}"
        entries.sortWithinPartitions("table", "digest").write.partitionBy("table").option("compression", "zstd").parquet(at)
        written = self.spark.read.schema(f"digest binary, entry {_ENTRY}, rows long, table int").parquet(at)
        sizes = {r["table"]: r["count"] for r in written.groupBy("table").count().collect()}  # a row for each memtable
        bits = bits_for(max(sizes.values(), default=0))
        bitmap(written, "digest", bits, "table").write.partitionBy("table").option("compression", "zstd").parquet(f"{at}-filters")
        return [(f"{at}/table={k}", f"{at}-filters/table={k}", bits) for k in sorted(sizes)]

    def add(self, rows: DataFrame) -> None:
        """Flush row_id, doc_id, n, digest (a written table: it is counted) as sorted runs and merge levels that are full."""
        memtables = max(FANOUT, -(-rows.count() // MEMTABLE_ROWS))
        task = F.shiftright("row_id", 33)  # rows of a task lie together in monotonic numbers
        dealt = rows.withColumn("table", F.pmod(task, F.lit(memtables)).cast("int"))
        flushed = dealt.groupBy("table", "digest").agg(F.min(_entry()).alias("entry"), F.count(F.lit(1)).alias("rows"))
        before = self.runs()
        turn = self._turn(before)
        kept = [(turn, r["level"], r["path"], r["filter"], r["bits"]) for r in before]
        self._commit(kept + [(turn, 0, *run) for run in self._write(flushed, memtables)], turn)
        self.compact()

    def compact(self) -> None:
        """Merge FANOUT runs of a level into one of the next until no level is full."""
        while True:
            runs = self.runs()
            full = [level for level in {r["level"] for r in runs} if sum(r["level"] == level for r in runs) >= FANOUT]
            if not full:
                return
            level, turn = min(full), self._turn(runs)
            merged = [r for r in runs if r["level"] == level][:FANOUT]
            kept = [(turn, r["level"], r["path"], r["filter"], r["bits"]) for r in runs if r not in merged]
            one = self._merge(merged).withColumn("table", F.lit(0))
            self._commit(kept + [(turn, level + 1, *run) for run in self._write(one, 1)], turn)

    def _read(self, runs: list) -> DataFrame:
        schema = f"digest binary, entry {_ENTRY}, rows long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r["path"] for r in runs])

    def _merge(self, runs: list) -> DataFrame:
        held = self._read(runs)
        return held if len(runs) < 2 else held.groupBy("digest").agg(F.min("entry").alias("entry"), F.sum("rows").alias("rows"))

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_row, keep_n, group_size over all runs."""
        return self._merge(self.runs()).select("digest", "entry.keep_id", "entry.keep_row", (-F.col("entry.shortness")).alias("keep_n"), F.col("rows").alias("group_size"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Those of rows whose digest is in the index, with its entry.  Only rows that a run's filter lets through are joined
        with that run."""
        found = None
        for run in self.runs():
            bitmaps = self.spark.read.schema("__bucket int, __bits binary").parquet(run["filter"])
            maybe = probed(rows, bitmaps, run["bits"], "digest", "__maybe").where("__maybe").drop("__maybe")
            part = maybe.join(self._read([run]), "digest")
            found = part if found is None else found.union(part)
        if found is None:
            return rows.join(self.entries(), "digest")
        first = found.groupBy(*rows.columns).agg(F.min("entry").alias("entry"), F.sum("rows").alias("group_size"))
        return first.select(*rows.columns, "entry.keep_id", "entry.keep_row", (-F.col("entry.shortness")).alias("keep_n"), "group_size")


def compact(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key the entry that stays and the number of rows."""
    merged = rows.groupBy(*keys).agg(F.min(_entry()).alias("e"), F.count(F.lit(1)).alias("group_size"))
    return merged.select(*keys, "e.keep_id", "e.keep_row", (-F.col("e.shortness")).alias("keep_n"), "group_size")


def mismatches(docs: DataFrame, index: DataFrame, digest=sha256_digest) -> DataFrame:
    """Digests under which some document's normalised text differs from that of the one that stays."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("group_size") / ROWS_PER_SALT)).cast("int")
    entry = index.select("digest", "keep_id", "keep_n", salts.alias("salts"))
    candidates = materialize(marked(_keyed(docs, digest), index, "digest", "maybe").where("maybe").drop("maybe").join(entry, "digest"), "candidates")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    kept = (
        candidates.where(stays)
        .groupBy("digest", "salts")
        .agg(F.first("normal").alias("kept_normal"))
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "kept_normal")
    )
    # Every row is compared, those that look like the one that stays as well: ids may repeat.
    hits = candidates.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"))
    return hits.join(kept, ["digest", "salt"]).where(F.col("normal") != F.col("kept_normal")).select("digest").distinct()


def exact_dedup(docs: DataFrame, digest=sha256_digest, carry=()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns in carry."""
    rows = heads(docs, digest, carry)
    merged = MergeIndex(docs.sparkSession)
    merged.add(rows)
    index = materialize(merged.entries().where("group_size > 1"), "index")
    odd = materialize(mismatches(docs, index, digest), "odd")
    grouped = rows.select(*carry, "row_id", "doc_id", "digest", "sha")
    if odd.isEmpty():
        joined = grouped.join(index, "digest", "left")
    else:
        whole = _keyed(docs, digest, carry).join(odd, "digest", "left_semi")
        whole = materialize(whole.withColumn("row_id", F.monotonically_increasing_id()), "collided")
        exact = compact(whole, "digest", "normal")
        again = whole.select(*carry, "row_id", "doc_id", "digest", "normal", sha256_digest(F.col("normal")).alias("sha")).join(exact, ["digest", "normal"], "left")
        usual = grouped.join(odd, "digest", "left_anti").join(index, "digest", "left")
        columns = [*carry, "row_id", "doc_id", "sha", "keep_id", "keep_row", "group_size"]
        joined = usual.select(columns).union(again.select(columns))
    found = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *carry,
    )


def dedup_batch(docs: DataFrame, row: str, index: MergeIndex, stored: DataFrame, digest=sha256_digest) -> DataFrame:
    """row, repeats: for each of docs (named by its column `row`, a number of its own over all batches) the row of an
    earlier batch with the same text, or null.  Then adds docs to the index.  stored: row, text of the earlier batches.

    A digest's later texts that differ from the one in the index repeat nothing, as byte verification tells."""
    rows = _keyed(docs, digest, (row,)).select(F.col(row).alias("row_id"), "doc_id", "n", "digest")
    rows = materialize(rows, "batch")
    pairs = materialize(index.lookup(rows).select("row_id", "keep_row"), "hits")
    shared = pairs.groupBy("keep_row").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("long").alias("salts"))
    shared = materialize(shared, "shared")
    normal = lambda df, name: df.select(F.col(row).alias(name), normalised(text_or_empty()).alias(f"{name}_text"))
    old = marked(normal(stored, "keep_row"), shared, "keep_row", "__maybe").where("__maybe").drop("__maybe").join(shared, "keep_row")
    old = old.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    new = pairs.join(shared, "keep_row").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts"))).drop("salts").join(normal(docs, "row_id"), "row_id")
    same = new.join(old, ["keep_row", "salt"]).where(F.col("row_id_text") == F.col("keep_row_text")).select("row_id", F.col("keep_row").alias("repeats"))
    found = materialize(rows.select("row_id").join(same, "row_id", "left").withColumnRenamed("row_id", row), "repeats")
    index.add(rows)
    return found


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops: null and empty texts and texts of white space are equal; of ties (a null doc_id
    is last) and repeated rows one stays; an empty table stays empty; all columns are kept, whatever their names."""
    rows, row = with_row_ids(docs)
    gone = settled(docs.sparkSession, "gone", lambda: exact_dedup(rows, carry=(row,)).where("not kept").select(row))
    return without(rows, gone, row).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
  FROM documents),
r AS (
  SELECT doc_id, normal,
         first_value(doc_id) OVER (PARTITION BY normal ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY normal) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM r
"""
