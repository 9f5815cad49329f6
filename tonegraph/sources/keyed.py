"""A table with one row for each key, in buckets by key: an append reads and rewrites only the buckets that get rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bucket_count, materialize

_BUCKET = "__bucket"


class KeyedTable:
    """Rows below a folder: data/<write>/__bucket=<n>/ and manifest-<version>, a JSON text that names the write which holds each bucket.

    A version is whole once its manifest is there, which is renamed into place after all rows; what a broken write leaves
    behind is in no manifest, and readers keep the version they opened.  One writer at a time: of two that commit the same
    version the second fails.  Keys may be null (equal to one another); the columns of a later append may stand in any order.
    The number of buckets is set when the table is made (a bucket for each two million rows, at least one for each core)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """version, buckets (their number), schema and where: the write that holds each bucket which has rows."""
        files, root = self._files(), self._path("")
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        versions = [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")]
        if not versions:
            return None
        source = files.open(self._path(f"manifest-{max(versions)}"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def _commit(self, manifest: dict) -> None:
        files = self._files()
        draft, place = self._path(f"_draft-{uuid.uuid4().hex}"), self._path(f"manifest-{manifest['version']}")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} has been written by another")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """rows (with their bucket) written; the name of the write and its buckets."""
        name = uuid.uuid4().hex[:12]
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        found = self._files().listStatus(self._path(f"data/{name}"))
        folders = [s.getPath().getName() for s in found]
        return name, [int(f.split("=")[1]) for f in folders if f.startswith(f"{_BUCKET}=")]

    def _placed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.dropDuplicates(self.keys).withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        held = {int(b): w for b, w in manifest["where"].items()}
        paths = [f"{self.path}/data/{held[b]}/{_BUCKET}={b}" for b in (held if buckets is None else buckets) if b in held]
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The last whole version."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(self.path)
        return self._read(manifest)

    def append(self, df: DataFrame) -> list[int]:
        """Add the rows of df whose key is not there yet; of rows of df with one key any one.  Returns the buckets that were written.

        The first append makes the table.  Buckets that df has keys of are read, by their keys alone; those that get rows are
        rewritten; if no key is new nothing is written and the version stays."""
        old = self.manifest()
        if old is None:
            buckets = bucket_count(df)
            name, written = self._write(self._placed(df, buckets))
            self._commit({"version": 1, "buckets": buckets, "schema": df.schema.jsonValue(), "where": {b: name for b in written}})
            return sorted(written)
        placed = materialize(self._placed(df.select(*self._read(old, []).columns), old["buckets"]), "appended")
        met = [r[0] for r in placed.select(_BUCKET).distinct().collect()]  # at most the number of buckets
        known = self._read(old, met).select(*[F.col(k).alias(f"__old_{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__old_{k}"))
        fresh = materialize(placed.join(known, same, "left_anti"), "fresh")
        gaining = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())
        if not gaining:
            return []
        kept = self._read(old, gaining)
        kept = kept.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(old["buckets"])).cast("int"))
        name, written = self._write(kept.unionByName(fresh))
        self._commit(old | {"version": old["version"] + 1, "where": old["where"] | {str(b): name for b in written}})
        return sorted(written)

    def vacuum(self) -> int:
        """Remove writes that the last manifest doesn't name, and older manifests; returns how many writes went.
        For when no reader has an older version open and no append is running."""
        manifest, files = self.manifest(), self._files()
        named = set((manifest or {"where": {}})["where"].values())
        data = self._path("data")
        writes = [s.getPath() for s in files.listStatus(data)] if files.exists(data) else []
        gone = [p for p in writes if p.getName() not in named]
        for p in gone:
            files.delete(p, True)
        for s in files.listStatus(self._path("")) if manifest else []:
            n = s.getPath().getName()
            if n.startswith("_draft-") or (n.startswith("manifest-") and int(n.removeprefix("manifest-")) < manifest["version"]):
                files.delete(s.getPath(), False)
        return len(gone)
