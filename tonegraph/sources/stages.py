"""Stages of a batch build: a table is read again only if it was made from what it would be made from now."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import write_parquet

#: A file beside the rows; Spark's readers pass over names with an underscore.
MANIFEST = "_made_from"


def made_from(**parts) -> str:
    """A digest of what a stage depends on: parameters and the digests of its inputs."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def rows_digest(df: DataFrame) -> str:
    """A digest of df's schema and rows, whatever their order: one reading, one row out, nothing is shuffled but partial sums.
    Repeated rows count; a column that can't be hashed (a map within) counts by its JSON text."""
    columns = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    place = lambda seed: F.xxhash64(F.lit(seed), *columns)
    total = df.select(place(1).alias("a"), place(2).alias("b")).agg(
        F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor("b")
    )
    return made_from(schema=df.dtypes, rows=[str(v) for v in total.first()])


class Stages:
    """Tables below a folder, each with a manifest that holds the digest of what it was made from.

    get builds a stage if its table is missing, unfinished or made from anything else, and reads it otherwise.
    The manifest is written after the rows, so a build that breaks off leaves a stale stage and not a wrong one."""

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.folder, self.force = spark, folder.rstrip("/"), force
        #: Names of the stages that were built by this object, in order.
        self.built: list[str] = []

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{MANIFEST}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> str | None:
        """The digest that a finished stage was made from."""
        path, files = self._file(name)
        if not files.exists(path):
            return None
        source = files.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def get(self, name: str, digest: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.force or self.manifest(name) != digest:
            write_parquet(make(), path)  # the old table and its manifest go first
            target, files = self._file(name)
            out = files.create(target, True)
            try:
                out.write(bytearray(digest.encode()))
            finally:
                out.close()
            self.built.append(name)
        return self.spark.read.parquet(path)
