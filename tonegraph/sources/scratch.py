"""Tables in the folder that all executors share: where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 1 << 14
_own_folder: str | None = None
_used: set[str] = set()
_thread = threading.local()  # paths: what this thread has been given and not removed, in order


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or (local runs only) a temporary one."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tonegraph-")
    return _own_folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner sweeps it
        pass


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's part of the shared folder, removed when Python ends."""
    root = f"{shared_folder(spark).rstrip('/')}/tonegraph-{spark.sparkContext.applicationId}"
    if root not in _used:
        _used.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _given().append(path)
    return path


def _given() -> list[str]:
    return _thread.__dict__.setdefault("paths", [])


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and what was
    non-deterministic (row ids, partition ids) is fixed even if executors are lost later."""
    path = work_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a written table; the tables that make wrote on its way are removed once that is whole, so nothing
    else may read them.  Until then they stay, so a lost executor's tasks can be run again."""
    given = _given()
    mark = len(given)
    df = materialize(make(), name)
    for path in given[mark:-1]:
        _remove(spark, path)
    del given[mark:-1]
    return df


def bucket_count(df: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """A bucket for each `rows` rows of df, at least as many as there are cores and at most MOST_BUCKETS."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_BUCKETS, -(-df.count() // rows)))


def bucketed(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """df as a table dealt over buckets by keys and sorted in each, in the shared folder: groupings, windows and joins on keys read it
    without an exchange.  The table is the session's own (a random name) and goes with its folder when Python ends."""
    spark = df.sparkSession
    table = f"tonegraph_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    placed = df.repartition(buckets, *keys)  # a task for each bucket, so that each is one file
    placed.write.option("path", work_path(spark, name)).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(table, format="parquet", compression="zstd")
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session is gone, and its catalog with it
        pass
