"""Array files (npy, npz) as a data source: rows of arrays, one for each index of the first dimension.

spark.read.format("arrays") plans tasks by file sizes alone: small files are packed together, and of a large file each of k tasks takes
the k-th part of the rows of every array in it, so no task loads a file and the driver opens none.  A filter on `member` (an array's name
in an npz file, null for npy) leaves the other arrays unread.  df.write.format("arrays") writes npy files of about blockBytes each, which
appear together when the job commits.

Rows: path, member, row (index of the first dimension), shape (the other dimensions), values (one row, last dimension fastest).
Defined cases: an array without dimensions is one row; one without rows gives none; both orders and both byte orders are read; whole numbers
that a double can't hold, other kinds of arrays (objects, text, records) and broken files are errors that name the file.  A compressed member in
column order is decompressed once for each block of rows; all others are read once.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .midi import _opened, packed

#: Bytes of a block of rows in a task's memory, and of a file that is written.
BLOCK = 8 << 20


@dataclass
class Slices(InputPartition):
    """Files, and which of how many parts of each array's rows one task takes."""

    def __init__(self, paths: list[str], part: int, parts: int):
        super().__init__(None)
        self.paths, self.part, self.parts = paths, part, parts


def header(file) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether the first dimension is fastest, and type of the array that starts at the file's place."""
    version = np.lib.format.read_magic(file)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"npy version {version} is not supported")
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(file)
    if kind.kind not in "biuf" or kind.itemsize > 8:
        raise ValueError(f"arrays of type {kind} are not supported")
    return shape, by_column, kind


def _exactly(file, n: int) -> bytes:
    parts = []
    while n:
        data = file.read(n)
        if not data:
            raise ValueError("the file ends inside its array")
        parts.append(data)
        n -= len(data)
    return b"".join(parts)


def blocks(file, part: int, parts: int, most: int = BLOCK) -> Iterator[tuple[int, tuple[int, ...], np.ndarray]]:
    """(first row, shape of a row, matrix of rows) for one of the parts of an array's rows."""
    shape, by_column, kind = header(file)
    start, count, rest = file.tell(), shape[0] if shape else 1, shape[1:]
    width = math.prod(rest)
    low, high = count * part // parts, count * (part + 1) // parts
    step = max(1, most // max(1, width * kind.itemsize))
    for a in range(low, high, step):
        n = min(step, high - a)
        if by_column and len(shape) > 1:
            rows = np.empty((n, width), kind)
            for at in range(width):  # a column in file order; its place in a row has the last dimension fastest
                file.seek(start + (at * count + a) * kind.itemsize)
                place = np.ravel_multi_index(np.unravel_index(at, rest, order="F"), rest)
                rows[:, place] = np.frombuffer(_exactly(file, n * kind.itemsize), kind)
        else:
            file.seek(start + a * width * kind.itemsize)
            rows = np.frombuffer(_exactly(file, n * width * kind.itemsize), kind).reshape(n, width)
        yield a, rest, rows


def _as(rows: np.ndarray, values: str) -> np.ndarray:
    """Rows as doubles or longs; an error where that would change a number."""
    if values == "long":
        if rows.dtype.kind == "f" or (rows.dtype.kind == "u" and rows.size and rows.max() > np.iinfo(np.int64).max):
            raise ValueError(f"arrays of type {rows.dtype} don't fit into longs")
        return rows.astype(np.int64)
    if rows.dtype.kind in "iu" and rows.dtype.itemsize == 8 and rows.size and (int(rows.max()) > 1 << 53 or int(rows.min()) < -(1 << 53)):
        raise ValueError("whole numbers beyond 2^53 don't fit into doubles: read them with values=long")
    return rows.astype(np.float64)


class ArrayReader(DataSourceReader):
    """Options: values ("double" or "long"), maxPartitionBytes (128 MiB), openCostInBytes (4 MiB), blockBytes (8 MiB)."""

    def __init__(self, options):
        self.path, self.values = options["path"], options.get("values", "double")
        self.most, self.each = int(options.get("maxpartitionbytes", 128 << 20)), int(options.get("opencostinbytes", 4 << 20))
        self.block = int(options.get("blockbytes", BLOCK))
        self.members: set[str] | None = None

    def pushFilters(self, filters):
        for one in filters:
            wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None or one.attribute != ("member",):
                yield one
            else:
                self.members = wanted if self.members is None else self.members & wanted

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.path)
        target = system.get_file_info(root.rstrip("/"))
        found = [target] if target.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root.rstrip("/"), recursive=True, allow_not_found=True))
        endings = (".npz",) if self.members is not None else (".npy", ".npz")
        hidden = lambda path: any(p.startswith(("_", ".")) for p in path[len(root.rstrip("/")) :].split("/"))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(endings) and not hidden(f.path)]
        small = [(path, n) for path, n in files if n <= self.most]
        tasks = [Slices(paths, 0, 1) for paths in packed(small, self.most, self.each)]
        for path, n in files:
            if n > self.most:
                parts = -(-n // self.most)
                tasks += [Slices([path], part, parts) for part in range(parts)]
        return tasks

    def _arrays(self, path: str, file):
        """(member, file at the array's start) of the arrays of a file."""
        if path.endswith(".npy"):
            yield None, file
            return
        with zipfile.ZipFile(file) as archive:
            for name in archive.namelist():
                member = name.removesuffix(".npy")
                if name.endswith(".npy") and (self.members is None or member in self.members):
                    with archive.open(name) as array:
                        yield member, array

    def read(self, partition):
        import pyarrow as pa

        system, _ = _opened(self.path)
        for path in partition.paths if partition is not None else ():
            with system.open_input_file(path) as file:
                try:
                    for member, array in self._arrays(path, file):
                        for first, rest, rows in blocks(array, partition.part, partition.parts, self.block):
                            n, width = rows.shape
                            flat = pa.array(_as(rows, self.values).ravel())
                            lists = lambda w, inner: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), inner)  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(np.arange(first, first + n)),
                                 lists(len(rest), pa.array(list(rest) * n, pa.int64())), lists(width, flat)],
                                names=["path", "member", "row", "shape", "values"],
                            )
                except (ValueError, zipfile.BadZipFile) as broken:
                    raise ValueError(f"{path}: {broken}") from broken


@dataclass
class Written(WriterCommitMessage):
    """Files of a task that ended."""

    paths: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Options: dtype (float64), order ("C" or "F"), blockBytes.  Tasks write below a hidden folder of their attempt; the commit renames
    what the tasks that count have written, so a broken job or a repeated task leaves nothing behind among the files."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.dtype, self.order, self.block = np.dtype(options.get("dtype", "float64")), options.get("order", "C"), int(options.get("blockbytes", BLOCK))

    def _hidden(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator):
        system, root = _opened(self.path)
        task, paths = TaskContext.get(), []
        folder = f"{self._hidden(root)}/{task.taskAttemptId()}"

        def save(matrix: np.ndarray) -> None:
            if not paths:
                system.create_dir(folder)
            path = f"{folder}/part-{task.partitionId():05d}-{len(paths):06d}-{self.job}.npy"
            with system.open_output_stream(path) as file:
                np.lib.format.write_array(file, np.asarray(matrix, order=self.order), allow_pickle=False)
            paths.append(path)

        held, size = [], 0
        for batch in iterator:
            column = batch.column("values")
            if column.null_count:
                raise ValueError("a row without values can't be written")
            # Runs of rows of one length; a length that changes begins a new file.
            lengths, at = column.value_lengths().to_numpy(), 0
            for width, run in itertools.groupby(lengths.tolist()):
                n = len(list(run))
                step = max(1, self.block // max(1, width * self.dtype.itemsize))
                for a in range(at, at + n, step):
                    piece = column.slice(a, min(step, at + n - a))
                    matrix = self._exact(piece.flatten()).reshape(len(piece), width)
                    if held and (held[0].shape[1] != width or size + matrix.nbytes > self.block):
                        save(np.concatenate(held))
                        held, size = [], 0
                    held.append(matrix)
                    size += matrix.nbytes
                at += n
        if held:
            save(np.concatenate(held))
        return Written(paths)

    def _exact(self, flat) -> np.ndarray:
        if flat.null_count and self.dtype.kind != "f":
            raise ValueError("null can't be written as a whole number")
        numbers = flat.to_numpy(zero_copy_only=False)
        cast = numbers.astype(self.dtype)
        if self.dtype.kind != "f" and not np.array_equal(cast, numbers):
            raise ValueError(f"values don't fit into {self.dtype}")
        return cast

    def commit(self, messages):
        from pyarrow import fs

        system, root = _opened(self.path)
        system.create_dir(root)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith((".npy", ".npz"))] if self.overwrite else []
        for message in messages:
            for path in message.paths if message else ():
                system.move(path, f"{root}/{path.rsplit('/', 1)[1]}")
        for path in old:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*_opened(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            system.delete_dir(self._hidden(root))


class ArraySource(DataSource):
    """Format "arrays": rows of the npy and npz files below a folder."""

    @classmethod
    def name(cls):
        return "arrays"

    def schema(self):
        values = self.options.get("values", "double")
        if values not in ("double", "long"):
            raise ValueError("values must be double or long")
        return f"path string, member string, row long, shape array<long>, values array<{values}>"

    def reader(self, schema):
        return ArrayReader(self.options)

    def writer(self, schema, overwrite):
        return ArrayWriter(self.options, overwrite)


def register_arrays(spark: SparkSession) -> None:
    """Makes format "arrays" known to a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)


def read_arrays(spark: SparkSession, path: str, values: str = "double", **options) -> DataFrame:
    """Rows of a file or of all files below a folder."""
    register_arrays(spark)
    return spark.read.format("arrays").options(values=values, **options).load(path)


def write_arrays(df: DataFrame, path: str, values: str, by: str, mode: str = "append", **options) -> None:
    """The arrays of a column as rows of npy files, whose names and rows are in the order of `by`."""
    register_arrays(df.sparkSession)
    rows = df.orderBy(by).select(F.col(values).alias("values"))
    rows.write.format("arrays").options(**options).mode(mode).save(path)
