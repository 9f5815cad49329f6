"""Exact nearest vectors by blocks around pivots, most of which the triangle inequality rules out.

Every vector lies in the cell of its nearest pivot, and a cell is cut by distance to the pivot into rings of at most `block` vectors.
Of a block only the pivot, the least and the largest distance and the largest norm are looked at first.  For a
query at distance d from the pivot, each vector x of a ring [low, high] is at least g = max(d - high, low - d, 0) away, so that its
inner product with the query is at most (|q|^2 + |x|^2 - g^2) / 2.  A block whose bound is below a query's k-th best so far
is left out.

Blocks that stand side by side are one row of a written table, a chunk: a matrix of at most CHUNK_BYTES.  Queries are chunks of
the same kind, and where the corpus itself asks they are its own.  A task reads one chunk of queries and a stripe of the corpus' chunks,
one after another, from the table, so that no vector is copied for a query or a block: an exchange moves the vectors once when the index is
made, other queries once, and k rows for each query and stripe.  The more chunks there are the fewer the stripes, down to one.
The worst case, where no bound rules out anything, is the work of comparing all with all, with the same memory."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .knn import BLOCK, CELLS, EDGE, STEP, Best, in_single, rank, rounding, vectors_of

#: Bytes of all pivots, and number of all blocks, at most; blocks grow beyond it.
PIVOT_BYTES, MOST_BLOCKS = 8 << 20, 1 << 20
#: Bytes of a chunk's vectors, at most.
CHUNK_BYTES = 16 << 20
#: Blocks of a chunk that queries take before the others, and rows beside a query among which it looks for a first k-th best.
FIRST, BESIDE = 4, 256
#: Rows of a piece, on the average, from which on pieces of a chunk are read where they lie.
PIECE = 1024
#: Share of the squared norms by which a bound may be off through rounding.
ROUNDING = 1e-6

CHUNK = "chunk long, ids binary, vectors binary, rings array<struct<block: long, start: int, cell: long, low: double, high: double, sq: double>>"
#: A chunk is a page and a row of its own: the writer holds no more than one.
ONE_BY_ONE = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


@dataclass
class Report:
    """Pairs of a query and a block, how many of them were compared, and in how many rounds."""

    pairs: int = 0
    searched: int = 0
    rounds: int = 0

    @property
    def skipped_share(self) -> float:
        return 1 - self.searched / self.pairs if self.pairs else 0.0


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def bounds(queries: np.ndarray, pivots: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """Upper bound of a query's inner product with any vector of each block.  rings: cell, low, high, largest squared norm."""
    own = (queries**2).sum(1)[:, None]
    cells, at = np.unique(rings[:, 0].astype("i8"), return_inverse=True)
    away = _distances(queries, pivots[cells])[:, at]
    gap = np.maximum(np.maximum(away - rings[:, 2], rings[:, 1] - away), 0.0)
    most = np.minimum((own + rings[:, 3] - gap**2) / 2, np.sqrt(own * rings[:, 3]))
    return most + ROUNDING * (own + rings[:, 3])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch that is not empty."""
    return batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)


def _place(pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, embedding, cell, far."""
    for batch in batches:
        if batch.num_rows:
            x, cell, far = _matrix(batch), [], []
            step = max(1, 4 * CELLS // max(len(pivots.value), x.shape[1]))
            for s in range(0, len(x), step):
                away = _distances(x[s : s + step], pivots.value)
                cell.append(away.argmin(1))
                far.append(away[np.arange(len(away)), cell[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(np.concatenate(cell)), pa.array(np.concatenate(far))], ["id", "embedding", "cell", "far"])


def _pack(block: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A CHUNK for every `most` rows; a new block where the cell changes or the block is full.  Rows come in order of cell and far."""
    made, named, held, parts = 0, 0, 0, []
    base = TaskContext.get().partitionId() << 32
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("rings", pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("sq", pa.float64())])))])

    def chunk() -> pa.RecordBatch:
        nonlocal made, named
        ids, x, cell, far = (np.concatenate(column) for column in zip(*parts, strict=True))
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        starts = np.concatenate([np.arange(a, b, block) for a, b in zip(first, np.r_[first[1:], len(cell)], strict=True)])
        names = base + named + np.arange(len(starts))
        low, high, sq = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts), np.maximum.reduceat((x**2).sum(1), starts)
        rings = [dict(zip(("block", "start", "cell", "low", "high", "sq"), r, strict=True)) for r in zip(names.tolist(), starts.tolist(), cell[starts].tolist(), low.tolist(), high.tolist(), sq.tolist(), strict=True)]
        row = [[base + made], [ids.astype("i8").tobytes()], [np.ascontiguousarray(x, "f8").tobytes()], [rings]]
        made, named = made + 1, named + len(starts)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, most - held)
            parts.append((piece.column("id").to_numpy(), _matrix(piece), piece.column("cell").to_numpy(), piece.column("far").to_numpy()))
            at, held = at + piece.num_rows, held + piece.num_rows
            if held == most:
                yield chunk()
                held, parts = 0, []
    if parts:
        yield chunk()


class _Chunk:
    """A row of CHUNK as arrays; ids and vectors are not copied."""

    def __init__(self, ids: pa.Scalar, vectors: pa.Scalar, rings: pa.Scalar):
        self.ids = np.frombuffer(ids.as_buffer(), "i8")
        self.x = np.frombuffer(vectors.as_buffer(), "f8").reshape(len(self.ids), -1)
        held = rings.values
        self.names, self.starts = (held.field(c).to_numpy().astype("i8") for c in ("block", "start"))
        self.rings = np.stack([held.field(c).to_numpy().astype("f8") for c in ("cell", "low", "high", "sq")], axis=1)
        self.ends = np.r_[self.starts[1:], len(self.ids)]
        self.norm = math.sqrt(self.rings[:, 3].max())

    @functools.cached_property
    def single(self) -> np.ndarray | None:
        return in_single(self.x, self.norm)


class _Asking(Best):
    """The k best so far of each query of a chunk."""

    def __init__(self, queries: _Chunk, k: int, block: int, own: bool):
        """own: queries are vectors of the corpus, so what stands beside a query has a k-th best that a search can't fall below."""
        super().__init__(queries.ids, queries.x, k)
        self.searched, self.step = 0, min(STEP, block)
        for s in range(0, len(self.ids), self.step) if own else ():
            e = min(len(self.ids), s + self.step)
            a, b = np.searchsorted(queries.starts, (s, e - 1), "right") - 1
            low, high = max(queries.starts[a], s - BESIDE), min(queries.ends[b], e + BESIDE)
            near = self.x[s:e] @ self.x[low:high].T
            near[self.ids[s:e, None] == self.ids[None, low:high]] = -np.inf
            if near.shape[1] >= k:
                self.least[s:e] = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - rounding(self.x[s:e], queries.norm)

    def compare(self, corpus: _Chunk, pivots: np.ndarray) -> None:
        for s in range(0, len(self.ids), self.step):
            e = min(len(self.ids), s + self.step)
            bound = bounds(self.x[s:e], pivots, corpus.rings)
            order = np.argsort(-bound.max(0), kind="stable")
            for blocks in (order[:FIRST], order[FIRST:]):
                blocks = np.sort(blocks[(bound[:, blocks] >= self.least[s:e, None]).any(0)])
                if len(blocks):
                    self.searched += (e - s) * len(blocks)
                    self._compare(s, e, corpus, blocks)

    def _compare(self, s: int, e: int, corpus: _Chunk, blocks: np.ndarray) -> None:
        """Blocks side by side are one piece, read where it lies; where pieces are short they are brought together first."""
        first = np.flatnonzero(np.r_[True, np.diff(blocks) > 1])
        starts, ends = corpus.starts[blocks[first]], corpus.ends[blocks[np.r_[first[1:], len(blocks)] - 1]]
        if (ends - starts).sum() < PIECE * len(starts) and len(starts) > 1:
            rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
            self.take(s, e, corpus.ids[rows], corpus.x[rows], None if corpus.single is None else corpus.single[rows], corpus.norm)
            return
        for a, b in zip(starts, ends, strict=True):
            self.take(s, e, corpus.ids[a:b], corpus.x[a:b], None if corpus.single is None else corpus.single[a:b], corpus.norm)


def _search(pivots, k: int, block: int, own: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, score and, in one row of each chunk of queries, the pairs of a query and a block that were compared."""
    best: dict[int, _Asking] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(name)[i]  # noqa: E731, B023
            name = cell("q_chunk").as_py()
            if name not in best:  # the task's queries stay as long as it reads the corpus
                best[name] = _Asking(_Chunk(pa.scalar(cell("q_ids").as_py()), pa.scalar(cell("q_vectors").as_py()), cell("q_rings")), k, block, own)
            best[name].compare(_Chunk(cell("ids"), cell("vectors"), cell("rings")), pivots.value)
    for b in best.values():
        src, dst, score = b.rows()
        searched = np.zeros(len(src), "i8")
        searched[:1] = b.searched
        for s in range(0, len(src), CELLS // 2):
            yield pa.RecordBatch.from_arrays([pa.array(column[s : s + CELLS // 2]) for column in (src, dst, score, searched)], ["src", "dst", "score", "searched"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, embedding, block of the vectors in chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = _Chunk(batch.column("ids")[i], batch.column("vectors")[i], batch.column("rings")[i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.x.size + 1, c.x.shape[1]), pa.int32()), pa.array(c.x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c.ids), lists, pa.array(np.repeat(c.names, c.ends - c.starts))], ["id", "embedding", "block"])


class MetricIndex:
    """The blocks of a corpus (id, embedding)."""

    def __init__(self, corpus: DataFrame, block: int = BLOCK, pivot_bytes: int = PIVOT_BYTES, count: int | None = None, chunk_bytes: int = CHUNK_BYTES):
        self.source, self.spark = corpus, corpus.sparkSession
        corpus = self._vectors(corpus)
        n = corpus.count() if count is None else count
        width = (corpus.agg(F.max(F.size("embedding"))).first()[0] or 1) * 8
        self.most = max(1, chunk_bytes // width)
        self.block = max(min(block, self.most), math.ceil(n / MOST_BLOCKS))
        wanted = max(1, min(math.ceil(n / self.block), pivot_bytes // width))
        drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()  # of a checked size
        self.pivots = self.spark.sparkContext.broadcast(vectors_of(drawn)[1])
        self.chunks = self._packed(corpus, n)
        found = self.chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rings")).alias("blocks")).first()
        self.n_chunks, self.n_blocks = found["n"], found["blocks"] or 0

    @staticmethod
    def _vectors(table: DataFrame) -> DataFrame:
        return table.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def _packed(self, vectors: DataFrame, n: int) -> DataFrame:
        """Vectors as a table of chunks: as many as keep all cores busy when each meets each, and more where memory asks for it."""
        even = math.ceil(n / math.ceil(math.sqrt(3 * self.spark.sparkContext.defaultParallelism)))
        rows = min(max(1, 3 * self.most // 4), max(even, min(8 * self.block, BLOCK)))
        order = ["cell", "far", "id"]
        placed = vectors.mapInArrow(functools.partial(_place, self.pivots), "id long, embedding array<double>, cell long, far double")
        dealt = placed.repartitionByRange(max(1, math.ceil(n / rows)), *order).sortWithinPartitions(*order)
        return materialize(dealt.mapInArrow(functools.partial(_pack, self.block, self.most), CHUNK), "chunks", **ONE_BY_ONE)

    @property
    def blocks(self) -> DataFrame:
        """id, embedding, block of all vectors."""
        return self.chunks.mapInArrow(_rows, "id long, embedding array<double>, block long")

    @functools.cached_property
    def rings(self):
        """Names of all blocks, and cell, least and largest distance, and largest squared norm of each, as a broadcast."""
        rings = self.chunks.select(F.inline("rings")).orderBy("block").toPandas()  # a row for each block
        return self.spark.sparkContext.broadcast((rings["block"].to_numpy("i8"), rings[["cell", "low", "high", "sq"]].to_numpy("f8")))

    def search(self, queries: DataFrame, k: int, report: Report | None = None) -> DataFrame:
        """src, dst, score, rank: the k vectors with the largest inner product for each query (id, embedding), never itself."""
        if not self.n_chunks:
            return rank(self.spark.createDataFrame([], EDGE), k)
        own, asking = queries is self.source, self.chunks
        if not own:
            queries = self._vectors(queries)
            asking = self._packed(queries, queries.count())
        n_asking = self.n_chunks if own else asking.count()
        if not n_asking:
            return rank(self.spark.createDataFrame([], EDGE), k)
        stripes = min(self.n_chunks, math.ceil(6 * self.spark.sparkContext.defaultParallelism / n_asking))
        asking = asking.select([F.col(c).alias(f"q_{c}") for c in asking.columns]).coalesce(n_asking)
        crossed = self.chunks.coalesce(stripes).crossJoin(asking.hint("shuffle_replicate_nl"))
        found = crossed.mapInArrow(functools.partial(_search, self.pivots, k, self.block, own), f"{EDGE}, searched long")
        found = materialize(found, "edges")
        if report is not None:
            n = asking.agg(F.sum(F.length("q_ids") / 8)).first()[0]
            report.pairs, report.searched, report.rounds = int(n) * self.n_blocks, found.agg(F.sum("searched")).first()[0] or 0, 1
        return rank(found.select("src", "dst", "score"), k)
