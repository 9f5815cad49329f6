"""Exact cosine neighbours.

A corpus of a checked small size goes to every task; where the queries are few, they go to every task and the corpus is read once where
it lies.  Otherwise both are compared by blocks of metric_index, a chunk of queries and a stripe of the corpus in one task, and
only the k best a query leave it; where many of the corpus' vectors are equal, its own neighbours are found among the different ones.
A Corpus is sized, sent or indexed once, whatever the number of calls."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot
from ..schemas import GROUPS
from ..sources.scratch import materialize

#: Vectors of one block, and bytes up to which the corpus is sent to every task.
BLOCK = 4096
BROADCAST_BYTES = 8 << 20
EDGE = "src long, dst long, score double"
#: Queries and numbers of one matrix within a task, and vectors it reads before it goes on to the next queries.
STEP, CELLS, ROWS = 256, 1 << 19, 1 << 15
#: Length from which vectors are not compared in single precision, whose numbers end at 1e38.
SINGLE = 1e15


def rounding(vectors: np.ndarray, norm: float) -> np.ndarray:
    """What a matrix product may be off by, for each vector, against vectors no longer than norm."""
    return vectors.shape[1] * 2.0**-50 * np.sqrt((vectors**2).sum(1)) * norm


def dots(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed in the same order: equal vectors have equal ones wherever they stand, as in a matrix product they may not."""
    step = max(1, (1 << 20) // max(1, left.shape[1]))
    return np.concatenate([np.empty(0), *[(left[row[s : s + step]] * right[col[s : s + step]]).sum(1) for s in range(0, len(row), step)]])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(1))


class Best:
    """The k best so far of each of some queries.

    Products are first taken in single precision, in pieces that a core's cache holds; what may be among the k best by that, however it was
    rounded, is scored in full.  A query is never its own neighbour; ties go by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, vectors, k
        self.length = lengths(vectors)
        self.single = vectors.astype("f4") if self.length.max(initial=0.0) < SINGLE else None
        self.score, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, "i8")
        self.least = np.full(len(ids), -np.inf)  # what the k-th best can't fall below

    def slack(self, s: int, e: int, norm: float, single: bool) -> np.ndarray:
        """What a product with a vector no longer than norm may be off by."""
        unit = 2.0**-22 if single else 2.0**-50
        return (self.x.shape[1] + 8) * (unit * self.length[s:e] * norm + (2.0**-120 * (1 + self.length[s:e] + norm) if single else 0.0))

    def take(self, s: int, e: int, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray | None, norm: float) -> None:
        """Compares queries s to e with vectors no longer than norm; single: the same vectors in single precision, if they are short enough."""
        quick = single is not None and self.single is not None
        x, y = (self.single[s:e], single) if quick else (self.x[s:e], vectors)
        slack, rows, cols = self.slack(s, e, norm, quick), [], []
        least = self.least[s:e] - slack
        wide = max(self.k + 1, CELLS // max(1, e - s))
        for a in range(0, len(y), wide):
            scores = x @ y[a : a + wide].T
            if scores.shape[1] > self.k + 1 and np.isneginf(least).any():  # one may be the query itself
                least = np.maximum(least, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1] - 2 * slack)
            at = np.flatnonzero(scores >= np.nextafter(least.astype(scores.dtype), scores.dtype.type(-np.inf))[:, None])
            if len(at):
                row, col = np.divmod(at, scores.shape[1])
                rows.append(row)
                cols.append(col + a)
        if rows:
            self._merge(s, e, np.concatenate(rows), np.concatenate(cols), ids, vectors)

    def _merge(self, s: int, e: int, row: np.ndarray, col: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = self.ids[s + row] != ids[col]
        row, col = row[other], col[other]
        score = dots(self.x[s:e], vectors, row, col)
        good = score >= self.least[s + row]
        row, col, score = row[good], col[good], score[good]
        mine = np.repeat(np.arange(e - s), self.k)
        row, score = np.r_[row, mine], np.r_[score, self.score[s:e].ravel()]
        found = np.r_[ids[col], self.id[s:e].ravel()]
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.score[s + row[kept], place[kept]], self.id[s + row[kept], place[kept]] = score[kept], found[kept]
        self.least[s:e] = np.maximum(self.least[s:e], self.score[s:e, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """src, dst, score."""
        row, place = np.nonzero(self.score > -np.inf)
        return self.ids[row], self.id[row, place], self.score[row, place]


def in_single(vectors: np.ndarray, norm: float) -> np.ndarray | None:
    """vectors, none longer than norm, in single precision, or None where they don't fit in."""
    return vectors.astype("f4") if norm < SINGLE else None


def best_of(ids: np.ndarray, vectors: np.ndarray, corpus_ids: np.ndarray, corpus: np.ndarray, k: int, best: Best | None = None) -> pd.DataFrame:
    """k best of the corpus for each query, itself left out; ties by id.  best: what an earlier part of the corpus gave, which is added to."""
    best = best or Best(ids, vectors, k)
    norm = float(lengths(corpus).max(initial=0.0))
    for c in range(0, len(corpus_ids), ROWS):
        some = corpus[c : c + ROWS]
        single = in_single(some, norm)
        for s in range(0, len(ids), STEP):
            best.take(s, min(len(ids), s + STEP), corpus_ids[c : c + ROWS], some, single, norm)
    return pd.DataFrame(dict(zip(("src", "dst", "score"), best.rows(), strict=True)))


def vectors_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return frame["id"].to_numpy("i8"), np.stack(frame["embedding"].to_numpy()).astype("f8") if len(frame) else np.empty((0, 0))


class Corpus:
    """Vectors (id, embedding) to compare with.  Its size, its broadcast and its blocks are made when first wanted and kept until close()."""

    def __init__(self, vectors: DataFrame, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES, distinct: bool = False):
        """distinct: no two vectors are known to be equal, so copies aren't looked for."""
        self.source, self.vectors, self.block, self.broadcast_bytes, self.distinct = vectors, vectors.select("id", "embedding"), block, broadcast_bytes, distinct
        self._shared = self._index = None

    @functools.cached_property
    def size(self) -> tuple[int, int]:
        """Vectors, and bytes of one."""
        row = self.vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        return row["n"], (row["d"] or 0) * 8

    def small(self) -> bool:
        return self.size[0] * self.size[1] <= self.broadcast_bytes

    @functools.cached_property
    def copies(self) -> tuple[DataFrame, DataFrame, Corpus] | None:
        """Where at most half of the vectors differ: id, first (the least id with an equal vector) of all; id, own (product with itself) of
        the first ones; and the vectors of those."""
        if self.distinct:
            return None
        keys = materialize(self.vectors.mapInArrow(_keys, "id long, key binary, own double"), "keys")
        classes = materialize(keys.groupBy("key").agg(F.min(F.struct("id", "own")).alias("c")).select("key", "c.id", "c.own"), "classes")
        n = classes.count()
        if 2 * n > self.size[0]:
            return None
        members = materialize(keys.select("id", "key").join(classes.select(F.col("id").alias("first"), "key").hint("merge"), "key").select("id", "first"), "members")
        ids = classes.select("id")
        ids = F.broadcast(ids) if n * 8 <= self.broadcast_bytes else ids.hint("merge")
        firsts = materialize(self.vectors.join(ids, "id", "left_semi"), "firsts")
        return members, classes.select("id", "own"), Corpus(firsts, self.block, self.broadcast_bytes, distinct=True)

    def _by_copies(self, k: int, report) -> DataFrame:
        """Own neighbours where many vectors are equal: the different ones are compared, and their copies take their places.

        What is among a vector's k best is a copy of its own or of one of its k best that differ (ties by the first copy's id: the first copies
        of better ones would already be k), and among the first k + 1 of those copies."""
        members, own, firsts = self.copies
        met = firsts.nearest(firsts.source, k, report).select("src", F.col("dst").alias("first"), "score")
        met = met.union(own.select("id", F.col("id").alias("first"), "own"))
        heads = members.withColumn("place", F.row_number().over(W.partitionBy("first").orderBy("id"))).where(F.col("place") <= k + 1)
        order = W.partitionBy("src").orderBy(F.desc("score"), "dst")
        each = met.join(heads.select("first", F.col("id").alias("dst")).hint("merge"), "first").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        near = each.groupBy(F.col("src").alias("first")).agg(F.array_sort(F.collect_list(F.struct("place", "dst", "score"))).alias("near"))
        found = members.join(near.hint("merge"), "first")
        others = F.slice(F.filter("near", lambda x: x["dst"] != F.col("id")), 1, k)
        return found.select(F.col("id").alias("src"), F.posexplode(others).alias("pos", "x")).select("src", "x.dst", "x.score", (F.col("pos") + 1).alias("rank"))

    def index(self):
        if self._index is None:
            from .metric_index import MetricIndex

            self._index = MetricIndex(self.vectors, self.block, count=self.size[0])
        return self._index

    def nearest(self, queries: DataFrame, k: int, report=None) -> DataFrame:
        """As nearest(); report: a metric_index.Report that tells how many blocks were compared, where blocks are."""
        if k < 1:
            raise ValueError("k must be at least 1")
        own = queries is self.source
        queries = queries.select("id", "embedding")
        context = self.vectors.sparkSession.sparkContext
        if self.small():
            if self._shared is None:
                self._shared = context.broadcast(vectors_of(self.vectors.toPandas()))  # of checked size
            return rank(queries.repartition(context.defaultParallelism).mapInPandas(functools.partial(_with_all, self._shared, k), EDGE), k)
        if queries.count() * self.size[1] <= min(self.broadcast_bytes, self.block * self.size[1]):
            wanted = context.broadcast(vectors_of(queries.toPandas()))  # of checked size
            return rank(self.vectors.mapInPandas(functools.partial(_with_few, wanted, k), EDGE), k)
        if own and self.copies is not None:
            return self._by_copies(k, report)
        return self.index().search(self.vectors if own else queries, k, report)

    def close(self) -> None:
        """Gives the broadcast back; what was planned with it can't run any more."""
        if self._shared is not None:
            self._shared.destroy()
        self._shared = self._index = None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key (the same for equal vectors alone), own (the product with itself)."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("embedding").flatten().to_numpy().astype("f8").reshape(batch.num_rows, -1) + 0.0  # one zero
            every = np.arange(len(x))
            keys = [hashlib.sha256(v).digest() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(dots(x, x, every, every))], ["id", "key", "own"])


def _with_all(shared, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch) and len(shared.value[0]):
            yield best_of(*vectors_of(batch), *shared.value, k)


def _with_few(wanted, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    best = None
    for batch in batches:
        if len(batch) and len(wanted.value[0]):
            best = best or Best(*wanted.value, k)
            found = best_of(*wanted.value, *vectors_of(batch), k, best)
    if best is not None:
        yield found


def nearest(queries: DataFrame, corpus: DataFrame | Corpus, k: int = 10, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """src, dst, score, rank: for each query (id, embedding) the k vectors of the corpus with the largest inner
    product, never itself; at most k rows, ties by dst."""
    return (corpus if isinstance(corpus, Corpus) else Corpus(corpus, block, broadcast_bytes)).nearest(queries, k)


def rank(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each src; Spark limits each window before and after the exchange."""
    order = W.partitionBy("src").orderBy(F.desc("score"), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_dots(pairs: DataFrame, grouped: DataFrame, left: str, right: str, groups=GROUPS) -> DataFrame:
    """pairs with an inner product for each feature group: dot_<group>, and norm_<group> of both sides.

    With these nine numbers any weighting's cosine is arithmetic; no vector is built again."""
    side = lambda name, mark: grouped.select(F.col("id").alias(name), *[F.col(g).alias(f"{mark}_{g}") for g in groups])
    both = pairs.join(side(left, "a"), left).join(side(right, "b"), right)
    return both.select(
        *pairs.columns,
        *[dot(F.col(f"a_{g}"), F.col(f"b_{g}")).alias(f"dot_{g}") for g in groups],
        *[dot(F.col(f"a_{g}"), F.col(f"a_{g}")).alias(f"left_{g}") for g in groups],
        *[dot(F.col(f"b_{g}"), F.col(f"b_{g}")).alias(f"right_{g}") for g in groups],
    )


def weighted_cosine(weight, groups=GROUPS, prefix: str = "") -> Column:
    """Cosine under weights from group_dots' columns; weight: group -> Column.  Zero vectors give 0."""
    total = lambda kind: sum((weight(g) * weight(g) * F.col(f"{prefix}{kind}_{g}") for g in groups), F.lit(0.0))
    return F.coalesce(F.try_divide(total("dot"), F.sqrt(total("left") * total("right"))), F.lit(0.0))
