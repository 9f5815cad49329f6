"""Bound-certified best-fit packing of documents into sequences of fixed capacity.

Documents become pieces (only those over the capacity are cut).  Pieces are dealt over tasks of about
`rows_per_task` rows so that each task gets nearly the same mix of lengths (chunks of TASKS_PER_CHUNK tasks, and inside a
chunk each band of lengths goes round in order of length), for a share that lacks short pieces wastes bins.  Each task packs its share best-fit decreasing and takes a lower bound on
its bins from dual-feasible functions.  A task at its bound is certified and gives up only its
emptiest bin; a task with a gap releases its emptiest bins until their free space could close the
gap.  What is released is dealt anew over fewer tasks, so documents meet those of other partitions, and
packed again, until one task is left.  Every round's rows are fixed in a written table.

Only (doc_id, piece, start, length, checksum) rows move.  Results depend on the rows alone, not on
partitioning or task order.

Defined edge cases: null text is the empty text, whose only token is the closing id; a null doc_id
is packed like any other; repeated rows are packed one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_paths, encoder

CAPACITY = 1024
#: Appended to each document's ids.
CLOSING_ID = 2
ROWS_PER_TASK = 20_000
#: Tasks among which a chunk's pieces go round; no window holds more than a chunk, even if all lengths are equal.
TASKS_PER_CHUNK = 20
BANDS = 16

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KEYS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of doc_id, text; with_ids adds the ids themselves."""
    paths = paths or default_paths()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(*paths, special=True)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = np.array([*encode(text or ""), CLOSING_ID], dtype="<u4")
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    out.append((doc_id, k, s, n, zlib.crc32(part.tobytes()), *([part.astype("i4")] if with_ids else [])))
            frame = pd.DataFrame(out, columns=[*_KEYS, *(["ids"] if with_ids else [])])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, _PIECE + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit over lengths in the given (decreasing) order: bin and offset of each, fill of each bin.

    Bins are kept by free space, and a bit mask tells which amounts of free space exist."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        by_free[free - n].append(b)
        mask |= 1 << (free - n)
    return bins, offsets, np.array(fill, "i8")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs.  counts[n]: pieces of length n.

    Largest bound over two families of dual-feasible functions: the threshold family (a piece over
    capacity - t counts whole, one under t counts nothing) and the rounding family u_k."""
    n = np.arange(len(counts), dtype="i8")
    best = -(-int((n * counts).sum()) // capacity)
    used = np.flatnonzero(counts)
    for t in used[used <= capacity // 2].tolist():
        value = np.where(n > capacity - t, capacity, np.where(n < t, 0, n))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 21):  # u_k(x) = x if (k+1)x is whole, else floor((k+1)x)/k, in units of 1/(k*capacity)
        whole = (k + 1) * n % capacity == 0
        value = np.where(whole, n * k, ((k + 1) * n // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _release(fill: np.ndarray, bound: int, capacity: int) -> np.ndarray:
    """The emptiest bins whose free space could close the gap; of a certified share, the emptiest bin."""
    gap = len(fill) - bound
    order = np.argsort(fill, kind="stable")
    free = np.cumsum(capacity - fill[order])
    n = int(np.searchsorted(free, (gap + 1) * capacity)) + 1 if gap else 1
    out = np.zeros(len(fill), bool)
    out[order[:n]] = True
    return out & (fill < capacity)


def _packed(share: pd.DataFrame, turn: int, part: int, capacity: int, last: bool) -> pd.DataFrame:
    lengths = share["length"].to_numpy()
    bins, offsets, fill = best_fit(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    freed = np.zeros(len(fill), bool) if last else _release(fill, bound, capacity)
    return share.assign(sequence_id=(turn << 56) + (part << 24) + bins, offset=offsets, released=freed[bins], bins=len(fill), bound=bound)


def _round(rows: DataFrame, turn: int, parts: int, capacity: int, last: bool) -> DataFrame:
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in _KEYS], F.lit(turn))
    chunks = math.ceil(parts / TASKS_PER_CHUNK)
    chunk = F.pmod(mark, F.lit(chunks))
    wide = F.floor((F.col("chunk") + 1) * parts / chunks) - F.floor(F.col("chunk") * parts / chunks)
    turns = F.row_number().over(W.partitionBy("chunk", "band").orderBy("length", "mark", *_KEYS)) + F.pmod(F.xxhash64("chunk", "band"), F.lit(1 << 20))
    part = F.floor(F.col("chunk") * parts / chunks) + F.pmod(turns, wide)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            batch = batch.astype({"doc_id": "Int64"})
            for p, share in batch.groupby("part", sort=False):
                if held and held[-1]["part"].iloc[0] != p:
                    yield finish(held)
                    held = []
                held.append(share)
        if held:
            yield finish(held)

    def finish(held: list[pd.DataFrame]) -> pd.DataFrame:
        share = pd.concat(held, ignore_index=True)
        return _packed(share.drop(columns="part"), turn, int(share["part"].iloc[0]), capacity, last)

    marked = rows.select(*_KEYS, mark.alias("mark"), chunk.alias("chunk"), F.floor(F.col("length") * BANDS / (capacity + 1)).alias("band"))
    dealt = marked.select(*_KEYS, part.cast("long").alias("part")).repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    return ordered.mapInPandas(run, f"{_PIECE}, sequence_id long, offset long, released boolean, bins long, bound long")


def pack(rows: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """rows: doc_id, piece, start, length, ids_crc32.  Adds sequence_id and offset.  Each round has fewer tasks than the one
    before; the last has one."""
    done, turn = None, 0
    parts = max(1, math.ceil(rows.count() / rows_per_task))
    while True:
        last = parts == 1
        packed = materialize(_round(rows, turn, parts, capacity, last), f"packed{turn}")
        kept = packed.where("not released").select(*_KEYS, "sequence_id", "offset")
        done = kept if done is None else done.union(kept)
        if last:
            return done
        rows = packed.where("released").select(*_KEYS)
        turn, parts = turn + 1, max(1, min(parts - 1, math.ceil(rows.count() / rows_per_task)))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces); the histogram has at most capacity rows."""
    counts = np.zeros(capacity + 1, "i8")
    for n, c in packed.groupBy("length").count().collect():
        counts[n] = c
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, capacity, paths), "pieces"), capacity)
