"""Mixing sources to target weights by cube-method balanced sampling.

Sources, ordered by code point with null last, weigh 3, 1, 2, 3, ... and share 150 % of all words; a
target stops at twice its source's words and the excess is shared again by weight.  A document is
taken floor(r) times for sure (r: target over source size) and once more with probability r - floor(r).

Flight phase: at most three undecided documents of a source are held; moving their probabilities along
the null space of the two constraints (sums of tokens and of documents stay as they are) decides at
least one, and the next document takes its place.  Each (block, source) leaves two undecided ones; a
second flight over those and about RESERVE documents of each source leaves two a source.  The landing
phase rounds these and flips up to two of the last RESERVE decisions for the least error in tokens.  The
flight streams, so a source with any share of the rows needs no more memory, and
blocks are dealt by document, not by source.

Defined edge cases: null text has no words and null source is a source of its own; documents without
words take 0; repeated rows are drawn one by one; an empty table gives an empty result; other columns
are ignored.  Reruns agree: order, blocks and random numbers come from hashes of the rows.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, with_row_ids
from .sharding import prefix_positions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
ROWS_PER_BLOCK = 20_000
#: Sources up to this number are broadcast with their targets; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Documents of a source, drawn by hash, that wait for the second flight; the landing may flip two of them.
RESERVE = 256
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: rank, source, source_size, target."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("unnamed", F.col("source").isNull())
    ranked = prefix_positions(sums, ["unnamed", "source"], "source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("global_row") % len(weights) + 1).cast("int"))
    table = materialize(
        ranked.select(F.col("global_row").alias("rank"), "source", "source_size", "rows", weight.alias("weight")), "sources"
    )
    level, total = 0.0, None
    while True:
        full = F.col("weight") * level >= most * F.col("source_size")
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("fixed") if level else F.lit(0.0).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open") if level else F.sum("weight").alias("open"),
        ).first()
        total = share * (row["all"] or 0)
        if not row["open"] or (again := max(0.0, total - row["fixed"]) / row["open"]) <= level * (1 + 1e-12):
            break
        level = again
    target = F.least(F.col("weight") * level, most * F.col("source_size"))
    return table.select("rank", "source", "source_size", "rows", target.cast("double").alias("target"))


class _Flight:
    """Holds up to three undecided units of one source and decides them one after another."""

    def __init__(self, seed: list[int]):
        self.held: list[list] = []  # [row position, size, probability]
        self.draw = np.random.default_rng(seed).random

    def add(self, at: int, size: float, p: float, decided: list[tuple[int, float]]) -> None:
        self.held.append([at, size, p])
        while len(self.held) == 3:
            (_, a, _), (_, b, _), (_, c, _) = self.held
            if a == b:
                u = (1.0, -1.0, 0.0)
            elif b == c:
                u = (0.0, 1.0, -1.0)
            elif a == c:
                u = (1.0, 0.0, -1.0)
            else:
                scale = max(abs(b - c), abs(c - a), abs(a - b))
                u = ((c - b) / scale, (a - c) / scale, (b - a) / scale)
            up = min((1 - h[2]) / v if v > 0 else -h[2] / v for h, v in zip(self.held, u, strict=True) if v)
            down = min(h[2] / v if v > 0 else (h[2] - 1) / v for h, v in zip(self.held, u, strict=True) if v)
            step = up if self.draw() * (up + down) < down else -down
            left = []
            for h, v in zip(self.held, u, strict=True):
                h[2] += step * v
                if h[2] < 1e-9 or h[2] > 1 - 1e-9:
                    decided.append((h[0], float(round(h[2]))))
                else:
                    left.append(h)
            self.held = left

    def land(self, decided: list[tuple[int, float]], recent: list[tuple[int, float, float]]) -> None:
        """Decide what is held, then flip one or two of it and of recent (row position, size, decision) to
        meet the tokens that the probabilities stood for."""
        want = sum(s * p for _, s, p in self.held)
        rows = [(at, s, float(round(p))) for at, s, p in self.held] + recent
        self.held = []
        size, took = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        error = sum(s * v for _, s, v in rows[: len(rows) - len(recent)]) - want
        if len(rows) and error:
            change = np.append(size * (1 - 2 * took), 0.0)  # of one flip; the last is none
            after = np.abs(error + change[:, None] + change[None, :])
            np.fill_diagonal(after, np.inf)
            after[-1, -1] = abs(error)
            for k in np.unravel_index(after.argmin(), after.shape):
                if k < len(rows):
                    took[k] = 1 - took[k]
        decided += [(r[0], v) for r, v in zip(rows, took.tolist(), strict=True)]


_ROW = "block long, rank long, doc_id long, size long, more double"


def _flight(rows: DataFrame, seed: int, landing: bool) -> DataFrame:
    """rows sorted by block and rank within partitions; more: the probability, 0 or 1 once decided."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flight, key, waiting, recent, out = None, None, {}, collections.deque(), []

        def emit(decided):
            out.extend((*waiting.pop(at), p) for at, p in decided)

        def leave():
            decided: list[tuple[int, float]] = []
            if flight is not None and landing:
                flight.land(decided, [(at, waiting[at][3], p) for at, p in recent])
                recent.clear()
            emit(decided)
            emit([(at, p) for at, _, p in flight.held] if flight is not None else [])

        n = 0
        for batch in batches:
            ids = [None if x is None or x != x else int(x) for x in batch["doc_id"].tolist()]
            columns = (batch["block"].tolist(), batch["rank"].tolist(), ids, batch["size"].tolist(), batch["more"].tolist())
            for block, rank, doc_id, size, p in zip(*columns, strict=True):
                if (block, rank) != key:
                    leave()
                    key, flight = (block, rank), _Flight([seed, block + 1, rank])
                n += 1
                waiting[n] = (block, rank, doc_id, size)
                decided: list[tuple[int, float]] = []
                flight.add(n, float(size), p, decided)
                if landing:
                    recent.extend(decided)
                    decided = [recent.popleft() for _ in range(len(recent) - RESERVE)]
                emit(decided)
            yield _frame(out)
            out.clear()
        leave()
        yield _frame(out)

    return rows.mapInPandas(run, _ROW)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "rank", "doc_id", "size", "more"]).astype({"doc_id": "Int64"})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "words")
    targets = materialize(source_targets(sizes), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    t = targets.withColumnRenamed("source", "__source")
    t = F.broadcast(t) if small else t
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sizes.join(t, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", rate)
    sure = F.floor(F.col("rate") + 1e-12)
    rated = rated.select("doc_id", "size", "rank", "rows", sure.alias("sure"), F.greatest(F.lit(0.0), F.col("rate") - sure).alias("more"))
    blocks = max(1, math.ceil(sizes.count() / ROWS_PER_BLOCK))
    mark = F.xxhash64("doc_id", "size", F.lit(seed))
    waits = F.pmod(F.shiftrightunsigned(mark, 20), F.lit(1 << 40)) < F.lit(float(RESERVE << 40)) / F.col("rows")
    block = F.when(waits, F.lit(-1)).otherwise(F.pmod(mark, F.lit(blocks)))
    drawn = rated.where("more > 1e-9").select(block.cast("long").alias("block"), "rank", "doc_id", "size", "more")
    dealt = drawn.where("block >= 0").repartition(blocks, "block").sortWithinPartitions("block", "rank", F.desc("size"), mark, "doc_id")
    first = materialize(_flight(dealt, seed, landing=False), "flight")
    undecided = (F.col("more") > 0) & (F.col("more") < 1)
    left = first.where(undecided).withColumn("block", F.lit(-1).cast("long"))
    left = left.union(drawn.where("block < 0"))
    again = left.repartition("rank").sortWithinPartitions("block", "rank", mark, "doc_id", "size", "more")
    second = materialize(_flight(again, seed + 1, landing=True), "landing")
    decided = first.where(~undecided).union(second).select("rank", "doc_id", "size", "more")
    whole = rated.where("more <= 1e-9").select("rank", "doc_id", "size", F.lit(0.0).alias("more"))
    base = t.select("rank", F.col("__source").alias("source"), "source_size", "target", F.floor(rate + 1e-12).alias("sure"))
    out = decided.union(whole).join(base, "rank")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("sure") + F.col("more"))).cast("long").alias("taken"),
        "source",
        (F.col("sure") + F.col("more")).cast("int").alias("copies"),
    )


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, each row as many times as the mix takes it: not at all, once or twice.  A null source is a source of its own; null
    and empty texts have no words and count as documents only; repeated rows are drawn one by one; null doc_ids don't matter, for rows
    are drawn by number; an empty table stays empty; all columns are kept, whatever their names."""
    rows, row = with_row_ids(docs)
    numbered = rows.select(F.col(row).alias("doc_id"), "source", "text")  # the draw needs a name for each row, no more
    taken = mix(numbered, seed).where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(f"{row}copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{row}copies")))
    return rows.join(taken, row).withColumn(row, copies).select(*docs.columns)
