"""SimHash near-deduplication over a Gray-order hierarchical index.

Fingerprints: 64-bit SimHash of word 4-shingles, counted in whole texts.  Two fingerprints link at
`RADIUS` or fewer differing bits; equal fingerprints are joined beforehand, so the index holds each
fingerprint once.

Upper nodes of the index are masked bit patterns.  A node's free bits are cut into RADIUS + 1 blocks;
two linked fingerprints agree on one block at least, so they meet in the child that fixes that
block.  Nodes with more than `NODE_ROWS` fingerprints are refined again by their remaining bits.
A task holds whole nodes, sorts each by Gray rank (neighbours in that order differ in few bits), and
builds blocks of eight over them, each with the bits that all below it share.  A pair of blocks whose shared
bits already differ in more than RADIUS places is pruned as a whole.  Instead of all pairs a task
returns one star per set of linked fingerprints; connected components over the stars finish the job.

`keep_one_per_group` is the filter for near copies: word 5-grams (as sets) alike by SIMILAR or more.  SimHash of
shingles moves by ten bits at that similarity, so the filter takes SimHashes of the set of words, which an edit hardly
moves: VIEWS of them with different seeds go through the same index at VIEW_RADIUS, each distinct fingerprint once.  Copies
that were cut off or extended change many distinct words, so a text also stands under BANDS patterns with every bit fixed,
each of BAND_ROWS min-hashes of its 5-grams (two texts alike by 0.8 share one of them but for 2 pairs in 10,000), and under each
view's whole fingerprint.  Rows that meet become a candidate pair if their sketches agree (SKETCH one-bit min-hashes of the
5-grams, whose share of equal bits is (1 + similarity) / 2; SLACK allows for its sampling error); of a set of rows that meet
the edges of two spanning forests are candidates, never all pairs.  A candidate links only if the 5-gram sets of both whole
texts are compared and alike by SIMILAR.  A node of more than NODE_ROWS rows is dealt over tasks; the rows that stand for
the sets found meet again, dealt anew, until one task holds them or PASSES have gone by (what never met so meets in other bands).

Defined edge cases: null text is the empty text; texts without words have fingerprint zero and link
to one another; texts with the same words are near copies of one another; a text of fewer words than a shingle is one shingle; repeated rows share a fingerprint;
a null doc_id never names a component while another document is in it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled, with_row_ids
from .components import components
from .membership import marked, without
from .weighted_fingerprint import terms

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a node above which it is refined, and the refinements at most: after six at most 18 bits are free, so
#: that no node holds more than 2**18 distinct fingerprints.
NODE_ROWS = 4096
DEPTH = 6
#: The filter for near copies.
SIMILAR = 0.8
SLACK = 0.14
NEAR_SHINGLE = 5
VIEWS = (11, 22, 33)
VIEW_RADIUS = 5
SKETCH = 256
BANDS, BAND_ROWS = 16, 4
#: Passes in which wide nodes are dealt by chance; what is still wide then is compared chunk by chunk.
PASSES = 4
#: Hashes of a text whose bits are summed at once.
HASHES_AT_ONCE = 1 << 13
#: Pairs of one text that are verified against one copy of it.
PAIRS_PER_SALT = 256
_FAN = 8
_PAIRS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash as a signed 64-bit number."""
    import xxhash

    joined = _joined_words(text or "")
    if not joined:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(joined, "u1") == 32), len(joined)) + 1
    width = min(shingle, len(ends))
    starts, ends = np.concatenate(([0], ends[:-width])), ends[width - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, "i8")
    for k in range(0, len(ends), HASHES_AT_ONCE):
        spans = zip(starts[k : k + HASHES_AT_ONCE].tolist(), ends[k : k + HASHES_AT_ONCE].tolist(), strict=True)
        ones += _bit_sums(np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")[:, None])
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<i8")[0])


def _joined_words(text: str) -> bytes:
    """b" ".join(text.encode().lower().split()) without an object for each word: a long text costs some bytes a byte.
    Bytes: ASCII case and ASCII white space only."""
    data = np.frombuffer(text.encode().lower(), "u1")
    space = (data == 32) | ((data >= 9) & (data <= 13))
    kept = ~space
    kept[1:] |= ~space[:-1]  # and the first white space after a word
    return np.where(space, np.uint8(32), data)[kept].tobytes().rstrip(b" ")


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each bit of each column of hashes is 1."""
    bits = np.unpackbits(hashes.view("u1").reshape(len(hashes), -1), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype="i8")


def fingerprints(docs: DataFrame, row: str = "doc_id") -> DataFrame:
    """doc_id, row (the column so named), fp (signed 64-bit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch["text"]), "i8", len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"].astype("Int64"), "fp": fp})

    return docs.select("doc_id", F.col(row).alias("row"), "text").mapInPandas(run, "doc_id long, row long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def child_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """mask with each of radius + 1 near-equal blocks of its free bits fixed as well."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = radius + 1
    edges = [len(free) * k // n for k in range(n + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(edges, edges[1:], strict=False) if e > s]


def gray_rank(fp: Column) -> Column:
    """Place of a code word in Gray order: the running XOR of its bits from the top."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def index_nodes(fps: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS, depth: int = DEPTH, view=()) -> DataFrame:
    """fps (fp and what else its rows carry) with each node (mask, pattern) they stand under; rows of different
    view columns never share a node."""
    rows = fps.withColumn("mask", F.lit(0).cast("long"))
    node = [*view, "mask", "pattern"]
    masks, leaves = [0], None
    for level in range(depth):
        children = {m: child_masks(m, radius) for m in masks}
        pick = F.create_map(*[x for m, cs in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))])
        below = rows.withColumn("mask", F.explode(F.element_at(pick, F.col("mask"))))
        below = below.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        leaf = below
        if level < depth - 1:
            counts = below.groupBy(*node).agg(F.count(F.lit(1)).alias("n"))
            full = materialize(counts.where(F.col("n") > node_rows).select(*node), "nodes")
            if not full.isEmpty():
                leaf = below.join(full, node, "left_anti")
                rows = below.join(full, node, "left_semi").select(*rows.columns)
                masks = sorted(r["mask"] % (1 << 64) for r in full.select("mask").distinct().collect())  # at most (radius + 1) ** level
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if leaf is below:
            break
    return leaves


class _Blocks:
    """One level of the index: shared one bits and zero bits of consecutive members, and their range."""

    def __init__(self, ones, zeros, start, end):
        self.ones, self.zeros, self.start, self.end = ones, zeros, start, end


def _levels(fp: np.ndarray, first: np.ndarray) -> list[_Blocks]:
    """Levels from the rows (level 0, one member each) up to one block a node; first: each node's first row."""
    ends = np.append(first[1:], len(fp))
    at = np.arange(len(fp))
    levels = [_Blocks(fp, ~fp, at, at + 1)]
    start, end = first, ends
    while True:
        counts = -(-(end - start) // _FAN)
        node_start = np.cumsum(counts) - counts
        s = np.repeat(start, counts) + _FAN * (np.arange(counts.sum()) - np.repeat(node_start, counts))
        e = np.minimum(s + _FAN, np.repeat(end, counts))
        below = levels[-1]
        levels.append(_Blocks(np.bitwise_and.reduceat(below.ones, s), np.bitwise_and.reduceat(below.zeros, s), s, e))
        start, end = node_start, node_start + counts
        if (counts <= 1).all():
            return levels


def linked_roots(
    fp: np.ndarray, first: np.ndarray, radius: int = RADIUS, sketch: np.ndarray | None = None, most: int = 0, edges: list | None = None
) -> np.ndarray:
    """For rows grouped into nodes: the smallest row of each row's set of linked rows.  With sketches (rows of
    64-bit words) a link also needs at most `most` differing sketch bits.  edges is given the links that joined the sets."""
    root = np.arange(len(fp))
    levels = _levels(fp, first)
    top = len(levels) - 1
    tops = np.arange(len(levels[top].ones))
    stack = [(top, tops, tops)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > _PAIRS:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        here = levels[level]
        differ = np.bitwise_count((here.ones[a] & here.zeros[b]) | (here.zeros[a] & here.ones[b]))
        near = differ <= radius
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if sketch is not None:
                alike = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= most
                a, b = a[alike], b[alike]
            joined = _join(root, a, b)
            if edges is not None:
                edges.extend(joined)
            continue
        na, nb = here.end[a] - here.start[a], here.end[b] - here.start[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = here.start[a][pair] + k // nb[pair], here.start[b][pair] + k % nb[pair]
        once = (x < y) if level == 1 else (x <= y)
        stack.append((level - 1, x[once], y[once]))
    return root


def alike_roots(first: np.ndarray, sketch: np.ndarray, most: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """linked_roots for nodes whose fingerprints are all equal, so that sketches alone decide, and the row that each row
    was reached from.  A row that was reached is never compared again: a node of near copies costs its rows, not
    its pairs.  The first row (backwards: the last) of a set stands for it."""
    root = np.arange(len(sketch))
    reached_from = root.copy()
    for start, end in zip(first, np.append(first[1:], len(sketch)), strict=True):
        left = np.arange(end - 1, start - 1, -1) if backwards else np.arange(start, end)
        while len(left) > 1:
            seed, left = left[0], left[1:]
            reached = [seed]
            while reached and len(left):
                at = reached.pop()
                near = np.bitwise_count(sketch[left] ^ sketch[at]).sum(axis=1) <= most
                root[left[near]], reached_from[left[near]] = seed, at
                reached.extend(left[near])
                left = left[~near]
    return root, reached_from


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merge the sets of a[i] and b[i]; root stays each set's smallest row.  Returns the links used, one for each merger."""
    used = []
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        order = np.lexsort((low, high))
        pick = order[np.append(True, high[order][1:] != high[order][:-1])]  # one link for each set that is merged
        root[high[pick]] = low[pick]
        used.append((a[pick], b[pick]))
        while (root != (up := root[root])).any():
            root[:] = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return used


def _held_nodes(batches: Iterator[pd.DataFrame], node: list[str], rows_at_once: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole nodes of a sorted stream, about rows_at_once rows at a time, and the first row of each.  A batch is copied
    once, however many batches a node spans."""
    held: list[pd.DataFrame] = []
    size, last = 0, None

    def starts(rows: pd.DataFrame) -> np.ndarray:
        keys = rows[node].to_numpy()
        return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(rows) else np.array([], "i8")

    for batch in batches:
        if not len(batch):
            continue
        cut = int(starts(batch)[-1])  # the last node may go on in the next batch
        if size >= rows_at_once and (cut or tuple(batch[node].iloc[0]) != last):
            rows = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held, size = [], 0
            yield rows, starts(rows)
            batch = batch.iloc[cut:]
        held.append(batch)
        size += len(batch)
        last = tuple(batch[node].iloc[-1])
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, starts(rows)


def node_links(leaves: DataFrame, radius: int = RADIUS, rows_at_once: int = 40_000, view=(), name: str = "fp", sketch=(), most: int = 0) -> DataFrame:
    """u, v: linked rows by name.  Each row with the one that stands for its set inside a node, or with sketches the
    links of a spanning forest of the set."""
    node = [*view, "mask", "pattern"]
    carried = list(dict.fromkeys(["fp", name, *sketch]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, first in _held_nodes(batches, node, rows_at_once):
            fp, names = rows["fp"].to_numpy("i8").view("u8"), rows[name].to_numpy("i8")
            if sketch:
                edges: list = []
                linked_roots(fp, first, radius, _sketch_words(rows), most, edges)
                for a, b in edges:
                    yield pd.DataFrame({"u": names[a], "v": names[b]})
            else:
                root = linked_roots(fp, first, radius)
                tied = root != np.arange(len(fp))
                yield pd.DataFrame({"u": names[tied], "v": names[root[tied]]})

    ordered = leaves.repartition(*node).sortWithinPartitions(*node, gray_rank(F.col("fp")), name)
    return ordered.select(*node, *carried).mapInPandas(run, "u long, v long")


def _placed(docs: DataFrame, row: str, radius: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints(docs), and for each fingerprint the smallest of those linked to it, with the first
    document of that component (smallest doc_id, then row; null last)."""
    marked = materialize(fingerprints(docs, row), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    fps = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    links = materialize(node_links(index_nodes(fps.select("fp"), radius, node_rows), radius), "stars")
    roots = components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = materialize(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("first"))
    return marked, placed.select("fp", "root").join(named, "root").select("fp", "first.id", "first.row")


def simhash_components(docs: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked, owner = _placed(docs, "doc_id", radius, node_rows)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(owner.select("fp", F.col("id").alias("component_id")), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def word_hash_fingerprints(words: list[bytes], seeds=VIEWS) -> list[int]:
    """SimHashes of the set of words, one for each seed."""
    import xxhash

    if not words:
        return [0] * len(seeds)
    distinct = list(set(words))
    ones = np.zeros(64 * len(seeds), "i8")
    for k in range(0, len(distinct), HASHES_AT_ONCE):
        part = distinct[k : k + HASHES_AT_ONCE]
        ones += _bit_sums(np.array([[xxhash.xxh64_intdigest(w, seed) for seed in seeds] for w in part], "<u8"))
    return np.packbits(2 * ones > len(distinct), bitorder="little").view("<i8").tolist()


def min_hashes(words: list[bytes], samples: int = SKETCH) -> np.ndarray:
    """The least hash of the word 5-grams under each of `samples` hash functions."""
    found, _ = terms(words, NEAR_SHINGLE)
    odd, add = _hash_functions(samples)
    short = (found >> np.uint64(32)).astype("u4")
    least = np.full(samples, 0xFFFFFFFF, "u4")
    for s in range(0, len(short), 2048):
        h = short[s : s + 2048, None] * odd
        h ^= h >> np.uint32(15)
        h *= add
        least = np.minimum(least, h.min(axis=0))
    return least


def min_hash_bits(words: list[bytes], samples: int = SKETCH) -> np.ndarray:
    """One bit of each min-hash."""
    return _bits(min_hashes(words, samples))


def _bits(least: np.ndarray) -> np.ndarray:
    return np.packbits((least >> np.uint32(7) & np.uint32(1)).astype("u1"), bitorder="little").view("<i8")


def _bands(least: np.ndarray) -> np.ndarray:
    """A hash of each run of BAND_ROWS min-hashes, for BANDS runs."""
    mixed = np.zeros(BANDS, "u8")
    for part in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype("u4").view("i4")


@functools.lru_cache(maxsize=2)
def _hash_functions(samples: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 31, (2, samples), dtype="u4") * np.uint32(2) + np.uint32(1)
    return drawn[0], drawn[1]


_WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def near_signatures(docs: DataFrame, row: str) -> DataFrame:
    """doc_id, row, fps (one SimHash of the word set for each view), bands, and the sketch's words s0, s1, ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, bands, sketches = [], [], []
            for text in batch["text"]:
                words = (text or "").encode().lower().split()
                fps.append(word_hash_fingerprints(words))
                least = min_hashes(words)
                bands.append(_bands(least))
                sketches.append(_bits(least))
            words = np.array(sketches, "i8").reshape(len(batch), len(_WORDS))
            frame = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "fps": fps, "bands": bands})
            yield frame.assign(**{w: words[:, k] for k, w in enumerate(_WORDS)})

    schema = "doc_id long, row long, fps array<long>, bands array<int>, " + ", ".join(f"{w} long" for w in _WORDS)
    return docs.select("doc_id", F.col(row).alias("row"), "text").mapInPandas(run, schema)


def _sketch_words(rows: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(rows[_WORDS].to_numpy("i8")).view("u8")


def alike_links(rows: DataFrame, most: int, rows_at_once: int = 40_000) -> DataFrame:
    """rows: view, fp, chunk, dealt, name and sketches.  Returns view, fp, u, v: links of two spanning forests of each set
    of rows that meet in a chunk of a node and have like sketches; where dealt, also u = v for each row that stands for a set."""
    node = ["view", "fp", "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, first in _held_nodes(batches, node, rows_at_once):
            sketch, names = _sketch_words(held), held["name"].to_numpy("i8")
            at = np.arange(len(names))
            root, above = alike_roots(first, sketch, most)
            _, below = alike_roots(first, sketch, most, backwards=True)
            seeds = np.flatnonzero((root == at) & held["dealt"].to_numpy(bool))
            a = np.concatenate((np.flatnonzero(above != at), np.flatnonzero(below != at), seeds))
            b = np.concatenate((above[above != at], below[below != at], seeds))
            yield pd.DataFrame({"view": held["view"].to_numpy("i4")[a], "fp": held["fp"].to_numpy("i8")[a], "u": names[a], "v": names[b]})

    ordered = rows.repartition(*node).sortWithinPartitions(*node, "name")
    return ordered.select(*node, "dealt", "name", *_WORDS).mapInPandas(run, "view int, fp long, u long, v long")


def _chunked(places: DataFrame, named: DataFrame, turn: int, node_rows: int) -> DataFrame:
    """places (view, fp, name: a written table) where another row stands as well, with sketches; nodes of more than
    node_rows are dealt over chunks."""
    counts = places.groupBy("view", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / node_rows).cast("long")
    counts = materialize(counts.select("view", "fp", chunks.alias("chunks")), "nodes")
    many = places.join(counts, ["view", "fp"])
    dealt = many.select("view", "fp", "name", F.pmod(F.xxhash64("name", F.lit(turn)), F.col("chunks")).alias("chunk"), (F.col("chunks") > 1).alias("dealt"))
    return dealt.join(named.select("name", *_WORDS), "name")


def _paired_chunks(places: DataFrame, named: DataFrame, node_rows: int) -> DataFrame:
    """places with sketches, for alike_links: each pair of a node's chunks is a cell, so any two rows of a node meet in one.
    A row is copied once for each other chunk; a cell holds about node_rows rows."""
    counts = places.groupBy("view", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts.select("view", "fp", F.ceil(2 * F.col("n") / node_rows).cast("long").alias("chunks")), "nodes")
    own = F.pmod(F.xxhash64("name", F.lit(PASSES)), F.col("chunks"))
    rows = places.join(counts, ["view", "fp"]).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("own <> other OR chunks = 1")
    cell = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
    cells = rows.select("view", "fp", "name", cell.alias("chunk"), F.lit(False).alias("dealt"))
    return cells.join(named.select("name", *_WORDS), "name")


def candidates(named: DataFrame, most: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """u > v: names of rows that meet and have like sketches.  named: a written table of name, fps, bands and sketches."""
    views = named.select("name", *_WORDS, F.posexplode("fps").alias("view", "fp"))
    one = F.min(F.struct("name", *_WORDS)).alias("one")
    distinct = materialize(views.groupBy("view", "fp").agg(one).select("view", "fp", "one.*"), "distinct")
    met = materialize(node_links(index_nodes(distinct, VIEW_RADIUS, node_rows, view=("view",)), VIEW_RADIUS, view=("view",), name="name", sketch=_WORDS, most=most), "met")
    bands = named.select("name", F.posexplode("bands").alias("view", "fp")).select((F.col("view") + len(VIEWS)).alias("view"), F.col("fp").cast("long").alias("fp"), "name")
    places = views.select("view", "fp", "name").union(bands)
    for turn in range(PASSES):
        links = materialize(alike_links(_chunked(places, named, turn, node_rows), most), "links")
        met = met.union(links.where("u <> v").select("u", "v"))
        places = links.where("u = v").select("view", "fp", F.col("u").alias("name"))
        if places.isEmpty():
            break
    else:  # nodes of many unlike rows, which dealing anew would never narrow
        links = materialize(alike_links(_paired_chunks(places, named, node_rows), most), "links")
        met = met.union(links.where("u <> v").select("u", "v"))
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of pairs (u, v: a written table) whose whole texts have 5-gram sets alike by `similar` or more.  texts: name,
    text.  A text that many pairs share is copied to salts in proportion, so its pairs spread over many tasks."""
    shared = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).cast("long").alias("salts"))
    shared = materialize(shared, "shared")
    ends = materialize(pairs.select("u").union(shared.select("v")).distinct().withColumnRenamed("u", "name"), "ends")
    held = marked(texts, ends, "name", "__maybe").where("__maybe").select("name", "text")
    right = held.join(shared, F.col("name") == F.col("v")).select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("text").alias("right"))
    left = pairs.join(shared, "v").join(held.withColumnRenamed("name", "u").withColumnRenamed("text", "left"), "u")
    left = left.withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts"))).drop("salts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, right = None, None
        for batch in batches:
            alike = np.zeros(len(batch), bool)
            for k, (a, v, b) in enumerate(zip(batch["left"], batch["v"], batch["right"], strict=True)):
                if v != last:
                    last, right = v, grams(b)
                left = grams(a)
                both = len(np.intersect1d(left, right, assume_unique=True))
                alike[k] = both >= similar * (len(left) + len(right) - both)
            yield batch.loc[alike, ["u", "v"]]

    return left.join(right, ["v", "salt"]).select("u", "left", "v", "right").mapInPandas(run, "u long, v long")


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word 5-grams."""
    return terms((text or "").encode().lower().split(), NEAR_SHINGLE)[0]


def near_copies(rows: DataFrame, row: str, similar: float = SIMILAR, node_rows: int = NODE_ROWS) -> DataFrame:
    """row, stays: the rows (numbered by the column so named) that repeat another, and that row's number."""
    signed = materialize(near_signatures(rows, row), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    alike = signed.groupBy("fps", *_WORDS).agg(F.min(first).alias("first"), F.min("bands").alias("bands"))
    named = materialize(alike.withColumn("name", F.col("first.row")), "named")
    most = round((1 - similar + SLACK) / 2 * SKETCH)
    spark = rows.sparkSession
    pairs = settled(spark, "pairs", lambda: candidates(named, most, node_rows))
    links = settled(spark, "links", lambda: verified(pairs, rows.select(F.col(row).alias("name"), "text"), similar))
    roots = components(links).select(F.col("u").alias("name"), F.col("v").alias("root"))
    placed = materialize(named.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name")), "placed")
    stays = placed.groupBy("root").agg(F.min("first").alias("first")).select("root", F.col("first.row").alias("stays"))
    owner = placed.join(materialize(stays, "stays"), "root").select("fps", *_WORDS, "stays")
    return signed.join(owner, ["fps", *_WORDS]).where("row <> stays").select("row", "stays")


def keep_one_per_group(docs: DataFrame, similar: float = SIMILAR, node_rows: int = NODE_ROWS) -> DataFrame:
    """docs without near copies: of each group linked by similarity the first document stays (smallest doc_id, null
    last, then the first row).  Null and empty texts and texts of white space are copies of one another; of ties and repeated rows
    one stays; an empty table stays empty; all columns are kept, whatever their names."""
    rows, row = with_row_ids(docs)
    gone = settled(docs.sparkSession, "gone", lambda: near_copies(rows, row, similar, node_rows).select(F.col("row").alias(row)))
    return without(rows, gone, row).select(*docs.columns)
