"""A trie over the prefixes of conversations, from chained digests.

Each turn has a SHA-256 of its role and text.  A prefix's digest is that of the shorter prefix's digest and the turn's, so
equal prefixes have equal digests and two are compared by 32 bytes whatever their length.  Every prefix of every conversation is a row;
rows of one (depth, digest) are a node.  The sums over a node's subtree take each node's value to all of its ancestors:
it is laid on one member's row (its smallest), where it is summed with that member's deeper values, and the member's rows give what
they hold to their nodes.  Each pair of a node and an ancestor counts once, as if all pairs were made, but there is one row for each prefix
and not one for each pair, of which a long conversation has the square of its length.

No conversation is one task's.  Positions come from range partitions; chains run inside blocks of BLOCK turns, and each block starts from
the digests of the blocks before it, so that equal prefixes agree; sums along a conversation are added by block in the same way.  A
node with a third of all conversations is a sum that is added map-side.  The ids of the conversations that end at a node are hashed in pieces of
PIECE ids, in order; a node with few has them hashed by an expression, any other by one pass over its pieces.

Defined edge cases: null role or text is the empty string; turns are ordered by turn (null first), ties by their
digests, so that repeated rows and numbers have one order; rows without conv_id belong to no conversation and are left out; c % 100 is that of floor division
for negative ids; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .sharding import prefix_positions

#: Turns of a block.
BLOCK = 256
#: Conversation ids of one piece of a list, and conversations of a range partition.
PIECE, RANGE = 1000, 200_000
#: Conversations share their first turns with the first of so many, and at most LONGEST_GRAFT - 1 of them.
FAMILY, LONGEST_GRAFT = 100, 6


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest, n_chars of each turn.  A written table."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("told"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("n_chars"), F.lit(1).alias("one")
    )
    # The row's number only deals equal rows over partitions.
    order = ["conv_id", "told", "turn", "digest", "row"]
    placed = prefix_positions(turns.withColumn("row", F.monotonically_increasing_id()), order, "one")
    placed = materialize(placed.select("conv_id", "global_row", "digest", "n_chars"), "turns")
    first = placed.groupBy("conv_id").agg(F.min("global_row").alias("first"))
    return materialize(placed.join(first, "conv_id").select("conv_id", (F.col("global_row") - F.col("first")).cast("long").alias("pos"), "digest", "n_chars"), "digests")


def graft(turns: DataFrame, family: int = FAMILY, longest: int = LONGEST_GRAFT) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c takes the first h turns of conversation c - c % family and goes on with its own
    after its first h; h = crc32(c in decimal) % longest.  conversations: conv_id, n turns, those without turns as well."""
    h = F.crc32(F.col("conv_id").cast("string")) % longest
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base")), "own")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = own.join(bases, "base", "left").select("*", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")).drop("base_n")
    known = materialize(known, "known")
    lent = turns.where(F.col("pos") < longest - 1).withColumnRenamed("conv_id", "base")
    borrowed = known.join(lent, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "digest", "n_chars")
    kept = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_chars")
    conversations = known.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return borrowed.union(kept), conversations


def _chain(turns: Column, seed: Column) -> Column:
    """Digests of the prefixes that end at each turn of a block, after that of the prefix before it."""
    step = lambda acc, t: F.concat(acc, F.array(F.unhex(F.sha2(F.concat(F.element_at(acc, -1), t["digest"]), 256))))
    return F.aggregate(turns, F.array(seed), step)


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (the digest one turn before), n_chars of the last turn, ends: a row for every prefix of
    every conversation.  A written table."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "n_chars"))).alias("turns")
    blocks = materialize(turns.groupBy("conv_id", block).agg(listed), "blocks")
    nothing = F.lit(b"")
    # The digest of each block of long conversations, chained from nothing; a block's seed is the digest of those before it.
    long = conversations.where(F.col("n") > BLOCK).select("conv_id")
    sums = blocks.join(long, "conv_id", "left_semi").select("conv_id", "block", F.element_at(_chain(F.col("turns"), nothing), -1).alias("digest"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "digest")))
    chained = sums.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.posexplode(_chain(F.col("turns"), nothing)).alias("at", "seed"))
    chained = materialize(chained.where("at > 0").select("conv_id", F.col("at").cast("long").alias("block"), "seed"), "seeds")
    seeded = blocks.join(chained, ["conv_id", "block"], "left").select("conv_id", "block", "turns", _chain(F.col("turns"), F.coalesce("seed", nothing)).alias("chain"))
    pairs = F.arrays_zip(F.col("turns"), F.slice("chain", 1, F.size("turns")).alias("parent"), F.slice("chain", 2, F.size("turns")).alias("digest"))
    rows = seeded.select("conv_id", F.inline(pairs)).select("conv_id", (F.col("turns.pos") + 1).alias("depth"), "digest", "parent", F.col("turns.n_chars").alias("n_chars"))
    # A block's first parent is the seed; under that of the longest prefix before it, a parent would have another digest.
    rows = materialize(rows, "chains")
    borders = rows.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("digest").alias("before"))
    if not long.isEmpty():
        rows = rows.join(materialize(borders, "borders"), ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("before", "parent")).drop("before")
    root = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), nothing.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_chars"))
    every = root.union(rows.select(root.columns)).join(conversations, "conv_id")
    return materialize(every.select(*root.columns, (F.col("depth") == F.col("n")).alias("ends")), "prefixes")


def _nodes(rows: DataFrame) -> DataFrame:
    """depth, digest, conv_id, n_convs, n_chars, parent, parent_conv_id, n_children.  A written table."""
    found = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"), F.max("parent").alias("parent"))
    found = materialize(found, "nodes")
    above = (F.col("depth") - 1).alias("depth")
    children = materialize(found.where("depth > 0").select(above, F.col("parent").alias("digest")).groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_children")), "children")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = found.join(children, ["depth", "digest"], "left").join(parents, ["depth", "parent"], "left")
    return materialize(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "whole")


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, digest, n_leaves, saved_tokens: sums over each node's subtree."""
    values = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    block = F.floor(F.col("depth") / BLOCK)
    laid = rows.select("conv_id", "depth", "digest").join(values, ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"]).withColumn("block", block)
    laid = materialize(laid, "laid")
    later = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = laid.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    behind = whole.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_behind") for c in ("leaf", "saved")])
    behind = materialize(behind.where("leaf_behind > 0 or saved_behind > 0"), "behind")
    below = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    run = laid.select("conv_id", "block", "depth", "digest", *[F.sum(c).over(below).alias(c) for c in ("leaf", "saved")])
    run = run.join(behind, ["conv_id", "block"], "left").fillna(0, ["leaf_behind", "saved_behind"])
    return run.groupBy("depth", "digest").agg(F.sum(F.col("leaf") + F.col("leaf_behind")).alias("n_leaves"), F.sum(F.col("saved") + F.col("saved_behind")).alias("saved_tokens"))


def listed_digests(ends: DataFrame, piece: int = PIECE, span: int = RANGE) -> DataFrame:
    """depth, digest, ends_sha256: SHA-256 of the ids of the conversations that end at a node, ascending and joined by commas.

    ends: conv_id, depth, digest (a written table: it is counted)."""
    ranges = max(1, -(-ends.count() // span))
    dealt = materialize(ends.repartitionByRange(ranges, "conv_id").withColumn("part", F.spark_partition_id()), "ends")
    ids = dealt.groupBy("part", "depth", "digest").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(piece))
    texts = F.transform(starts, lambda s: F.array_join(F.transform(F.slice("ids", s, piece), lambda i: i.cast("string")), ","))
    pieces = materialize(ids.select("part", "depth", "digest", F.posexplode(texts).alias("sub", "text")), "pieces")
    counted = pieces.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("pieces"), F.first("text").alias("text"))
    counted = materialize(counted, "counted")
    short = counted.where("pieces = 1").select("depth", "digest", F.sha2("text", 256).alias("ends_sha256"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for depth, digest, text in zip(batch["depth"], batch["digest"], batch["text"], strict=True):
                if key != (depth, digest):
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = (depth, digest), hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pd.DataFrame(out, columns=["depth", "digest", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "digest", "ends_sha256"])

    many = pieces.join(counted.where("pieces > 1").select("depth", "digest"), ["depth", "digest"], "left_semi")
    sorted_ = many.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "part", "sub")
    return short.union(sorted_.select("depth", "digest", "text").mapInPandas(run, "depth long, digest binary, ends_sha256 string"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node.  turns: conv_id, pos (from 0, gapless), digest, n_chars; conversations: conv_id, n (its turns)."""
    rows = prefixes(turns, conversations)
    nodes = _nodes(rows)
    ends = listed_digests(materialize(rows.where("ends").select("conv_id", "depth", "digest"), "ended"))
    whole = nodes.join(materialize(subtree_sums(rows, nodes), "sums"), ["depth", "digest"]).join(materialize(ends, "lists"), ["depth", "digest"], "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = turn_digests(conversations)
    return trie(turns, materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "counts"))


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by graft()."""
    turns, counts = graft(turn_digests(conversations))
    return trie(turns, materialize(counts, "counts"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) AS c, b
      FROM range(0, 256) r(b)),
crc AS (SELECT list(c ORDER BY b) AS tab FROM k),
g AS (SELECT c, count(*) AS n, c - ((c % {FAMILY}) + {FAMILY}) % {FAMILY} AS base FROM t GROUP BY c),
i AS (
  SELECT c, n, base, xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda j: ascii(substr(c::VARCHAR, j, 1))::BIGINT),
    lambda s, b: xor(s >> 8, tab[xor(s & 255, b) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT % {LONGEST_GRAFT} AS h
  FROM g, crc),
r AS (
  SELECT i.c, t.pos, role, txt FROM i JOIN t ON t.c = i.base AND t.pos < i.h
  UNION ALL
  SELECT i.c, t.pos - i.h + least(i.h, coalesce(b.n, 0)), role, txt FROM i JOIN t ON t.c = i.c AND t.pos >= i.h LEFT JOIN i AS b ON b.c = i.base),
l AS (SELECT i.c, coalesce(list({{'r': role, 't': txt}} ORDER BY pos) FILTER (role IS NOT NULL), []) AS s FROM i LEFT JOIN r USING (c) GROUP BY i.c),
p AS (SELECT c, d, s[1:d] AS key, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM l)),
n AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(key[d].t) END AS n_chars, CASE WHEN d > 0 THEN key[1:d - 1] END AS parent,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, key),
m AS (
  SELECT n.*, coalesce(x.k, 0) AS n_children, u.conv_id AS parent_conv_id
  FROM n LEFT JOIN (SELECT d - 1 AS d, parent AS key, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL) x ON x.d = n.d AND x.key = n.key
  LEFT JOIN n AS u ON u.d = n.d - 1 AND u.key = n.parent),
s AS (
  SELECT e AS d, key[1:e] AS key, sum((n_convs - 1) * n_chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT conv_id, m.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM m JOIN s ON s.d = m.d AND s.key = m.key"""
