"""Document fingerprints by consistent weighted sampling.

A text's terms are its word 5-grams, weighted by how often they occur.  For each of SAMPLES samples a term
with hash h draws r and c from Gamma(2, 1) and b from U(0, 1), all functions of h and the sample.  With
t = floor(ln(weight) / r + b) its value is ln c - r (t - b + 1), and the sample keeps the (term, t) with the smallest value.
Two texts keep the same pair with probability equal to their generalised Jaccard similarity (sum of the lesser
weights over sum of the greater), so the share of equal samples estimates it without bias.  Gamma variates
come from the inverse distribution function at 2**16 points; a sample is stored as 16 bits of a hash of its pair.

`fingerprint_edits` also fingerprints each text with its last half replaced by the start of the next
document.  Texts move once, range-partitioned by doc_id; inside a partition each row meets its successor
in a stream, and the seams between partitions (one row each) are joined afterwards.

Defined edge cases: null text is the empty text; texts with the same words, those without any included,
have equal fingerprints; a text of fewer than five words is one term; documents of equal doc_id follow one
another by hash of text and a null doc_id comes last; with one document the next document is itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHINGLE = 5
SAMPLES = 64
SEED = 5
_CHUNK = 1024
_WORDS_KEPT = 1 << 20


@functools.lru_cache(maxsize=1)
def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), F(x) = 1 - (1 + x) exp(-x), at the middle of 2**16 equal steps."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(u), np.full_like(u, 32.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@functools.lru_cache(maxsize=1)
def _tables(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gamma = _gamma_quantiles()
    odd = np.random.default_rng(seed).integers(0, 1 << 63, samples, dtype="u8") * np.uint64(2) + np.uint64(1)
    return gamma.astype("f4"), np.log(gamma).astype("f4"), odd


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_hashes = _WordHashes()


def terms(words: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams, and how often each occurs."""
    h = np.fromiter(map(_hashes.__getitem__, words), "u8", len(words))
    n = min(shingle, len(words))
    total = np.full(max(1, len(words) - n + 1), n, "u8")
    for k in range(n):
        total = (total + h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    found, weight = np.unique(_mix(total), return_counts=True)
    return found, weight


def signature(text: str, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """16 bits for each sample."""
    gamma, log_gamma, odd = _tables(samples, seed)
    found, weight = terms(text.encode().split())  # ASCII white space only
    best, pick, level = np.full(samples, np.inf, "f4"), np.zeros(samples, "u8"), np.zeros(samples, "f4")
    column = np.arange(samples)
    for s in range(0, len(found), _CHUNK):
        h, w = found[s : s + _CHUNK], weight[s : s + _CHUNK]
        bits = (h[:, None] * odd).view("<u2").reshape(len(h), samples, 4)
        r, log_c = gamma[bits[..., 3]], log_gamma[bits[..., 2]]
        b = bits[..., 1].astype("f4") * np.float32(2.0**-16)
        value = log_c - r * (1 - b)
        many = np.flatnonzero(w > 1)
        if len(many):
            t = np.floor(np.log(w[many])[:, None].astype("f4") / r[many] + b[many])
            value[many] -= r[many] * t
        row = value.argmin(axis=0)
        least = value[row, column]
        better = least < best
        best[better], pick[better] = least[better], h[row][better]
        t = np.floor(np.log(w[row]).astype("f4") / r[row, column] + b[row, column])
        level[better] = t[better]
    return (_mix(pick + level.astype("i8").astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = [signature(t or "").tobytes().hex() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": prints})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string")


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else signature(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (doc_id, len(text), digest, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, next_own))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                own = signature(text)
                if before is None:
                    out.append((*[None] * 7, part, "first", doc_id, text))
                else:
                    out.append((*_compared(*before, text, own), part, "whole", None, None))
                before = (doc_id, text, own)
            yield frame(out)
        if before is not None:
            yield frame([(*[None] * 7, part, "last", before[0], before[1])])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*_COLUMNS, "part", "kind", "edge_id", "edge_text"]).astype({"doc_id": "Int64", "n_chars": "Int64", "edge_id": "Int64"})

    found = materialize(rows.mapInPandas(run, f"{_RESULT}, part int, kind string, edge_id long, edge_text string"), "edits")
    first, last = (found.where(F.col("kind") == k).select("part", F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text")) for k in ("first", "last"))
    parts = first.select("part")  # a row for each partition
    after = F.lead("part").over(W.orderBy("part"))
    least = F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    follows = parts.select("part", F.coalesce(after, least).alias("next_part"))
    seams = last.join(follows, "part").join(first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")

    def seam(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if x is None or x != x else int(x) for x in batch["doc_id"].tolist()]
            out = [_compared(d, t, signature(t), n, signature(n)) for d, t, n in zip(ids, batch["text"], batch["next_text"], strict=True)]
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})

    joined = seams.select("doc_id", "text", "next_text").mapInPandas(seam, _RESULT)
    return found.where(F.col("kind") == "whole").select(*_COLUMNS).union(joined)
