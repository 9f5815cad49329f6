"""Language identification by prediction by partial matching over bytes, statistics frozen.

Each language has a tree of byte contexts up to ORDER bytes long.  A byte seen in a context costs
-log2(count / (total + distinct)) bits; one not seen there costs the escape, -log2(distinct / (total +
distinct)), and is coded in the next shorter context; below the empty context every byte costs eight
bits.  A document's code length under a language is the sum over its bytes, and the language with the
shortest code is predicted.

The trees are learned from a sample of labelled texts of about SAMPLE_BYTES a language and TOTAL_BYTES in all: pieces of PIECE
code points are drawn by hash from all texts alike, and each language's first piece by that hash is always in, so no
label is lost and no long text exceeds the bound.  The counts are made in Spark and only their sums, bounded by the sample, reach
the driver.  Languages stand in models of GROUP each (1 KB a context and 4 bytes a language and gram: four languages of
SAMPLE_BYTES take about 14 MB), scored one after another.  As statistics are frozen, the cost of a byte depends on the
bytes just before it alone, so whole batches are scored by table look-up.

Defined edge cases: null text, and text without a letter, is `und` with score 0; ties go to the
language that sorts first; of more than MOST_LANGUAGES labels those with the most bytes (then the smallest) are learned; texts with equal bytes get equal predictions; repeated rows are predicted one by
one; an empty table, or one without labelled rows, gives `und` everywhere; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ORDER = 3
SAMPLE_BYTES = 400_000
#: Bytes sampled in all; beyond 32 languages each gets an equal share.
TOTAL_BYTES = 32 * SAMPLE_BYTES
#: Code points of a piece of the sample.
PIECE = 1024
#: Labels that are learned, and languages of one model.
MOST_LANGUAGES = 4096
GROUP = 16
#: Longest contexts are kept if they occurred so often in the sample.
LEAST_CONTEXT = 2
FOLDS, HELD_OUT_FOLD = 3, 1
SEED = 11
_PAD = b"\n" * ORDER
_WINDOW = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT_FOLD


def sample(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text: pieces of labelled texts (doc_id, lang, text; none null but doc_id), about sample_bytes a language."""
    pieces = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PIECE).cast("int"))
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    rows = labelled.select("doc_id", "lang", "text", unnamed.alias("own"), pieces.alias("pieces"))

    def place(piece: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", "own", F.octet_length("text"), piece, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)

    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min(F.array_min(F.transform("pieces", place))).alias("least"))
    found = sizes.orderBy(F.desc("bytes"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return labelled.select("lang", "text").limit(0)
    each = min(sample_bytes, TOTAL_BYTES / len(found))
    limits = [(r["lang"], max(r["least"], min(1.0, each / max(1, r["bytes"])))) for r in found]
    wanted = labelled.sparkSession.createDataFrame(limits, "lang string, most double")  # at most MOST_LANGUAGES rows
    drawn = rows.join(F.broadcast(wanted), "lang").select("lang", "text", F.explode(F.filter("pieces", lambda piece: place(piece) <= F.col("most"))).alias("piece"))
    return drawn.select("lang", F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"))


def gram_counts(texts: DataFrame) -> pd.DataFrame:
    """lang, n, gram, count: byte n-grams, n = 1 .. ORDER + 1, as big-endian numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                data = np.frombuffer(b"".join(_PAD + t.encode() for t in part["text"]) + b"\n", "u1").astype("u4")
                for n in range(1, ORDER + 2):
                    gram = np.zeros(len(data) - ORDER, "u4")
                    for k in range(n):
                        gram = gram << np.uint32(8) | data[ORDER - n + 1 + k : len(data) - n + 1 + k]
                    gram, count = np.unique(gram, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.astype("i8"), "count": count})

    counted = texts.where(F.col("text").isNotNull()).mapInPandas(run, "lang string, n int, gram long, count long")
    return counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toPandas()


class Model:
    """Code-length tables.  Level d holds (context of d bytes + byte) keys that some language has seen;
    a key's place at level d is also the number of that context at level d + 1."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        width = len(self.languages)
        column = {x: k for k, x in enumerate(self.languages)}
        self.keys, self.cost, self.escape = [], [], []
        contexts = np.zeros(1, "i8")  # keys of the level below: level 0 has the empty context
        for d in range(ORDER + 1):
            part = counts[counts["n"] == d + 1]
            part = part[np.isin(part["gram"].to_numpy() >> 8, contexts)] if d else part
            keys = np.unique(part["gram"].to_numpy())
            seen = np.zeros((len(keys), width))
            np.add.at(seen, (np.searchsorted(keys, part["gram"].to_numpy()), part["lang"].map(column).to_numpy()), part["count"].to_numpy())
            owner = np.searchsorted(contexts, keys >> 8) if d else np.zeros(len(keys), "i8")
            total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, owner, seen)
            np.add.at(distinct, owner, seen > 0)
            known = total > 0
            scale = np.where(known, total + distinct, 1)
            escape = np.where(known, -np.log2(np.where(known, distinct, 1) / scale), 0.0)
            lower = self.shorter(d, keys)
            p = np.where(seen > 0, seen, 1) / scale[owner]
            self.keys.append(keys)
            self.escape.append(escape.astype("f4"))
            self.cost.append(np.where(seen > 0, -np.log2(p), escape[owner] + lower).astype("f4"))
            if d < ORDER:
                often = seen.sum(axis=1) >= (LEAST_CONTEXT if d + 1 == ORDER else 1)
                contexts = keys[often]
                self.__dict__[f"context{d}"] = np.where(often, np.cumsum(often) - 1, -1).astype("i4")
        self._dense()

    def shorter(self, d: int, keys: np.ndarray) -> np.ndarray:
        """Cost of each key's byte in the context one byte shorter."""
        if d == 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        keys = keys & ((1 << (8 * d)) - 1)
        at = np.searchsorted(self.keys[d - 1], keys)  # a seen key's suffix has been seen
        return self.cost[d - 1][at]

    def _dense(self) -> None:
        """place[d][context * 256 + byte]: the key's place at level d, or -1."""
        self.place = []
        contexts = np.zeros(1, "i8")
        for d in range(ORDER + 1):
            table = np.full(len(contexts) * 256, -1, "i4")
            owner = np.searchsorted(contexts, self.keys[d] >> 8) if d else 0
            table[owner * 256 + (self.keys[d] & 255)] = np.arange(len(self.keys[d]))
            self.place.append(table)
            if d < ORDER:
                contexts = self.keys[d][self.__dict__[f"context{d}"] >= 0]
        self.keys = None

    def code_lengths(self, data: np.ndarray) -> np.ndarray:
        """Bits of data[ORDER:], byte by byte and language by language."""
        at = self.place[0][data]
        cost = np.where((at >= 0)[:, None], self.cost[0][at], self.escape[0][0] + 8.0)
        context = at
        for d in range(1, ORDER + 1):
            context = np.where(context[:-1] >= 0, self.__dict__[f"context{d - 1}"][context[:-1]], -1)
            cost, byte = cost[1:], data[d:]
            known = context >= 0
            at = np.where(known, self.place[d][np.where(known, context, 0) * 256 + byte], -1)
            hit = at >= 0
            escaped = cost + np.where(known[:, None], self.escape[d][np.where(known, context, 0)], 0)
            cost = np.where(hit[:, None], self.cost[d][np.where(hit, at, 0)], escaped)
            context = at
        return cost

    def score(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        k = 0
        while k < len(texts):
            parts, owners, size = [], [], 0
            while k < len(texts) and size < _WINDOW:
                data = np.frombuffer(_PAD + texts[k].encode(), "u1")
                for s in range(0, len(data) - ORDER, _WINDOW):
                    parts.append(data[s : s + _WINDOW + ORDER])
                    owners.append(k)
                    size += len(parts[-1])
                k += 1
            for s in range(0, len(parts), 1 << 12):
                self._add(out, parts[s : s + (1 << 12)], owners[s : s + (1 << 12)])
        return out

    def _add(self, out: np.ndarray, parts: list[np.ndarray], owners: list[int]) -> None:
        group, size = [], 0
        for part, owner in [*zip(parts, owners, strict=True), (None, -1)]:
            if group and (part is None or size + len(part) > 2 * _WINDOW):
                cost = self.code_lengths(np.concatenate([p for p, _ in group]))
                ends = np.cumsum([len(p) for p, _ in group])
                starts = ends - [len(p) for p, _ in group]
                sums = np.vstack((np.zeros(cost.shape[1]), np.cumsum(cost, axis=0, dtype="f8")))
                np.add.at(out, [o for _, o in group], sums[ends - ORDER] - sums[starts])  # the padding is context, never coded
                group, size = [], 0
            if part is not None:
                group.append((part, owner))
                size += len(part)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> list[Model]:
    """Models of GROUP languages each, in order; none without labelled texts."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = gram_counts(sample(labelled.select("doc_id", "lang", "text"), sample_bytes))
    languages = sorted(counts["lang"].unique())
    return [Model(counts[counts["lang"].isin(languages[s : s + GROUP])]) for s in range(0, len(languages), GROUP)]


def _verdicts(models: list[Model], texts: list[str | None], spoken: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    n = len(texts)
    lang, score, per_byte = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
    rows = np.flatnonzero(spoken) if models else []
    if len(rows):
        chosen = [texts[k] for k in rows]
        low, total, name = np.full(len(rows), np.inf), np.zeros(len(rows)), np.full(len(rows), "und", object)
        for model in models:
            bits = model.score(chosen)
            best = bits.argmin(axis=1)
            here = bits[np.arange(len(rows)), best]
            least = np.minimum(low, here)
            total = total * np.exp2(np.maximum(least - low, -1000)) + np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            better = here < low
            name[better] = np.array(model.languages, object)[best[better]]
            low = least
        lang[rows], score[rows] = name, 1 / total
        per_byte[rows] = low / [max(1, len(t.encode())) for t in chosen]
    return lang, score, per_byte


def _spoken() -> Column:
    """Text with a letter; null counts as without."""
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte (null for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score, per_byte = _verdicts(shared.value, batch["text"].tolist(), batch["spoken"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": lang, "score": score, "bits_per_byte": per_byte})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _spoken().alias("spoken"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify_languages(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    return predict(docs, train(docs, sample_bytes))


#: A language that needs as many bits as plain bytes shares nothing with the text: it is in none of the learned languages.
MOST_BITS = 8.0


def drop_unidentified(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """docs without those rejected: `und` (null text, or no letter), or MOST_BITS a byte and more under every language, as a
    script has that no labelled text is in.  Rows pass through their tasks and are never shuffled; repeated rows share
    their verdict, all columns are kept, and without labelled rows every document is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_bytes))
    flag = free_name(docs, "__spoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, per_byte = _verdicts(shared.value, batch["text"].to_pylist(), batch[flag].to_pylist())
            stays = (lang != "und") & ~(per_byte >= MOST_BITS)
            yield batch.filter(pa.array(stays)).drop_columns([flag])

    return docs.withColumn(flag, _spoken()).mapInArrow(run, docs.schema)
