"""Edit-aware token counts: a segment tree over pre-tokens for each document.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its pre-tokens.  The text of a special
token is a pre-token of one id, as the encoder of `op1` has it; what lies between two is split by the vocabulary's pattern.
Leaves hold runs of pre-tokens with their lengths in code points and tokens; inner nodes hold sums.  An edit
re-splits the text from the last pre-token boundary that the edit can't have moved (the pattern looks at most two
code points past a pre-token's end, and a special token that the edit makes or breaks starts at most its length before) until a new boundary falls on an old one past the edit: from there on
the old pre-tokens hold.  Only pre-tokens of that region are encoded, and the sums on the paths from the touched
leaves to the root are updated.  A leaf that grows beyond 2 LEAF pre-tokens is split, and the sums over the leaves are made
anew (one addition a leaf; nothing is encoded), so many edits at one place don't degrade the tree.

Defined edge cases: null text is the empty text with 0 tokens; edits outside the text are clipped to it; repeated
rows are counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .tokens import default_paths, encoder, special_texts

#: Pre-tokens of a leaf when a tree is built.
LEAF = 32
_KEPT = 1 << 19
_LOOK_AHEAD = 2


@functools.lru_cache(maxsize=1)
def splitter():
    """The vocabulary's pattern, with white space in the sense of Unicode."""
    import public_tokenizers
    import regex

    pattern = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(pattern)


@functools.lru_cache(maxsize=4)
def special_pattern(texts: tuple[str, ...]):
    """Finds special tokens, the longest of those that start at one place."""
    import regex

    return regex.compile("|".join(regex.escape(t) for t in sorted(texts, key=len, reverse=True)))


def pre_tokens(text: str, place: int, specials: tuple[str, ...]) -> Iterator[str]:
    """Pre-tokens from a boundary on, found as they are asked for."""
    while place < len(text):
        special = special_pattern(specials).search(text, place) if specials else None
        for piece in splitter().finditer(text, place, special.start() if special else len(text)):
            yield piece[0]
        if not special:
            return
        yield special[0]
        place = special.end()


class PieceCounts(dict):
    """Tokens of a pre-token; at most _KEPT are kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


class TokenTree:
    """Token count of a text under edits.  specials: texts that are one id each (counts must have them so)."""

    def __init__(self, text: str, counts: PieceCounts, specials: tuple[str, ...] = ()):
        self.counts, self.text, self.encoded, self.specials = counts, text, 0, specials
        self.look_ahead = _LOOK_AHEAD + max((len(t) - 1 for t in specials), default=0)
        pieces = list(pre_tokens(text, 0, specials))
        self._build([(len(p), counts[p]) for p in pieces[s : s + LEAF]] for s in range(0, len(pieces), LEAF))

    def _build(self, leaves) -> None:
        self.leaves = [leaf for leaf in leaves if leaf] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum(k)
        for k in range(self.size - 1, 0, -1):
            self._up(k)

    def _sum(self, leaf: int) -> None:
        rows = self.leaves[leaf]
        self.chars[self.size + leaf], self.tokens[self.size + leaf] = sum(r[0] for r in rows), sum(r[1] for r in rows)

    def _up(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds code point at, and the leaf's start."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start, k = start + self.chars[k], k + 1
        return k - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace code points start to end by new."""
        n = len(self.text)
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - n
        first, at = self._find(max(0, start - self.look_ahead - 1))
        keep = 0  # pre-tokens of the first leaf that the edit can't change
        rows = self.leaves[first]
        while keep < len(rows) and at + rows[keep][0] + self.look_ahead <= start:
            at += rows[keep][0]
            keep += 1
        old, leaf, k = at, first, keep  # boundary in the old text, and the old pre-token that starts there
        fresh: list[tuple[int, int]] = []
        place, ahead = at, pre_tokens(text, at, self.specials)
        while True:
            while old < end or old + shift < place:  # the first old boundary that could match
                while leaf < len(self.leaves) and k >= len(self.leaves[leaf]):
                    leaf, k = leaf + 1, 0
                if leaf == len(self.leaves):
                    break
                old += self.leaves[leaf][k][0]
                k += 1
            if old >= end and old + shift == place:
                break
            piece = next(ahead, None)
            if piece is None:
                break
            fresh.append((len(piece), self.counts[piece]))
            self.encoded += len(piece)
            place += len(piece)
        last = min(leaf, len(self.leaves) - 1)
        rest = self.leaves[last][k:] if leaf == last else []
        self.leaves[first] = self.leaves[first][:keep] + fresh + rest
        for j in range(first + 1, last + 1):
            self.leaves[j] = []
        self.text = text
        grown = self.leaves[first]
        if len(grown) > 2 * LEAF:
            self._build([*self.leaves[:first], *(grown[s : s + LEAF] for s in range(0, len(grown), LEAF)), *self.leaves[first + 1 :]])
            return
        for j in range(first, last + 1):
            self._sum(j)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for j in range(low, high + 1):
                self._up(j)
            low, high = low // 2, high // 2


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, one after another: a deletion, an insertion and a replacement."""
    n = len(text)
    return [(n // 4, n // 4 + min(20, n // 20), ""), (n // 2, n // 2, " re-counted after 1 edit"), (3 * n // 4, 3 * n // 4 + min(12, n // 8), text[:9])]


def count_tokens(docs: DataFrame, edits=sample_edits, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens of the text, then after all edits n_chars_edited,
    n_tokens_edited, and reencoded, the code points that were encoded for them."""
    paths = paths or default_paths()
    columns = ["doc_id", "n_chars", "n_tokens", "n_chars_edited", "n_tokens_edited", "reencoded"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, specials = PieceCounts(encoder(*paths, special=True)), tuple(special_texts(paths[0]))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                text = text or ""
                tree = TokenTree(text, counts, specials)
                before = tree.total()
                for edit in edits(text):
                    tree.edit(*edit)
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                out.append((doc_id, len(text), before, len(tree.text), tree.total(), tree.encoded))
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_chars long, n_tokens long, n_chars_edited long, n_tokens_edited long, reencoded long")
