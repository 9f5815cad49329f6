"""Main text of web pages by consensus on host paths.

1. Every page's containers are scored inside a task: the text in block elements weighs for its length, links weigh
   against, and what stands in a marked subtree (a class, id or role that names a boilerplate part) does not count for
   the containers around it.  A container that is marked itself, or stands in a marked one, only loses most of its
   score.  A container is named by its generalised path: tag and classes from the body down, digits taken out.
2. Spark sums the scores for each (host, path); the path with the most votes wins its host.  Each page sends its best
   few containers, summed map-side, so a host with a third of all pages costs one row a task.  Text is never dropped
   for standing on other pages too: bylines, series titles and closing lines repeat on a host and belong to the article.
3. Every page is extracted again from the containers on its host's winning path, or from its own best container
   where the page has none of them; each is widened to its parent while that adds text rather than links, so that
   titles, leads and sibling sections stay.  Marks around the chosen container don't count; marked subtrees in it go.

White space inside a block becomes one space; blocks are joined by a newline in page order.  Character
references are decoded once.  Broken markup is taken as it comes: quotes count in attribute values only, an open
paragraph ends at the next block, unclosed elements end with the page, and raw text elements end only at their own end tag.

Defined edge cases: null html is the empty page, whose text is empty; a page whose text is all in marked subtrees keeps
it; a page whose url is null or has no host votes under the empty host; repeated rows are extracted one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Containers that a page votes for.
VOTES = 3
#: Bytes of hosts and paths up to which they are broadcast; more are joined by host, where adaptive execution splits a
#: host's pages over tasks.
BROADCAST_BYTES = 32 << 20
#: What a marked container keeps of its score.
MARKED = 0.2

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div form main section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose subtree is never main text.
SKIP = frozenset("head nav aside footer button select input option label menu dialog svg canvas object audio video".split()) | RAW
#: Words that mark a subtree as no main text where they are the noun of a class, id or role: cookie-notice, comment-list.
MARKERS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs colophon comment comments complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion recommended related replies respond responses share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar".split()
)
#: The markers that count on elements inside a line as well.
ADVERTS = frozenset("ad ads advert advertisement adverts advertising promo promoted sponsor sponsored".split())
#: Words before any noun that say the same: related-posts.
BESIDE = frozenset("promoted recommended related sponsored".split())
#: Words behind the noun.
PARTS = frozenset(
    "area bar block body bottom box button buttons container content entry form group holder inner item items left link links list "
    "main module outer panel right row section slot text thread title top unit wrap wrapper".split()
)
#: A class that starts so tells of the layout: no-sidebar, content-sidebar-wrap.
LAYOUT = frozenset("no not without has with is content".split())
_CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_VALUE = r"""(?>"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SAME_LIST = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_END = {tag: re.compile(f"</{tag}[\\s/>]", re.I) for tag in RAW}


def _named(attributes: str) -> dict[str, str]:
    """class, id and role of a tag; the first of a name counts."""
    out: dict[str, str] = {}
    if "=" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role") and name not in out:
                out[name] = value[1:-1] if value[:1] in "\"'" and len(value) > 1 and value[0] == value[-1] else value
    return out


@functools.lru_cache(maxsize=1 << 14)
def nouns(names: str) -> frozenset[str]:
    """The noun of each name: its last word, but for words that only tell which part of the thing it is."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        if words and (len(words) == 1 or words[0] not in LAYOUT):
            found.add(words[0] if words[0] in BESIDE else words[-1])
    return frozenset(found)


class Page:
    """Blocks of a page in order, each with the containers it stands in; container 0 is the page."""

    def __init__(self, source: str):
        self.paths, self.parents, self.marked = [""], [-1], [False]  # of the containers
        self.headers: list[list] = []  # container, whether a heading is in it
        self.blocks: list[tuple[int, bool, str, int, int, str]] = []  # container, marked below it, text, characters in links, header, path
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple] = []  # tag and the state outside it
        container, hard, marked, muted, path, header = 0, False, False, False, "", -1
        words: list[str] = []
        links = linked = 0

        def flush():
            nonlocal words, linked
            if words:
                text = " ".join(html.unescape("".join(words)).split())
                if text and not hard:
                    self.blocks.append((container, marked, text, linked, header, path))
            words, linked = [], 0

        def leave(k):
            nonlocal container, hard, marked, muted, path, header, links
            for tag, *_ in stack[k:]:
                links -= tag == "a"
            _, container, hard, marked, muted, path, header = stack[k]
            del stack[k:]

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else end]
            if piece and not muted:
                words.append(piece)
                linked += len(piece) if links else 0
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag == "br":
                words.append("\n")
                continue
            if m[1]:
                if tag in BLOCK:
                    flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        leave(k)
                        break
                    if tag not in BLOCK and stack[k][0] in BLOCK:
                        break
                continue
            if tag in BLOCK:
                flush()
                if tag in _CLOSES_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            leave(k)
                            break
                        if stack[k][0] in CONTAINER:
                            break
                for k in range(len(stack) - 1, -1, -1) if tag in _SAME_LIST else ():
                    if stack[k][0] in _SAME_LIST[tag]:
                        leave(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            if tag in RAW:
                close = _END[tag].search(source, at)
                if close:
                    gt = source.find(">", close.start())
                    at = gt + 1 if gt >= 0 else end
                else:
                    at = end
                continue
            if tag in VOID:
                continue
            named = _named(m[3])
            stack.append((tag, container, hard, marked, muted, path, header))
            links += tag == "a"
            if tag not in BLOCK:
                muted = muted or tag in SKIP or any(ADVERTS & nouns(v) for v in named.values())
                continue
            classes = sorted(set(re.sub(r"\d+", "#", named.get("class", "").lower()).split()))
            path = f"{path}/{'.'.join([tag, *classes])}"
            if tag in ("html", "body"):  # their classes and ids tell of the layout
                hard = False
            else:
                named_for = frozenset().union(*map(nouns, named.values()))
                hard = hard or tag in SKIP
                mark = tag == "form" or bool(MARKERS & named_for)
                if header < 0 and tag not in ("article", "main") and (tag == "header" or "header" in named_for):
                    self.headers.append([container, False])
                    header = len(self.headers) - 1
                if header >= 0 and tag in HEADING:
                    self.headers[header][1] = True
                marked = marked or mark
            if tag in CONTAINER:
                self.paths.append(path)
                self.parents.append(container)
                self.marked.append(marked)
                container, marked = len(self.paths) - 1, False
        flush()

    def _tag(self, c: int) -> str:
        return self.paths[c].rsplit("/", 1)[-1].split(".")[0]

    def _whole(self, c: int) -> bool:
        return self._tag(c) in ("", "html", "body")

    def scores(self) -> dict[int, float]:
        """Score of each container: its own blocks count whole, a nested container's count by two thirds a level, and
        not where a mark is between; semantic elements count more."""
        out: dict[int, float] = {}
        for c, marked, text, linked, header, _ in self.blocks:
            if marked or header >= 0:
                continue
            value = max(0.0, len(text) - 1.5 * linked) ** 0.9 + 8 * (text.count(",") + text.count("."))
            while c >= 0:
                out[c] = out.get(c, 0.0) + value
                if self.marked[c]:
                    break
                c, value = self.parents[c], value * 2 / 3
        for c in out:
            tag = self._tag(c)
            out[c] *= {"article": 1.5, "main": 1.3}.get(tag, 1.0)
            if self.marked[c] or (tag not in ("article", "main") and self._below_mark(c)):
                out[c] *= MARKED
        return out

    def _below_mark(self, c: int) -> bool:
        while (c := self.parents[c]) >= 0:
            if self.marked[c]:
                return True
        return False

    def _inside(self, roots: set[int]) -> list[bool]:
        """Of each container, whether it is in roots or stands in one with no mark between."""
        out: list[bool] = []
        for c, parent in enumerate(self.parents):  # parents come first
            out.append(c in roots or (parent >= 0 and out[parent] and not self.marked[c]))
        return out

    def _climbed(self, c: int) -> tuple[int, set[int]]:
        """c, or the highest container around it that is reached while what each parent adds is no more than is there,
        and text or headings rather than links; and the headers that came with it: of those with a heading the nearest, if
        there was no heading before.  An article or main is whole, and the body is not climbed to."""
        best, headers, new = c, set(), set()
        while not self.marked[c] and self._tag(c) not in ("article", "main") and (parent := self.parents[c]) >= 0 and not self._whole(parent):
            inner, outer = self._inside({c}), self._inside({parent})
            here = [row for row in self.blocks if outer[row[0]] and not row[1]]
            titled = new or any(inner[at] and (header < 0 or inner[self.headers[header][0]]) and self._heading(path) for at, _, _, _, header, path in here)
            new = set() if titled else {h for at, _, _, _, h, _ in here if h >= 0 and not inner[at] and self.headers[h][1]}
            size = links = there = 0
            for at, _, text, linked, header, _ in here:
                if inner[at]:
                    there += len(text)
                elif header < 0 or header in new:
                    size, links = size + len(text), links + linked
            if size and (size <= 1.5 * links or size > there):
                break
            c = parent
            if size:
                best, headers = c, headers | new
        return best, headers

    @staticmethod
    def _heading(path: str) -> bool:
        return path.rsplit("/", 1)[-1].split(".")[0] in HEADING

    def roots(self, path: str | None) -> set[int]:
        """Containers on path that hold more than links, those outside of marks if there are any; else the best container."""
        found = {c for c, p in enumerate(self.paths) if p == path}
        found = {c for c in found if not self._below_mark(c)} or found
        scores = self.scores() if len(found) != 1 else {}
        if len(found) > 1:
            found = {c for c in found if scores.get(c, 0.0) > 0} or found
        held = self._inside(found)
        if not any(held[c] and not marked for c, marked, *_ in self.blocks):
            scores = scores or self.scores()
            found = {max(scores, key=lambda c: (scores[c], -c))} if scores else set()
        return found

    def text(self, path: str | None) -> str:
        """Blocks under the containers on path, or under the best container.

        A header counts where it stands inside such a container (it then holds the title), unless that is the body."""
        roots = self.roots(path)
        climbed = [self._climbed(c) for c in roots]
        first, wide = self._inside(roots), self._inside({c for c, _ in climbed})
        titles = set().union(*(headers for _, headers in climbed))

        def stays(header: int) -> bool:
            return header < 0 or header in titles or (first[self.headers[header][0]] and not self._whole(self.headers[header][0]))

        kept = [t for c, marked, t, _, h, _ in self.blocks if wide[c] and not marked and stays(h)]
        return "\n".join(kept or [t for c, _, t, *_ in self.blocks if wide[c] or not roots])


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_votes(pages: DataFrame) -> DataFrame:
    """host, path, score: what the pages of a task give each path, a page's best container 1 and others by their share of its score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes: dict[tuple, float] = {}
            for url, source in zip(batch["url"], batch["html"], strict=True):
                page, host = Page(source or ""), _host(url)
                found: dict[str, float] = {}
                for c, score in page.scores().items():
                    found[page.paths[c]] = max(score, found.get(page.paths[c], 0.0))
                most = max(found.values(), default=0.0)
                for path in sorted(filter(found.get, found), key=lambda p: (-found[p], p))[:VOTES]:
                    votes[host, path] = votes.get((host, path), 0.0) + found[path] / most
            yield pd.DataFrame([(*k, v) for k, v in votes.items()], columns=["host", "path", "score"]).astype({"score": "f8"})

    return pages.select("url", "html").mapInPandas(run, "host string, path string, score double")


def consensus(votes: DataFrame) -> DataFrame:
    """host, path: the path with the most votes on each host (ties go to the longer, then the smaller path)."""
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    order = F.struct("score", F.length("path").alias("n"), F.col("path").alias("path"))
    return sums.groupBy("host").agg(F.max(order).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    found = materialize(consensus(page_votes(pages)), "consensus")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for source, path in zip(batch["html"], batch["path"], strict=True):
                texts.append(Page(source or "").text(path))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("page_id", "url", "html", "path").mapInPandas(run, "page_id long, url string, text string, n_chars long")
