"""The prefix trie, phrase mining and decontamination against plain Python, on odd and hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tonegraph.llm import decontamination, phrases, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
STRANGERS = ["pos", "depth", "digest", "parent", "block", "row", "n", "h", "base", "seg", "m", "mark", "words", "row_id", "body", "gram", "lang_", "a", "l", "r", "salt"]


def strange(frame):
    return frame.withColumns({c: F.lit("stranger") for c in STRANGERS if c not in frame.columns})


# -------------------------------------------------------------- trie


def plain_trie(rows, grafted=True):
    """conv_id -> turns, and every node's row, by definition."""
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by_conv[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in by_conv.items()}
    if grafted:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), Counter()
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for k in members:
        children[k[:-1]] += bool(k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for e in range(len(k) + 1):
            leaves[k[:e]] += not children[k]
            saved[k[:e]] += (len(v) - 1) * (len(k[-1][1]) if k else 0)
    listed = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(v), len(k), min(members[k[:-1]]) if k else -1, len(v), children[k], leaves[k], saved[k], listed(k)) for k, v in members.items())


def found_trie(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in frame.collect())


def conversations(seed, n=60, most=9, words=3):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice("abc"[:words]) * rng.randint(1, 2)))
    return rows


ODD_TURNS = [
    (0, 0, "user", "hello"), (0, 1, None, None), (0, 1, None, None), (0, None, "system", "first"), (0, 2, "user", "é漢🎉"), (0, 3, "a", ""), (0, 4, "", "a"),
    (1, 0, "user", "hello"), (7, None, None, None), (107, 0, "x", "y"), (205, 0, "x", "y"), (205, 0, "x", "z"), (None, 0, "user", "nobody"), (300, 5, "user", "long" * 50_000),
]


@pytest.mark.parametrize("grafted", [True, False])
def test_trie_of_odd_conversations(spark, grafted):
    frame = strange(spark.createDataFrame(ODD_TURNS, TURNS))
    make = prefix_trie.grafted_trie if grafted else prefix_trie.conversation_trie
    assert found_trie(make(frame)) == plain_trie(ODD_TURNS, grafted)
    assert make(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("block", "piece", "span"), [(256, 1000, 200_000), (2, 2, 10), (3, 1, 1000)])
def test_trie_of_blocks_and_pieces(spark, monkeypatch, block, piece, span):
    """Chains and sums that run over blocks, and lists of ids that are hashed piece by piece."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie.listed_digests, "__defaults__", (piece, span))
    rows = conversations(block) + [(1000 + c, t, "user", "same") for c in range(30) for t in range(3)]
    rows += [(2000 + c, t, "user", f"deep {t}") for c in range(2) for t in range(40 + c)]
    assert found_trie(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == plain_trie(rows, grafted=False)


def test_a_long_conversation_makes_a_row_for_each_prefix(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(700)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).orderBy("depth").collect()
    assert [r.depth for r in found] == list(range(701)) and {r.n_leaves for r in found} == {1}
    assert found[0].saved_tokens == sum(len(str(t)) for t in range(700)) and found[-1].saved_tokens == 3


# -------------------------------------------------------------- phrases


def plain_phrases(rows, least, longest=5, absorb=100):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in frequent.items():
            for m in range(2, len(g)):
                gone |= {g[i : i + m] for i in range(len(g) - m + 1) if 100 * a >= absorb * counts[g[i : i + m]]}
        for g, a in frequent.items():
            if g not in gone:
                score, cut = min((1000 * a * total[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                out.append((lang, " ".join(g), a, counts[g[:cut]], counts[g[cut:]], total[lang], score))
    return sorted(out)


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "Of", "AND", "x", "é", "ünï", "new", "york", "\x1fodd", "zero\x00", "nb sp"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words[: rng.randint(3, 11)]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "!"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "buffer"), [(1 << 20, 1_200_000), (7, 30), (40, 1)])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk, buffer):
    """Whatever the chunks of a text and the words counted at once."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "BUFFER", buffer)
    rows = [*texts(chunk), (None, None), ("en", ""), ("en", " \t\n.,"), ("fr", "la la la la la la la la la la la la")]
    frame = strange(spark.createDataFrame(rows, "lang string, text string"))
    got = phrases.collocations(frame, least=5)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, 5)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Grams that the bitmap lets through by chance fall at the threshold."""
    rows = texts(3)
    frame = spark.createDataFrame(rows, "lang string, text string")
    import numpy as np

    monkeypatch.setattr(phrases, "_bits", lambda level: np.full(8, 255, np.uint8))
    got = phrases.collocations(frame, least=4, absorb=80)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, 4, absorb=80)


def test_top_phrases_of_each_language(spark):
    rows = [("en", "one two three. " * 150), ("en", "four five, " * 120), (None, "six seven\n" * 100), ("de", "eins zwei " * 99)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in phrases.top_phrases(frame, 1).select("lang", "rank", "phrase", "a").orderBy("lang").collect()]
    assert got == [("en", 1, "four five", 120), ("und", 1, "six seven", 100)]
    assert phrases.top_phrases(frame.limit(0)).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    big = 3 * 10**9
    one = spark.createDataFrame([("en", None, 10**13), ("en", "a", big), ("en", "b", big + 1)], "lang string, gram string, n long")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, gram string, n long")
    r = phrases.score_cuts([one, two]).first()
    assert r.score == 1000 * (big - 1) * 10**13 // (big * (big + 1))


# -------------------------------------------------------------- decontamination


def plain_leaks(docs, items, window=10):
    split = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows[tuple(w[i : i + m])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def found_leaks(spark, docs, items):
    d = strange(spark.createDataFrame(docs, "doc_id long, text string"))
    b = strange(spark.createDataFrame(items, "item_id long, text string"))
    rows = decontamination.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in rows)


def passages(seed):
    """Items of 1 to 40 words, documents that hold whole, cut, doubled and overlapping pieces of them."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ä", "ß9", "漢字", "x"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([10, 11, 15, 25, 40, 12, 9, 7, 3, 1][: 6 if seed % 2 else 10])))) for k in range(12)]
    docs = []
    for k in range(40):
        parts = []
        for _ in range(rng.randint(0, 12)):
            item = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(item))
            piece = item[a : a + rng.randint(5, 30)] if rng.random() < 0.7 else rng.choices(words, k=rng.randint(1, 40))
            parts.append(rng.choice([" ", ", ", "--", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in piece))
        docs.append((k, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_every_window_is_found(spark, seed):
    docs, items = passages(seed)
    assert found_leaks(spark, docs, items) == plain_leaks(docs, items)


@pytest.mark.parametrize("n", [255, 256, 257, 265, 266, 511, 530, 3000])
def test_passages_over_segment_borders(spark, n):
    text = " ".join(f"v{k}" for k in range(n))
    items = [(k, " ".join(f"v{j}" for j in range(k, min(k + 12, n)))) for k in range(230, n, 9)]
    docs = [(0, text), (1, f"x {text}"), (2, f"{text} {text}")]
    assert found_leaks(spark, docs, items) == plain_leaks(docs, items)


ODD_DOCS = [(1, None), (2, ""), (3, " .,-\t"), (4, "the the the the " * 500), (4, "the the the the " * 500), (None, "Ünïcödé 漢字 🎉"), (5, "a" * 100_000), (6, "one two three")]


def test_odd_documents_and_items(spark):
    items = [(1, None), (2, ""), (3, "!!!"), (4, "the " * 30), (4, "THE the the"), (None, "🎉"), (7, "one two three"), (7, "one two three"), (10, "one two three")]
    assert found_leaks(spark, ODD_DOCS, items) == plain_leaks(ODD_DOCS, items)
    assert found_leaks(spark, ODD_DOCS, items[:3]) == plain_leaks(ODD_DOCS, items[:3])
    assert found_leaks(spark, [], items) == [] and found_leaks(spark, ODD_DOCS, []) == plain_leaks(ODD_DOCS, [])


def test_spans_and_clean_documents(spark):
    items = spark.createDataFrame([(1, " ".join(f"v{k}" for k in range(20)))], "item_id long, text string")
    words = [f"u{k}" for k in range(30)]
    words[5:17] = [f"v{k}" for k in range(3, 15)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing here"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontamination.contaminated_spans(docs.where("doc_id = 1"), items).collect()}
    assert [tuple(s) for s in found[1].spans] == [(5, 17)] and found[1].items == ["1"]
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [2, 2]


def test_no_python_runs_in_decontamination(spark, small):
    """A native operator: its tasks evaluate expressions only."""
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    import inspect

    source = inspect.getsource(decontamination)
    assert not re.search(r"mapIn|applyIn|udf|\.rdd|toPandas|foreach", source)
    assert decontamination.decontaminate(docs, items).where("contaminated").count() > 0
