"""The trigram index gives the rows of a substring search, and reads few parts."""

import random

from pyspark.sql import functions as F

from tonegraph.operators import cleaning, text_index
from tonegraph.operators.text_index import TextIndex

LETTERS = "aAbBcé%_.*\\ßİ漢🎵 "


def test_rows_are_those_of_contains(spark, monkeypatch):
    """Queries of 1 to 20 code points, wildcards and non-ASCII; frequent grams dealt over parts, few and many candidates."""
    draw = random.Random(3)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "ab", "the same"] + ["the same"] * 200)]
    df = spark.createDataFrame(rows, "id long, title string").withColumn("gram", F.lit("stranger"))
    ways = set()
    for part_rows, pushed in ((50, 2), (1_000_000, 2_000)):
        monkeypatch.setattr(text_index, "PART_ROWS", part_rows)
        monkeypatch.setattr(text_index, "PUSHED", pushed)
        index = TextIndex(df, "title", "id")
        for n in (1, 2, 3, 4, 6, 9, 20):
            text = draw.choice([t for t in texts if len(t) >= n])
            at = draw.randint(0, len(text) - n)
            for wanted in (text[at : at + n], text[at : at + n].swapcase(), "THE Sam"):
                found, report = index.search(wanted)
                expected = df.where(F.contains(F.upper("title"), F.upper(F.lit(wanted))))
                assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str), wanted
                assert report.parts_read <= max(4, report.parts // 2) or part_rows == 50
                ways.add(report.way)
    assert ways == {"index", "scan"}
    found, report = index.search("no such text")
    assert found.isEmpty() and report == text_index.Report("index", 0, index.parts, 0)


def test_an_empty_table(spark):
    index = TextIndex(spark.createDataFrame([], "id long, title string"), "title", "id")
    assert index.search("abc")[0].isEmpty() and index.search("a")[0].isEmpty()


def test_same_as_the_plain_search(spark, small):
    parts = spark.read.parquet(f"{small}/part.parquet").selectExpr("p_partkey AS id", "p_name AS title")
    found, report = TextIndex(parts, "title", "id").search("red")
    assert {r.id for r in found.collect()} == {r.id for r in cleaning.search(parts, "red", "title", None, "id").collect()}
