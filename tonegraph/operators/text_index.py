"""Substring search by a trigram index: posting lists of folded trigrams, the rarest of a query read first, each hit verified."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import work_path

#: Code points of a gram, postings of a part, grams of a query that are read, and candidates that are looked up as a pushed-down filter.
GRAM = 3
PART_ROWS = 1_000_000
GRAMS_READ = 3
PUSHED = 2_000
#: A query whose rarest gram stands in more than this share of the texts reads the texts instead.
WORTH = 0.1
#: Grams of more than PART_ROWS texts that are broadcast at most.
SMALL = 1_000_000


@dataclass(frozen=True)
class Report:
    """How a search was run: by "index" or "scan", the parts of the postings read of all, and the candidates that were verified."""

    way: str
    parts_read: int
    parts: int
    candidates: int


class TextIndex:
    """An index of one text column, for searches that ignore case as cleaning.search does (upper forms are compared).

    texts: the table that is searched; name: its text column; key: its id column (unique; not null).  Null texts match
    nothing.  The postings lie in parts by gram; a gram of more than PART_ROWS texts is dealt over parts of its own number, so
    neither a task nor a part holds a frequent gram alone.  Three tables are written to the shared folder: texts sorted by key, the grams with
    their counts, and the postings."""

    def __init__(self, texts: DataFrame, name: str, key: str):
        self.name, self.key = name, key
        self.spark = texts.sparkSession
        folder = work_path(self.spark, "text-index")
        texts.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{folder}/texts")
        self.texts = self.spark.read.schema(texts.schema).parquet(f"{folder}/texts")
        self.rows = self.texts.count()
        folded = self.texts.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.upper(name).alias("text"))
        starts = F.sequence(F.lit(1), F.char_length("text") - (GRAM - 1))
        cut = F.when(F.char_length("text") >= GRAM, F.array_distinct(F.transform(starts, lambda at: F.substr("text", at, F.lit(GRAM)))))
        postings = folded.select("key", F.explode(cut).alias("gram"))
        postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
        self.grams = self.spark.read.schema("gram string, n long").parquet(f"{folder}/grams")
        self.parts = max(16, -(-int(self.grams.agg(F.sum("n")).first()[0] or 0) // PART_ROWS))
        wide = self.grams.where(F.col("n") > PART_ROWS)  # at most all postings / PART_ROWS, so as few as parts
        dealt = postings.join(F.broadcast(wide) if self.parts <= SMALL else wide, "gram", "left")
        dealt = dealt.withColumn("part", self._part(F.col("gram"), F.pmod(F.xxhash64("key"), self._spread(F.coalesce("n", F.lit(0))))))
        dealt.select("gram", "key", "part").repartition(self.parts, "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{folder}/postings")
        kind = dict(self.texts.dtypes)[key]
        self.postings = self.spark.read.schema(f"gram string, key {kind}, part int").parquet(f"{folder}/postings")

    @staticmethod
    def _spread(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / PART_ROWS)).cast("long")

    def _part(self, gram: Column, salt: Column) -> Column:
        return F.pmod(F.xxhash64(gram) + salt, F.lit(self.parts)).cast("int")

    def _contains(self, text: str) -> Column:
        return F.contains(F.upper(self.name), F.upper(F.lit(text)))

    def search(self, text: str) -> tuple[DataFrame, Report]:
        """The rows whose text contains `text`, whatever the case, and how they were found.

        Texts of fewer than three code points, and those of frequent grams alone, are found by reading all texts.  A gram that
        no text has settles the search without reading any posting."""
        wanted = self.spark.range(1).select(F.upper(F.lit(text))).first()[0]
        grams = sorted({wanted[k : k + GRAM] for k in range(len(wanted) - GRAM + 1)})
        if not grams:
            return self.texts.where(self._contains(text)), Report("scan", 0, self.parts, self.rows)
        counts = {r.gram: r.n for r in self.grams.where(F.col("gram").isin(grams)).collect()}  # as many as the query has
        if len(counts) < len(grams):
            return self.texts.limit(0), Report("index", 0, self.parts, 0)
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:GRAMS_READ]
        if counts[rarest[0]] > WORTH * self.rows and counts[rarest[0]] > PUSHED:
            return self.texts.where(self._contains(text)), Report("scan", 0, self.parts, self.rows)
        rarest = [g for g in rarest if counts[g] <= 10 * counts[rarest[0]]]  # a far longer list costs more than it saves
        salted = [(g, s) for g in rarest for s in range(max(1, math.ceil(counts[g] / PART_ROWS)) if counts[g] > PART_ROWS else 1)]
        places = self.spark.createDataFrame(salted, "gram string, salt long").select(self._part(F.col("gram"), F.col("salt")).alias("part"))
        read = sorted({r.part for r in places.collect()})
        met = self.postings.where(F.col("part").isin(read) & F.col("gram").isin(rarest))
        met = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("key")
        first = [r.key for r in met.limit(PUSHED + 1).collect()]
        if len(first) <= PUSHED:
            return self.texts.where(F.col(self.key).isin(first) & self._contains(text)), Report("index", len(read), self.parts, len(first))
        found = self.texts.join(met.withColumnRenamed("key", self.key), self.key, "left_semi").where(self._contains(text))
        return found.select(self.texts.columns), Report("index", len(read), self.parts, met.count())
