"""The corpus pipeline over `documents`: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes what the one before kept, as (spark, docs, sf_dir) with the columns of `documents`, and
returns what it keeps; the last returns the packed pieces.  Stages are written as Parquet and read again, so
each one's lineage ends at a table and a lost executor repeats at most its own tasks.  Once a stage is written, the tables it
used and the stage before it are removed.

Every stage takes null texts, ids and sources, repeated rows, empty tables and other columns, which all but the last keep
whatever their names; what becomes of each is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonegraph.llm import exact_dedup, language_id, mixing, packing, simhash
from tonegraph.llm.common import read_table, settled


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was identified.  Null texts and texts without a letter go; with no labels to learn from all
    others go as well; each of repeated rows meets the same fate."""
    return language_id.drop_unidentified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document: the longest original, then the smallest doc_id (null last), then one row.  Null and empty
    texts are equal."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id (null last), then the first row.  Texts without words
    are copies of one another."""
    return simhash.keep_one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.  A null source is a source of its own; repeated rows are
    drawn one by one."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; a null text is an empty one, which is one piece of one token, and repeated rows
    are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Byte-pair encoding and trained code lengths have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""

    def after(stages: int) -> DataFrame:
        if not stages:
            return read_table(spark, sf_dir, "documents")
        name, stage = STAGES[stages - 1]
        return settled(spark, f"stage-{name.replace(' ', '-')}", lambda: stage(spark, after(stages - 1), sf_dir))

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
