"""Table access and lineage cuts shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, settled, work_path
from ..sources.tables import read_table

__all__ = ["SPACE_CLASS", "WORD_PATTERN", "free_name", "materialize", "read_table", "settled", "text_or_empty", "with_row_ids", "work_path"]

#: The white space every word and normalisation rule here means: blank and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a fixed number for each row, and that column's name: decisions then name rows and not
    doc_ids, which may repeat or be null."""
    row = free_name(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
