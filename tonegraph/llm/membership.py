"""A broadcast bitmap over a set of keys: rows that are certainly not in the set need no shuffle.

The bitmap has about 16 bits a key and at most MOST_BITS, so its size is bounded whatever the set; a full one
only lets more rows through to the join that decides exactly.  With 10**8 keys half of the other rows pass, with 10**9
all do: from there on raise MOST_BITS, at an eighth of it in bytes on each executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 MiB.
MOST_BITS = 1 << 27
_BUCKET = 32768  # bits of one bitmap that bitmap_construct_agg makes


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def once(expression: Column, name: str) -> Column:
    """expression as a generated column: a projection above can't repeat it, whose uses would each work it out anew."""
    return F.explode(F.array(expression)).alias(name)


def bits_for(keys: int, most_bits: int = MOST_BITS) -> int:
    bits = _BUCKET
    while bits < min(most_bits, 16 * keys):
        bits *= 2
    return bits


def bitmap(keys: DataFrame, column: str, bits: int, *by: str) -> DataFrame:
    """__bucket, __bits: the bitmap of that column of keys in rows of 4 KiB; one bitmap for each value of the columns `by`."""
    slot = keys.select(*by, _slot(F.col(column), bits).alias("slot"))
    return slot.groupBy(*by, (F.col("slot") / _BUCKET).cast("int").alias("__bucket")).agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET).alias("__bits"))


def probed(rows: DataFrame, bitmaps: DataFrame, bits: int, column: str, flag: str) -> DataFrame:
    """rows with a boolean flag: false where column is certainly not among the keys of the bitmap."""
    inside = (F.col("__slot") % _BUCKET).cast("int")
    placed = (
        rows.select("*", once(_slot(F.col(column), bits), "__slot"))
        .withColumn("__bucket", (F.col("__slot") / _BUCKET).cast("int"))
        .withColumn("__byte", (inside / 8).cast("int") + 1)
        .join(F.broadcast(bitmaps), "__bucket", "left")
    )
    byte = F.expr("cast(conv(hex(substring(__bits, __byte, 1)), 16, 10) as int)")
    found = F.getbit(byte, (F.col("__slot") % 8).cast("int")) == 1
    return placed.withColumn(flag, F.coalesce(found, F.lit(False))).drop("__slot", "__bucket", "__byte", "__bits")


def marked(rows: DataFrame, keys: DataFrame, column: str, flag: str, most_bits: int = MOST_BITS) -> DataFrame:
    """rows with a boolean flag: false where column is certainly not among that column of keys (a written table:
    it is counted)."""
    bits = bits_for(keys.count(), most_bits)
    return probed(rows, bitmap(keys, column, bits), bits, column, flag)


def without(rows: DataFrame, gone: DataFrame, column: str, most_bits: int = MOST_BITS) -> DataFrame:
    """rows whose column is not in gone (a written table); only those that the bitmap can't clear are joined."""
    flagged = marked(rows, gone, column, "__maybe", most_bits)
    clear = flagged.where("not __maybe").drop("__maybe")
    doubtful = flagged.where("__maybe").drop("__maybe").join(gone.select(column), column, "left_anti")
    return clear.unionByName(doubtful)
