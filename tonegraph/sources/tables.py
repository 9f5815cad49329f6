"""Reading and writing tables, and how the driver's tables stand in for notes, tracks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GROUPS, METADATA

#: Width of each group when a 64-dimensional vector is cut into nine.
SLICES = dict(zip(GROUPS, (9, 12, 3, 10, 10, 5, 5, 5, 5), strict=True))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_metadata_csv(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """Metadata with header; texts such as "None" or "NA" stay texts, empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_h5_metadata(spark: SparkSession, folder: str, midi_folder: str) -> DataFrame:
    """Metadata rows of all *.h5 files below folder (first entry of metadata/songs); needs h5py on the executors.
    A track is named after its file, and its MIDI files lie at the same place below midi_folder."""

    def run(batches):
        import io

        import h5py
        import pandas as pd

        text = lambda v: v.decode("utf-8") if isinstance(v, bytes) else str(v)
        for batch in batches:
            rows = []
            for path, place, data in zip(batch["path"], batch["place"], batch["content"], strict=True):
                with h5py.File(io.BytesIO(data), "r") as file:
                    entry = file["metadata/songs"][0]
                names = ("artist_name", "artist_id", "title", "song_id", "release", "genre")
                rows.append((path.rsplit("/", 1)[-1].removesuffix(".h5"), *[text(entry[n]) for n in names], f"{midi_folder}/{place}"))
            columns = ["track_id", *names, "midi_path"]
            yield pd.DataFrame(rows, columns=columns)[[c.split()[0] for c in METADATA.split(", ")]]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.h5").load(folder)
    below = F.regexp_replace(F.substring_index("path", folder.rstrip("/") + "/", -1), r"\.h5$", "")
    return files.select("path", below.alias("place"), "content").mapInPandas(run, METADATA)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_distinct(df: DataFrame, path: str, keys: list[str], out: str) -> DataFrame:
    """Rows at path and df, one for each key, written to another path.  It reads and writes all rows: tables that
    are appended to again and again are keyed.KeyedTable's."""
    spark = df.sparkSession
    spark.read.parquet(path).unionByName(df).dropDuplicates(keys).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from events.  Times are multiples of 1/16, exact in binary."""
    events = read_table(spark, sf_dir, "events")
    slot = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    onset = slot * F.lit(0.0625)
    return events.select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("note_seq"),
        (F.col("event_id") % 3).cast("int").alias("file_no"),
        F.col("event_type").alias("instrument"),
        (F.col("event_type") == "error").alias("is_drum"),
        onset.alias("onset"),
        (onset + (1 + F.col("event_id") % 16) * F.lit(0.0625)).alias("release"),
        (14 + F.get_json_object("props", "$.k").cast("int")).alias("pitch"),
        (1 + F.floor("value") % 127).cast("int").alias("velocity"),
    )


NOTES_SQL = """
e AS (
  SELECT user_id AS track_id, event_id AS note_seq, (event_id % 3)::INT AS file_no, event_type AS instrument,
         event_type = 'error' AS is_drum, date_diff('hour', TIMESTAMP '2024-01-01', ts) * 0.0625::DOUBLE AS onset,
         date_diff('hour', TIMESTAMP '2024-01-01', ts) * 0.0625::DOUBLE + (1 + event_id % 16) * 0.0625::DOUBLE AS "release",
         14 + (props->>'k')::INT AS pitch, (1 + floor(value)::BIGINT % 127)::INT AS velocity
  FROM events),
song AS (SELECT * FROM e WHERE track_id IN (SELECT track_id FROM e WHERE NOT is_drum GROUP BY 1 HAVING count(*) >= 5)),
m AS (SELECT *, CASE WHEN pitch < 48 THEN 'low' WHEN pitch < 72 THEN 'mid' ELSE 'high' END AS reg FROM song WHERE NOT is_drum)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track metadata from part; file_order is the order of arrival."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_type").alias("release"),
        F.col("p_partkey").alias("file_order"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding (doubles), label."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title and artist_name of all tracks."""
    return tracks(spark, sf_dir).select(F.col("track_id").alias("id"), "title", "artist_name")


def vector_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id of each vector, title and artist_name of the track that stands at it.  The hint keeps Spark from sending all names through
    the driver, which it does where their compressed file is small."""
    return vectors(spark, sf_dir).select("id").join(names(spark, sf_dir).hint("merge"), "id", "left")


def vector_groups(vectors: DataFrame, slices: dict[str, int] = SLICES) -> DataFrame:
    """One array column for each feature group, cut from the embedding."""
    columns, at = [], 1
    for group, width in slices.items():
        columns.append(F.slice("embedding", at, width).alias(group))
        at += width
    return vectors.select("id", "label", *columns)
