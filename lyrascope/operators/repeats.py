"""Repeated songs: finding them, excluding them, and keeping the first copy only."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrascope.operators.skew import HEAVY_ROWS, salted_join
from lyrascope.session import materialise


def repeat_table(spark: SparkSession, repeats: Mapping[str, Sequence[int]]) -> DataFrame:
    """Table (language, keep_id, dup_id) from a mapping language -> (kept id, repeated id)."""
    rows = [(language, kept, dup) for language, (kept, dup) in repeats.items()]
    return spark.createDataFrame(rows, "language string, keep_id long, dup_id long")


def find_repeats(songs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Songs of equal text within a language, paired with the lowest id among them.

    Input: language, text_id, text_key.  Groups are counted before any shuffle and only
    those with copies, written once, are joined back.
    """
    keys = ["language", "text_key"]
    rows = songs.select(*keys, "text_id")
    copied = materialise(
        rows.groupBy(*keys)
        .agg(F.min("text_id").alias("keep_id"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )
    return (
        salted_join(
            rows,
            copied.drop("n"),
            keys,
            "text_id",
            counts=copied.select(*keys, "n"),
            heavy_rows=heavy_rows,
        )
        .filter(F.col("text_id") != F.col("keep_id"))
        .select("language", "keep_id", F.col("text_id").alias("dup_id"))
    )


def exclude_repeats(songs: DataFrame, repeats: DataFrame, by: str = "text_id") -> DataFrame:
    """Drop repeated songs, by text id or by position in the export."""
    dropped = repeats.select("language", F.col("dup_id").alias(by))
    return songs.join(dropped, ["language", by], "left_anti")


def flag_repeats(songs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Add ``kept``: false for the repeated presentation of a song."""
    flags = repeats.select("language", F.col("dup_id").alias("text_id"), F.lit(True).alias("_dup"))
    return (
        songs.join(flags, ["language", "text_id"], "left")
        .withColumn("kept", F.col("_dup").isNull())
        .drop("_dup")
    )


def keep_first_copy(
    songs: DataFrame, values: Sequence[str], totals: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct text of a language: the values of its lowest id.

    ``totals`` are aggregates over all copies.  This is one aggregation with map-side
    combining, so a text with very many copies costs no more than any other.  Songs without
    a text are no copies of each other.
    """
    key = F.coalesce("text_key", F.concat(F.lit("id "), F.col("text_id")))
    first = [F.min_by(v, "text_id").alias(v) for v in values]
    extra = [column.alias(name) for name, column in (totals or {}).items()]
    return (
        songs.groupBy("language", key.alias("text_key"))
        .agg(F.min("text_id").alias("_first"), *first, *extra)
        .withColumnRenamed("_first", "text_id")
        .drop("text_key")
    )


def compare_repeat_rules(songs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per language, how many songs each of the two exclusion rules drops and where they differ.

    The rules agree only where ids run 1, 2, 3, ... in export order.  Input: language,
    position, text_id.
    """
    by_id = repeats.select("language", F.col("dup_id").alias("text_id"), F.lit(1).alias("by_id"))
    by_position = repeats.select(
        "language", F.col("dup_id").alias("position"), F.lit(1).alias("by_position")
    )
    flagged = songs.join(by_id, ["language", "text_id"], "left").join(
        by_position, ["language", "position"], "left"
    )
    differ = F.col("by_id").isNull() != F.col("by_position").isNull()
    return flagged.groupBy("language").agg(
        F.count("by_id").alias("n_by_id"),
        F.count("by_position").alias("n_by_position"),
        F.count_if(differ).alias("n_differ"),
    )
