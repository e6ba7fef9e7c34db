"""Annotation-shaped views over the driver tables.

The annotation exports are not published, so ratings and word labels are derived from
``documents`` and ``labels`` by fixed rules; a document is a song, its language and
``doc_id`` identify it, and songs of equal text within a language are repeats.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrascope.constants import OUTLIER_TOPIC
from lyrascope.functions.scalars import plain_words, source_words, text_key
from lyrascope.operators.corpus import stack
from lyrascope.operators.skew import id_buckets, number_rows
from lyrascope.session import broadcast_if_small, materialise


# Songs of one file of an export, about 40 MB with the texts of the driver tables.
FILE_SONGS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores where a small test table is one file in few splits.

    That shuffles the table, so it is for the stand-ins only; the operators never do it.
    """
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def status_of(annotator: int, doc_id: Column, pos: Column, word: Column) -> Column:
    """Label an annotator gives to a word."""
    odd = (doc_id * 31 + pos) % 7 == 0
    if annotator == 1:
        skipped = F.length(word) <= 3
    else:
        skipped = (F.length(word) <= 2) | ((doc_id + pos) % 11 == 0)
        odd = odd & (pos % 3 != 0)
    return F.when(skipped, "not_important").when(odd, "wrong").otherwise("correct")


def _rating(annotator: int) -> Column:
    doc, shift = F.col("doc_id"), F.col("n_chars") % 2
    if annotator == 1:
        return F.when(doc % 23 != 0, 1 + doc % 5)
    return F.when(doc % 29 != 0, 1 + (doc + shift) % 5)


def _unusual() -> Column:
    doc = F.col("doc_id")
    level = F.when(doc % 3 == 0, "none").when(doc % 3 == 1, "barely").otherwise("significantly")
    return F.when(doc % 31 != 0, level)


def _song_columns(docs: DataFrame, *more: str) -> DataFrame:
    """Documents as songs: ids, ratings of both annotators, and the words as ``tokens``."""
    return docs.select(
        *more,
        F.col("lang").alias("language"),
        F.col("doc_id").alias("text_id"),
        text_key(F.col("text")).alias("text_key"),
        _rating(1).alias("overall_rating_a"),
        _rating(2).alias("overall_rating_b"),
        _unusual().alias("unusual_language"),
        plain_words(F.col("text")).alias("tokens"),
    )


def songs(spark: SparkSession, sf_dir: str, annotator: int = 1) -> DataFrame:
    """Songs of one annotator, with their words nested."""
    return _songs_of(documents(spark, sf_dir), annotator)


def _songs_of(docs: DataFrame, annotator: int, *more: str) -> DataFrame:
    words = F.transform(
        "tokens",
        lambda w, i: F.struct(
            w.alias("word"), status_of(annotator, F.col("text_id"), i, w).alias("status")
        ),
    )
    rating = "overall_rating_a" if annotator == 1 else "overall_rating_b"
    return _song_columns(docs, *more).select(
        *more,
        "language",
        "text_id",
        "text_key",
        F.col(rating).alias("overall_rating"),
        "unusual_language",
        words.alias("words"),
    )


def words(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame:
    """Word table: key columns of the song, pos, word, and the labels of both annotators."""
    exploded = _song_columns(documents(spark, sf_dir)).select(
        *dict.fromkeys([*keys, "text_id"]), F.posexplode_outer("tokens").alias("pos", "word")
    )
    place = (F.col("text_id"), F.col("pos"), F.col("word"))
    # A song without words keeps a row, in which nothing is labelled.
    label = [F.when(F.col("pos").isNotNull(), status_of(n, *place)) for n in (1, 2)]
    return exploded.select(*keys, "pos", "word", label[0].alias("a"), label[1].alias("b"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs with the ratings of both annotators, without their words."""
    return _song_columns(documents(spark, sf_dir)).drop("tokens")


def song_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow rows of all songs, written once: the texts are read a single time."""
    docs = documents(spark, sf_dir)
    return materialise(
        docs.select(
            F.col("lang").alias("language"),
            F.col("doc_id").alias("text_id"),
            text_key(F.col("text")).alias("text_key"),
            F.size(plain_words(F.col("text"))).cast("long").alias("n_words"),
        )
    )


def add_answers(spark: SparkSession, sf_dir: str, songs: DataFrame) -> DataFrame:
    """Add both annotators' hallucination answers to (narrow) song rows."""
    answers = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("text_id"),
        F.when(F.col("quality") == 0, "yes").when(F.col("quality").isNotNull(), "no").alias(
            "hallucination_a"
        ),
        F.when(F.col("toxic") == 1, "yes").when(F.col("toxic").isNotNull(), "no").alias(
            "hallucination_b"
        ),
    )
    return songs.join(answers, "text_id", "left")


def number_songs(songs: DataFrame) -> DataFrame:
    """Add the position of a song in its language's export (ids ascending, from 1)."""
    return number_rows(
        songs, ["language"], id_buckets("text_id"), [F.col("text_id")], "position"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus stacked from two tables: item_id, translation, with missing and blank texts.

    Labelled documents of low quality have no translation, toxic ones a blank text, and
    those that are both the text NA.
    """
    answers = table(spark, sf_dir, "labels")
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    translation = (
        F.when(low & toxic, "NA")
        .when(low, F.lit(None))
        .when(toxic, " \t\u00a0")
        .otherwise(F.concat(F.lit("\u2003 "), F.col("text"), F.lit("\n\t")))
    )
    translated = documents(spark, sf_dir).join(answers, "doc_id", "left").select(
        F.concat(F.lit("d"), "doc_id").alias("item_id"), translation.alias("translation")
    )
    reviewed = table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("translation"), F.concat(F.lit("b"), "item_id").alias("item_id")
    )
    return stack([translated, reviewed])


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published ids: the labelled documents."""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("item_id")
    )


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts with line tags; words annotator 1 finds important are coloured.

    Texts with an odd number of characters also colour a position beyond their end.
    """
    docs = documents(spark, sf_dir)
    original = F.replace(docs["text"], F.lit("\n"), F.lit("<br>"))
    words = docs.select("doc_id", "lang", "n_chars", source_words(original).alias("words"))

    def important(word, pos):
        return F.when(status_of(1, F.col("doc_id"), pos, word) != "not_important", pos)

    colored = F.array_compact(F.transform("words", important))
    beyond = F.when(F.col("n_chars") % 2 == 1, F.array(F.size("words"))).otherwise(
        F.array().cast("array<int>")
    )
    return words.select(
        F.col("lang").alias("language"),
        F.col("doc_id").alias("text_id"),
        "words",
        F.concat(colored, beyond).alias("colored"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per language: topic_id from 0 in alphabetical order, name, count."""
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("count"))
    # As many rows as there are languages.
    return materialise(
        sizes.select(
            "lang",
            (F.row_number().over(Window.orderBy("lang")) - 1).alias("topic_id"),
            F.concat(F.lit("topic "), F.col("lang")).alias("name"),
            "count",
        )
    )


def named_topics(topics: DataFrame) -> DataFrame:
    """Topic info in which the French topic has no name."""
    return topics.filter(F.col("lang") != "fr").select("topic_id", "name", "count")


def topic_documents(spark: SparkSession, sf_dir: str, topics: DataFrame) -> DataFrame:
    """Documents with the topic they belong to: id, topic_id, text."""
    groups = broadcast_if_small(topics.select("lang", "topic_id"), topics.count())
    return (
        documents(spark, sf_dir)
        .join(groups, "lang")
        .select(F.col("doc_id").alias("id"), "topic_id", "text")
    )


def heldout_topics(spark: SparkSession) -> DataFrame:
    """Topics of two languages, with a third one as the outlier group; others are not learnt."""
    return spark.createDataFrame(
        [("de", 0), ("en", 1), ("fr", OUTLIER_TOPIC)], "lang string, topic_id int"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows: vec_id, label, features."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("features")
    )


def write_exports(
    spark: SparkSession,
    sf_dir: str,
    path: str,
    file_songs: int = FILE_SONGS,
    compression: str = "none",
) -> None:
    """The songs of annotator 1 as one multi-line export per language, in ``language=...``.

    An export has a file for every ``file_songs`` songs, in ``part=...`` from 0.  Every file is
    written by one task, so its size does not follow the table's.  Songs are numbered in ranges of
    2^10 ids, as they are long, and are texts on the way: with a label for every word they are
    several times as large, and are made where they are written.
    """
    ranges = [*id_buckets("doc_id"), F.shiftright("doc_id", 10)]
    docs = documents(spark, sf_dir).select("lang", "doc_id", "text", "n_chars")
    listed = number_rows(docs, ["lang"], ranges, [F.col("doc_id")], "position").withColumn(
        "part", F.floor((F.col("position") - 1) / file_songs)
    )
    files = listed.select("lang", "part").distinct()
    first, last = F.lit(0).cast("long"), F.lit(1 << 62)
    head, tail = (files.withColumn("position", place) for place in (first, last))
    dealt = (
        listed.unionByName(head, allowMissingColumns=True)
        .unionByName(tail, allowMissingColumns=True)
        .repartition("lang", "part")
        .sortWithinPartitions("lang", "part", "position")
    )
    songs_of = _songs_of(dealt, 1, "part", "position")
    record = F.struct(
        F.col("text_id").alias("textId"),
        F.concat(F.lit("song "), "text_id", F.lit(' of "textId" {')).alias("title"),
        F.col("overall_rating").alias("overallRating"),
        F.col("unusual_language").alias("unusualLanguage"),
        "words",
    )
    comma = F.when((F.col("position") - 1) % file_songs > 0, ",\n").otherwise("\n")
    opening = F.concat(F.lit('{"language": "'), "language", F.lit('",\n "evaluations": ['))
    value = (
        F.when(F.col("position") == first, opening)
        .when(F.col("position") == last, "\n]}")
        .otherwise(F.concat(comma, F.to_json(record)))
    )
    (
        songs_of.select("language", "part", value.alias("value"))
        .write.partitionBy("language", "part")
        .option("compression", compression)
        .text(path)
    )


def write_corpus(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The documents as CSV files with a header, those of two languages in another order."""
    docs = documents(spark, sf_dir).select(
        F.concat(F.lit("d"), "doc_id").alias("item_id"), F.col("text").alias("translation"), "lang"
    )
    turned = F.col("lang").isin("de", "fr")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    other = docs.filter(turned).select("lang", "translation", "item_id")
    for rows in (docs.filter(~turned), other):
        rows.write.mode("append").options(header=True, escape='"', **kept).csv(path)
