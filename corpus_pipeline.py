"""A training-data pipeline over ``documents``: filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it has kept.  Stages
are written as Parquet and read again, so a lost executor costs one stage's tasks at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrascope.llm import merge_dropout, odd_sketch, pfair_mixing, quality_crf, weak_rules
from lyrascope.llm.shared import written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line classifier, learnt from ``labels``, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.keep_predicted(docs, quality_crf.fit(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly supervised rules reject."""
    return weak_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates.

    Rows of one doc_id are one document, of which a row of the least text stays.  Rows without
    a doc_id are linked with nothing and all stay.
    """
    found = written(odd_sketch.near_duplicates(docs), "verdicts")
    kept = found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi")
    row = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit("")))
    single = own.groupBy("doc_id").agg(row.alias("row")).select("row.*")
    return single.unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the Pfair schedule of their sources."""
    return pfair_mixing.in_mixed_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids by SentencePiece with merge-dropout."""
    coded = merge_dropout.encode_documents(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("near-duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# The classifier, the rules' estimation and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
