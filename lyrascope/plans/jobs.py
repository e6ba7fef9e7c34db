"""Whole jobs from input files to output files."""

import logging
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lyrascope.constants import (
    LANGUAGES,
    MAX_TOPICS,
    MIN_TOPICS,
    NUM_MODELS,
    RATING_OFFSETS,
    REPEATED_SONGS,
    SEED,
    VARIANCE_TARGET,
)
from lyrascope.operators import (
    agreement,
    corpus,
    lda,
    lda_runs,
    quality,
    reduction,
    repeats,
    topics,
    tuning,
)
from lyrascope.session import materialise
from lyrascope.sinks import features as feature_sinks
from lyrascope.sinks import reports
from lyrascope.sources import annotations, corpora

log = logging.getLogger(__name__)


def evaluate_translations(
    spark: SparkSession,
    root: str,
    files: Mapping[str, str],
    out: str,
    languages: Sequence[str] = LANGUAGES,
    repeated: Mapping[str, Sequence[int]] = REPEATED_SONGS,
    offsets: Mapping[str, float] = RATING_OFFSETS,
) -> DataFrame:
    """Quality report of one annotation export per language, with the song points."""
    songs = annotations.read_songs(spark, root, files, languages)
    listed = repeats.repeat_table(spark, repeated)
    counts = materialise(
        quality.song_word_counts(songs).select(
            "language", "text_id", "position", *quality.SONG_VALUES
        )
    )
    rows = quality.flagged_songs(counts, listed)
    kappas = agreement.self_agreement(agreement.statuses(songs), listed)
    report = quality.language_report(rows, agreement.self_agreement_by_language(kappas))
    points = quality.song_points(repeats.exclude_repeats(counts, listed), offsets)
    levels = quality.unusual_distribution(rows)
    reports.write_quality_report(report, levels, out, song_points=points)
    return report


def evaluate_agreement(
    spark: SparkSession,
    root: str,
    pairs: Mapping[str, tuple[str, str]],
    out: str,
    repeated: Mapping[str, Sequence[int]] = REPEATED_SONGS,
) -> DataFrame:
    """Agreement report of two annotation exports per language."""
    first, second = annotations.read_pairs(spark, root, pairs)
    aligned = agreement.align_songs(first, second, repeats.repeat_table(spark, repeated))
    aligned = materialise(aligned)
    measured = materialise(agreement.song_agreement(aligned, agreement.labels_of(aligned)))
    report = agreement.agreement_report(materialise(agreement.agreement_cube(measured)))
    names = annotations.pair_table(spark, pairs)
    reports.write_agreement_report(
        report, measured.select("language", "text_id", *agreement.SONG_MEASURES), names, out
    )
    return report


def infer_topics(
    spark: SparkSession,
    path: str,
    training: DataFrame,
    info: DataFrame,
    out: str,
    id_col: str = "item_id",
    text_col: str = "translation",
    **window,
) -> DataFrame:
    """Topic probabilities and summary of a CSV corpus.

    ``training`` holds the grouped texts (topic_id, text) the topics are learnt from and
    ``info`` their names (topic_id, name, count).
    """
    totals = Observation()
    texts = corpus.clean_corpus(
        corpora.read_corpus(spark, path, id_col, text_col), text_col, totals
    )
    # Written once, so that the files are parsed a single time and the totals are exact.
    docs = materialise(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    log.info("%d texts loaded", totals.get["n_texts"])
    if totals.get["n_dropped"]:
        log.warning("%d texts dropped as empty", totals.get["n_dropped"])
    model = topics.fit_topics(training)
    scores = materialise(topics.topic_scores(docs, model, **window))
    ids = [
        r["topic_id"]
        for r in topics.regular_topics(model.terms.select("topic_id").distinct()).collect()
    ]
    assigned = topics.assign_topics(scores, min(ids))
    labelled = topics.label_topics(assigned, info, model.n_topics)
    wide = topics.wide_distribution(labelled, topics.topic_distribution(scores), ids)
    feature_sinks.write_probabilities(wide, f"{out}/probabilities")
    feature_sinks.write_summary(topics.topic_summary(labelled), f"{out}/summary")
    return labelled


def reduce_topics(
    spark: SparkSession,
    path: str,
    out: str,
    variance: float = VARIANCE_TARGET,
    whiten: bool = False,
) -> reduction.Reduction:
    """PCA reduction of a table of wide topic probabilities, with its variance report."""
    table = corpora.read_features(spark, path)
    meta, topic_columns = reduction.split_columns(table.columns)
    log.info("columns: %s, and %d topics", meta, len(topic_columns))
    normed = reduction.l1_normalise(reduction.wide_to_features(table)).drop("features")
    fitted = reduction.fit_reduction(normed, variance, whiten)
    # Counted by the pass that writes the rows.
    totals = Observation()
    reduced = fitted.transform(normed).observe(totals, F.count("*").alias("n_rows"))
    feature_sinks.write_reduced(reduced, fitted.n_components, f"{out}/reduced")
    log.info(
        "%d rows reduced from %d topics to %d components",
        totals.get["n_rows"],
        len(topic_columns),
        fitted.n_components,
    )
    feature_sinks.write_variance_report(
        reduction.variance_report(spark, fitted), f"{out}/variance_report"
    )
    return fitted


def run_topic_models(
    spark: SparkSession,
    path: str,
    out: str,
    text_col: str = "lyrics",
    id_col: str = "item_id",
    label_col: str | None = None,
    topic_numbers: Iterable[int] = range(MIN_TOPICS, MAX_TOPICS + 1),
    tuning_repeats: int = 1,
    n_models: int = NUM_MODELS,
    seed: int = SEED,
    max_iter: int = lda_runs.MAX_ITER,
) -> DataFrame:
    """Tune the number of topics on a CSV corpus and run the models with the best one.

    Finished settings and models are kept in ``out``/models, and a job that is started again
    goes on from there.  Returns the record of the runs.
    """
    wanted = [id_col, text_col] + ([label_col] if label_col else [])
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    docs = corpus.clean_corpus(table.csv(path).select(*wanted), text_col)
    prepared = tuning.prepare_corpus(docs, text_col, id_col, label_col, seed=seed)
    folder = lda_runs.RunFolder(lda.deal(prepared.rows), f"{out}/models", max_iter)
    grid = folder.tune(topic_numbers, repeats=tuning_repeats, seed=seed)
    chosen = lda_runs.choose_topics(folder, lda_runs.compare_topics(grid), seed)
    chosen.write.mode("overwrite").parquet(f"{out}/tuning")
    k = chosen.filter("is_chosen").first()["n_topics"]
    record = folder.run(k, n_models, seed=seed)
    record.write.mode("overwrite").parquet(f"{out}/runs")
    if label_col:
        seeds = [r["seed"] for r in record.filter("is_kept").collect()]
        theta = materialise(folder.theta(k, seeds))
        lda_runs.label_similarities(theta).write.mode("overwrite").parquet(f"{out}/similarity")
        lda_runs.run_similarity(theta, lda_runs.reference_run(record), k).write.mode(
            "overwrite"
        ).parquet(f"{out}/run_similarity")
    return record
