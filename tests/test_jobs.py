"""Jobs from files to files, on small annotation exports."""

import json

import pytest

from lyrascope.plans import jobs
from lyrascope.sinks import reports
from lyrascope.sinks.versions import read_table
from lyrascope.sources import annotations


def song(text_id, rating, hallucination, unusual, labels):
    return {
        "textId": text_id,
        "title": f"Title {text_id}",
        "overallRating": rating,
        "hallucination": hallucination,
        "unusualLanguage": unusual,
        "comment": "",
        "words": [{"word": f"w{i}", "status": s} for i, s in enumerate(labels)],
    }


C, W, N = "correct", "wrong", "not_important"
CZECH = [
    song(1, 4, "no", "barely", [C, C, W, N]),
    song(2, None, "yes", None, [N, N]),
    song(3, 5, "yes", "none", [C, "odd"]),
    song(4, 2, None, "barely", [C, W]),
    song(5, 1, "yes", "none", [C, C]),
]
DUTCH = [song(1, 3, "no", "none", [N, N])]


@pytest.fixture
def root(tmp_path):
    def write(name, language, evaluations):
        export = {"language": language, "exportedAt": "2026-04-01T22:42:43.617Z"}
        if evaluations is not None:
            export["evaluations"] = evaluations
        (tmp_path / name).write_text(json.dumps(export, indent=1), encoding="utf8")

    write("mt_czech_AB.json", "Czech", CZECH)
    write("mt_dutch_PvK.json", "Dutch", DUTCH)
    write("mt_czech_CD.json", "Czech", [dict(s, overallRating=3) for s in CZECH])
    write("mt_empty_EF.json", "Empty", None)
    return str(tmp_path)


FILES = {"cs": "mt_czech_AB.json", "nl": "mt_dutch_PvK.json"}


def test_read_songs(spark, root, caplog):
    songs = annotations.read_songs(spark, root, FILES, ["cs", "nl", "xx"])
    rows = songs.orderBy("language", "position").collect()
    assert [(r.language, r.position, r.text_id) for r in rows[:2]] == [("cs", 1, 1), ("cs", 2, 2)]
    assert {r.annotator for r in rows} == {"AB", "PvK"}
    assert "xx" in caplog.text
    words = annotations.explode_words(songs).filter("language = 'cs' and text_id = 1")
    assert [(r.pos, r.word, r.status) for r in words.orderBy("pos").collect()] == [
        (0, "w0", C),
        (1, "w1", C),
        (2, "w2", W),
        (3, "w3", N),
    ]


def test_empty_export_stops_the_run(spark, root):
    with pytest.raises(ValueError, match="mt_empty_EF.json"):
        annotations.read_songs(spark, root, {"et": "mt_empty_EF.json"}, ["et"])


def test_translation_report(spark, root, tmp_path):
    out = str(tmp_path / "out")
    repeated = {"cs": (3, 5)}
    jobs.evaluate_translations(spark, root, FILES, out, ["cs", "nl"], repeated)
    text = "\n".join(r.value for r in read_table(spark, out, "text").collect())
    assert text == "\n".join(
        [
            "Machine Translation Evaluation Results",
            "",
            "Language: cs",
            "  Mean overall rating: 3.00",
            "  Mean correctness: 0.67",
            "  Mean importance: 0.60",
            "  Total words evaluated: 10",
            "  Self-agreement of annotator: 0.00",
            "  Hallucinations: 2 out of 4 songs",
            "  Unusual language distribution:",
            "    barely: 2",
            "    None: 1",
            "    none: 1",
            "",
            "Language: nl",
            "  Mean overall rating: 3.00",
            "  Mean correctness: 0.00",
            "  Mean importance: 0.00",
            "  Total words evaluated: 2",
            "  Self-agreement of annotator: 0.00",
            "  Hallucinations: 0 out of 0 songs",
            "  Unusual language distribution:",
            "    none: 1",
            "",
        ]
    )
    # A second report whose later tables fail leaves the first one as it is.
    report, levels = (read_table(spark, out, n) for n in ("report", "unusual_language"))
    broken = report.selectExpr("raise_error('no points') AS language")
    with pytest.raises(Exception, match="no points"):
        reports.write_quality_report(report.limit(1), levels.limit(1), out, song_points=broken)
    assert read_table(spark, out, "report").count() == 2
    points = read_table(spark, out, "song_points").orderBy("language", "text_id").collect()
    assert [(r.language, r.text_id) for r in points] == [
        ("cs", 1), ("cs", 2), ("cs", 3), ("cs", 4), ("nl", 1),
    ]
    assert points[0].correctness == pytest.approx(2 / 3)
    assert points[0].shifted_rating == pytest.approx(3.97)
    assert points[1].shifted_rating is None and points[1].correctness == 0.0
    assert points[4].shifted_rating == pytest.approx(3.06)


def test_agreement_report(spark, root, tmp_path):
    out = str(tmp_path / "out")
    pairs = {"cs": ("mt_czech_AB.json", "mt_czech_CD.json")}
    jobs.evaluate_agreement(spark, root, pairs, out, {"cs": (3, 5)})
    (row,) = read_table(spark, out, "report").collect()
    assert (row.language, row.annotator_a, row.annotator_b) == ("cs", "AB", "CD")
    assert (row.n_songs, row.n_important_songs) == (4, 3)
    assert row.kappa_hallucination == 1.0 and row.mean_accuracy_important == 1.0
    # Song 2 has one label only, so its kappa and the mean are undefined.
    assert row.mean_kappa_words is None and row.mean_defined_kappa_words == 1.0
    text = [r.value for r in read_table(spark, out, "text").collect()]
    assert text[1] == "Cohen's kappa for overallRating: 0.0000"
    assert text[3] == "Mean Cohen's kappa for word-level labels: nan"
    songs = read_table(spark, out, "songs")
    assert sorted(r.text_id for r in songs.collect()) == [1, 2, 3, 4]


def test_topics_to_reduced_features(spark, tmp_path, caplog):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "a.csv").write_text(
        'item_id,translation\n01,"Sun and moon, sun"\n02,"river\nriver boat"\n03,NA\n04,"  "\n'
    )
    (corpus / "b.csv").write_text('translation,extra,item_id\n"moon ""sun""",x,05\n1 2 3,y,06\n')
    training = spark.createDataFrame(
        [(0, "sun moon sun star"), (1, "river boat river sea")], "topic_id int, text string"
    )
    info = spark.createDataFrame(
        [(-1, "outlier", 5), (0, "sky", 1)], "topic_id int, name string, count long"
    )
    out = str(tmp_path / "out")
    jobs.infer_topics(spark, str(corpus), training, info, out)
    rows = spark.read.parquet(f"{out}/probabilities").orderBy("id").collect()
    assert [(r.id, r.assigned_topic, r.topic_label) for r in rows] == [
        ("01", 0, "sky"),
        ("02", 1, None),
        ("05", 0, "sky"),
        ("06", 0, "sky"),
    ]
    assert [(r.topic_0, r.topic_1) for r in rows] == [(1, 0), (0, 1), (1, 0), (0, 0)]
    assert dict(spark.read.parquet(f"{out}/probabilities").dtypes)["topic_0"] == "float"
    summary = spark.read.option("header", True).csv(f"{out}/summary").orderBy("id").collect()
    assert [r.topic_label for r in summary] == ["sky", "unknown", "sky", "sky"]

    reduced_dir = str(tmp_path / "pca")
    with caplog.at_level("INFO"):
        fitted = jobs.reduce_topics(spark, f"{out}/probabilities", reduced_dir, 0.75)
    assert "columns: ['id', 'assigned_topic', 'topic_label'], and 2 topics" in caplog.text
    assert "4 rows reduced from 2 topics to 1 components" in caplog.text
    reduced = spark.read.parquet(f"{reduced_dir}/reduced")
    assert reduced.columns == ["id", "assigned_topic", "topic_label", "pc_0"]
    assert fitted.n_components == 1
    report = spark.read.option("header", True).csv(f"{reduced_dir}/variance_report").collect()
    assert [r.component for r in report] == ["1"]


def test_topic_number_tuning(spark, tmp_path):
    lines = ["item_id,lyrics,kind"]
    for i in range(20):
        words = "sun moon star sky" if i % 2 else "river boat sea fish"
        lines.append(f"{i},{words} {words},{'a' if i % 2 else 'b'}")
    path = tmp_path / "songs.csv"
    path.write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    runs = jobs.run_topic_models(
        spark, str(path), out, label_col="kind", topic_numbers=[2, 3], n_models=2, max_iter=3
    )
    grid = spark.read.parquet(f"{out}/tuning").collect()
    assert sorted(r.n_topics for r in grid) == [2, 3] and all(r.n_fits == 5 for r in grid)
    assert sum(r.is_best for r in grid) == 1
    assert runs.filter("is_kept").count() == 2
    record = spark.read.parquet(f"{out}/runs")
    assert record.filter("is_kept").count() == 2
    similarity = spark.read.parquet(f"{out}/similarity").collect()
    assert [(r.label_a, r.label_b) for r in similarity] == [("a", "b")] * 2
    assert all(0 <= r.similarity <= 1 + 1e-9 for r in similarity)
    by_run = spark.read.parquet(f"{out}/run_similarity").collect()
    assert sorted((r.seed, r.label, r.n_texts) for r in by_run) == [
        (42, "a", 10), (42, "b", 10), (43, "a", 10), (43, "b", 10),
    ]
    assert all(0 <= r.similarity <= 1 + 1e-9 for r in by_run)
