"""The line classifier and the weakly supervised rules."""

import collections
import zlib

import numpy as np
import pyarrow as pa

from lyrascope.llm import quality_crf, weak_rules
from tests.llm.data import WORD, by_id, documents, frame, junk, prose


def base_counts(text):
    """The counts of the base rules, word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + k
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for k in range(3)
    }
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered)


def test_base_counts_and_verdicts(spark):
    got = by_id(weak_rules.judge(frame(spark)))
    for doc_id, text, *_ in documents():
        row, counts = got[doc_id], base_counts(text)
        assert tuple(row[c] for c in weak_rules.COUNTS) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert row["base_failed"] == failed
        assert not (failed and row["kept"])
        if text == prose(5):
            assert row["kept"]
        if text == junk(5):
            assert not row["kept"]


def test_filter_keeps_what_the_verdict_keeps_with_all_columns(spark):
    docs = frame(spark).withColumnRenamed("lang", "kept")
    verdicts = by_id(weak_rules.judge(docs))
    kept = weak_rules.keep_good(docs)
    assert kept.columns == docs.columns
    expected = sorted(r[0] or 0 for r in documents() if verdicts[r[0]]["kept"])
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == expected


def test_label_model_finds_the_accuracies_of_its_rules():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8]

    def vote(share):
        says = np.where(rng.random(len(truth)) < share, truth, ~truth) * 2
        return np.where(rng.random(len(truth)) < 0.3, 1, says)

    given = np.stack([vote(share) for share in right], 1)
    model = weak_rules.fit_label_model(given, np.ones(len(given)), 100)
    assert abs(model.prior[1] - 0.8) < 0.05
    for k, r in enumerate(right):
        assert abs(model.rates[1, k, 2] / (model.rates[1, k, 2] + model.rates[1, k, 0]) - r) < 0.05
    assert ((model.posterior(given) >= 0.5) == truth).mean() > 0.93


def test_spark_posterior_is_the_models(spark):
    given = np.array([[2] * 10, [0] * 10, [1] * 10, [2, 0] * 5])
    model = weak_rules.fit_label_model(given, np.array([50.0, 9.0, 3.0, 2.0]))
    rows = spark.createDataFrame([(int(p),) for p in weak_rules.pattern(given)], "p long")
    got = [r[0] for r in rows.select(weak_rules.posterior(model, rows["p"])).collect()]
    assert np.allclose(got, model.posterior(given))


def labels(spark, ids):
    rows = [(d, int(not {"#", "$"} & set(t or "")), 0) for d, t, *_ in documents() if d in ids]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifier_tells_held_out_documents_apart(spark):
    docs = frame(spark)
    ids = {d for d, t, *_ in documents() if d and t and len(t) > 300 and d != 46}
    field = quality_crf.fit(docs, labels(spark, ids))
    got = by_id(quality_crf.with_fold(quality_crf.score(docs, field)))
    assert len(got) == len({r[0] for r in documents()})
    for doc_id, text, *_ in documents():
        row = got[doc_id]
        fold = zlib.crc32(str(doc_id).encode()) % 5 == 0 if doc_id is not None else True
        assert row["held_out"] == fold
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
        if text in {prose(i) for i in range(60)} | {junk(i) for i in range(12)}:
            assert row["predicted"] == int("#" not in text and "$" not in text)
    kept = quality_crf.keep_predicted(docs, field)
    assert kept.columns == docs.columns
    assert kept.count() == sum(got[r[0]]["predicted"] for r in documents())


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = frame(spark)
    ids = {d for d, t, *_ in documents() if d and t and len(t) > 300}
    told = labels(spark, ids)
    turned = told.selectExpr(
        "doc_id", "IF(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality"
    )
    one, other = quality_crf.fit(docs, told), quality_crf.fit(docs, turned)
    assert (one.weights == other.weights).all()


def test_classifier_without_labels_or_documents(spark):
    docs = frame(spark)
    field = quality_crf.fit(docs, labels(spark, set()))
    assert {r["score"] for r in quality_crf.score(docs, field).collect()} == {0.5}
    assert quality_crf.score(frame(spark, []), field).count() == 0
    assert weak_rules.judge(frame(spark, [])).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    score, step = rng.normal(size=5), rng.normal(size=(2, 2))
    good, pair = quality_crf.forward_backward(score, step, np.array([0, 0, 5]))
    total, expected = 0.0, np.zeros(5)
    for path in range(32):
        state = [path >> i & 1 for i in range(5)]
        weight = np.exp(
            sum(score[i] * state[i] for i in range(5))
            + sum(step[state[i], state[i + 1]] for i in range(4))
        )
        total += weight
        expected += weight * np.array(state)
    assert np.allclose(good, expected / total)
    assert np.allclose(pair.sum((1, 2)), 1)


def test_lines_are_those_with_a_word():
    found = quality_crf.lines(pa.array(["a\n\n b \n", None, " \n", "c"]))
    assert found.offsets.tolist() == [0, 2, 2, 2, 3]
    assert found.weights.tolist() == [1, 3, 1]
