"""The pipeline's stages against their operators, one after the other."""

import corpus_pipeline
from lyrascope.llm import odd_sketch, quality_crf, weak_rules
from tests.llm.data import documents, frame


def test_stages_work_on_what_the_one_before_kept(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark).write.parquet(f"{folder}/documents.parquet")
    rows = [(d, int(not {"#", "$"} & set(t or ""))) for d, t, *_ in documents() if d]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def ids(df):
        return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())

    field = quality_crf.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    expected = quality_crf.keep_predicted(docs, field)
    expected = weak_rules.keep_good(expected)
    kept = {r["doc_id"] for r in odd_sketch.near_duplicates(expected).filter("kept").collect()}
    expected = sorted({str(i) for i in kept})

    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "n_tokens", "ids"]
    assert ids(result) == expected
    assert all(r["n_tokens"] == len(r["ids"]) for r in result.collect())

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == frame(spark).columns
