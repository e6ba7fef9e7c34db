import random

import pytest
from pyspark.sql import functions as F

from lyrascope.operators.repeats import (
    compare_repeat_rules,
    exclude_repeats,
    find_repeats,
    keep_first_copy,
    repeat_table,
)
from lyrascope.operators.skew import id_buckets, number_rows, salted_join, top_rows


@pytest.mark.parametrize("heavy_rows", [1, 3, 1000])
def test_salted_join_equals_plain_join(spark, heavy_rows):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}") for i in range(300)]
    probe = spark.createDataFrame(rows, "id long, k string")
    build = spark.createDataFrame(
        [("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 20, 2)], "k string, v double"
    )
    for how in ("inner", "left"):
        got = salted_join(probe, build, ["k"], "id", how, heavy_rows=heavy_rows)
        expected = probe.join(build, ["k"], how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(
            map(str, expected.select("id", "k", "v").collect())
        )


def test_number_rows_across_buckets(spark):
    rng = random.Random(2)
    groups = ["a", "b", None]
    ids = [rng.randint(-(2**62), 2**62) >> rng.choice([0, 30, 50]) for _ in range(500)]
    rows = list({(rng.choice(groups), i) for i in ids})
    df = spark.createDataFrame(rows, "g string, id long")
    numbered = number_rows(df, ["g"], id_buckets("id"), [F.col("id")], "n")
    got = {(r.g, r.id): r.n for r in numbered.collect()}
    assert len(got) == len(rows)
    for g in groups:
        for n, i in enumerate(sorted(i for h, i in rows if h == g), 1):
            assert got[(g, i)] == n


def test_top_rows(spark):
    rows = [("a", f"t{i}", float(i % 50)) for i in range(200)] + [("b", "x", 1.0)]
    df = spark.createDataFrame(rows, "g string, term string, w double")
    got = top_rows(df, ["g"], [F.desc("w"), F.col("term")], 7, "term", "rank").collect()
    expected = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[2], r[1]))[:7]
    assert sorted((r.rank, r.term) for r in got if r.g == "a") == [
        (i, r[1]) for i, r in enumerate(expected, 1)
    ]
    assert [r.rank for r in got if r.g == "b"] == [1]


@pytest.mark.parametrize("heavy_rows", [2, 1000])
def test_find_repeats(spark, heavy_rows):
    rows = [("cs", i, "same") for i in (7, 3, 5, 9, 11)] + [
        ("cs", 1, "other"),
        ("nl", 2, "same"),
        ("nl", 4, "pair"),
        ("nl", 6, "pair"),
    ]
    songs = spark.createDataFrame(rows, "language string, text_id long, text_key string")
    got = find_repeats(songs, heavy_rows).collect()
    assert sorted((r.language, r.keep_id, r.dup_id) for r in got) == [
        ("cs", 3, 5),
        ("cs", 3, 7),
        ("cs", 3, 9),
        ("cs", 3, 11),
        ("nl", 4, 6),
    ]


def test_keep_first_copy_keeps_nulls_of_the_first(spark):
    rows = [("cs", 1, "t", None, 2), ("cs", 2, "t", "yes", 3), ("cs", 3, "u", "no", None)]
    songs = spark.createDataFrame(
        rows, "language string, text_id long, text_key string, h string, r int"
    )
    got = keep_first_copy(songs, ["h", "r"], {"n": F.count("*"), "total": F.sum("r")})
    assert sorted(map(tuple, got.select("text_id", "h", "r", "n", "total").collect())) == [
        (1, None, 2, 2, 5),
        (3, "no", None, 1, None),
    ]


def test_repeat_rules_differ_where_ids_are_not_consecutive(spark):
    listed = repeat_table(spark, {"cs": (1, 3), "nl": (1, 2)})
    songs = spark.createDataFrame(
        [("cs", 1, 1), ("cs", 2, 3), ("cs", 3, 5), ("nl", 1, 1), ("nl", 2, 2)],
        "language string, position int, text_id int",
    )
    got = {r.language: tuple(r)[1:] for r in compare_repeat_rules(songs, listed).collect()}
    assert got == {"cs": (1, 1, 2), "nl": (1, 1, 0)}
    by_id = exclude_repeats(songs, listed).filter("language = 'cs'").collect()
    by_position = exclude_repeats(songs, listed, "position").filter("language = 'cs'").collect()
    assert sorted(r.text_id for r in by_id) == [1, 5]
    assert sorted(r.text_id for r in by_position) == [1, 3]
