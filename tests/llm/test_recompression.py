"""Removal of repeated windows against brute force, and the anchors it rests on."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lyrascope.llm import recompression
from lyrascope.llm.text import words
from tests.llm.data import WORD, documents, frame, prose


def brute(rows, window=13):
    """Every document by its text: words, removed words, hash of the kept ones."""
    smallest = {}
    split = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, ws in split:
        for i in range(len(ws) - window + 1 if d is not None else 0):
            key = tuple(ws[i : i + window])
            smallest[key] = min(d, smallest.get(key, d))
    made = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1 if d is not None else 0):
            if smallest[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        made.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(made, key=repr)


def passages(seed):
    """Documents cut from common passages, periodic texts, runs, and much of few words."""
    rng = random.Random(seed)
    common = [prose(i, 60).split() for i in range(6)]
    few = "a b c".split()
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(common)
            a = rng.randrange(len(p) - 10)
            kind = rng.random()
            if kind < 0.5:
                parts += p[a : a + rng.randrange(8, 40)]
            elif kind < 0.6:
                parts += rng.choices(few, k=rng.randrange(40))
            elif kind < 0.7:
                parts += ["run"] * rng.randrange(30)
            elif kind < 0.8:
                parts += ["x", "y"] * rng.randrange(20)
            else:
                parts += prose(1000 + d, 30).split()
        rows.append((rng.randrange(10_000), rng.choice(" \n\t").join(parts), "en", "s", 0))
    return rows


def got(frame_, **settings):
    made = recompression.digests(frame_, **settings).collect()
    return sorted([tuple(r) for r in made], key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_that_repeat_are_removed(spark, seed):
    rows = passages(seed) + documents()
    table = frame(spark, rows).repartition(1 + 6 * (seed % 2))
    assert got(table, per_task=(1 << 20, 500, 64)[seed - 1]) == brute(rows)


@pytest.mark.parametrize("window, rounds, phrase", [(5, 1, 2), (13, 0, 1), (20, 4, 3), (1, 2, 2)])
def test_other_windows_and_rounds(spark, window, rounds, phrase):
    rows = passages(window)
    settings = {"window": window, "rounds": rounds, "phrase": phrase}
    assert got(frame(spark, rows), **settings) == brute(rows, window)


def test_kept_text_and_spans(spark):
    ws = prose(1, 40).split()
    rows = [(1, " ".join(ws), "", "", 0), (2, "own " + "\n".join(ws[:20]) + " end", "", "", 0)]
    table = frame(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "start")
    _, second = sorted(recompression.remove_repeats(table).collect())
    assert second["kept"] == "own end"
    assert [tuple(s) for s in second["removed"]] == [(1, 21)]


def test_no_documents_keep_nothing(spark):
    assert recompression.digests(frame(spark, [])).count() == 0


def test_many_copies_and_a_long_text(spark):
    long = " ".join(prose(i, 200) for i in range(200))
    rows = [(i, prose(5), "", "", 0) for i in range(400)] + [(1000, long, "", "", 0)]
    rows.append((1001, "new start " + long[5000:], "", "", 0))
    assert got(frame(spark, rows).repartition(3)) == brute(rows)


def test_equal_windows_have_equal_anchors_whatever_is_around():
    rng = random.Random(5)
    pool = [*"abcde", *prose(3, 40).split()]
    window = [rng.choices(pool, k=13) for _ in range(50)] + [["a"] * 13, ["a", "b"] * 6 + ["a"]]
    for inner in window:
        seen = set()
        for _ in range(8):
            before, after = (rng.choices([*pool, inner[0]], k=rng.randrange(20)) for _ in "xy")
            w = words(pa.array([" ".join([*before, *inner, *after])]))
            first, _ = recompression._hashes(w.distinct.to_pylist())
            levels = recompression.parse(first[w.codes], w.codes, w.owner, 2)
            letters = np.arange(len(w.codes) + 1)
            seen.add(recompression.anchors(levels, letters)[len(before)])
        assert len(seen) == 1
