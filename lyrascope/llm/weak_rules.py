"""Quality rules combined by weak supervision (operator 5).

Every rule votes good, bad or abstains.  How often each rule gives each vote on good and on bad
documents is estimated by expectation-maximisation, and a document is kept if its posterior
probability of being good is at least a half.  The estimate needs only the number of documents
of each pattern of votes, at most 3 ** (number of rules) rows, which come from all documents.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import Words, binary, flat, map_chunks, runs, sums, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[list(b"#*$%&|<>")] = 1

UPPER = np.zeros(256, np.uint8)
UPPER[65:91] = 1

SIGNS = np.zeros(256, np.uint8)
SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1

# Rules: a measure, the bound at or beyond which it votes good, and the one for bad.  With
# good below bad a low value is good, otherwise a high one; between them the rule abstains.
RULES = {
    "symbols_per_word": (0.02, 0.20),
    "signs_per_char": (0.06, 0.20),
    "upper_per_char": (0.08, 0.40),
    "exclamations_per_word": (0.02, 0.30),
    "lone_signs_per_word": (0.01, 0.10),
    "repeated_words": (0.05, 0.25),
    "repeated_lines": (0.01, 0.30),
    "distinct_words": (0.30, 0.10),
    "chars_per_word_low": (3.0, 2.0),
    "chars_per_word_high": (8.0, 12.0),
}


@dataclass
class Measures:
    """Counts of the base rules and the measures that the rules look at, per text."""

    counts: dict[str, np.ndarray]
    measures: dict[str, np.ndarray]


def repeated_windows(found: Words, width: int = 3) -> np.ndarray:
    """Words inside a window of ``width`` words that its text has twice or more."""
    n = len(found.codes)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    owner = found.owner
    inside = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    if not len(inside):
        return covered
    # Numbered step by step: text and first word, then with the second word, and so on.
    window = owner[inside].astype(np.int64)
    for k in range(width):
        key = window * len(found.distinct) + found.codes[inside + k]
        window = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
    repeated = inside[np.bincount(window)[window] > 1]
    for k in range(width):
        covered[repeated + k] = True
    return covered


def duplicate_lines(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those equal to an earlier line of it."""
    within = data != 0x0A
    starts, ends = runs(offsets, data, within)
    lines = binary(ends - starts, data[within]).dictionary_encode()
    wordy = np.array([bool(line.strip()) for line in lines.dictionary.to_pylist()], bool)
    codes = lines.indices.to_numpy()
    owner = np.searchsorted(offsets, starts, "right") - 1
    use = wordy[codes] if len(codes) else np.zeros(0, bool)
    texts = len(offsets) - 1
    key = owner[use].astype(np.int64) * max(len(wordy), 1) + codes[use]
    first = np.unique(key) // max(len(wordy), 1)
    total = np.bincount(owner[use], minlength=texts)
    return total, total - np.bincount(first, minlength=texts)


def measure(texts: pa.Array) -> Measures:
    offsets, data = flat(texts)
    found = words(texts)
    n = np.diff(found.offsets)
    sizes = np.array([len(w.decode()) for w in found.distinct.to_pylist()], np.int64)
    lone = np.array([not w.strip(b"#*$%&|<>!?.,;:-_=+/") for w in found.distinct.to_pylist()])
    chars = sums(sizes[found.codes], found.offsets)
    symbols = sums(SYMBOLS[data], offsets)
    lines, duplicates = duplicate_lines(offsets, data)
    repeats = sums(repeated_windows(found).astype(np.int64), found.offsets)
    key = found.owner * max(len(sizes), 1) + found.codes
    distinct = np.bincount(np.unique(key) // max(len(sizes), 1), minlength=len(n))

    alone = sums(lone[found.codes].astype(np.int64), found.offsets)

    def share(part, whole):
        # A text without words is as bad as can be by every measure that abstains on nothing.
        return np.divide(part, whole, out=np.full(len(n), np.nan), where=whole > 0)

    letters = chars.astype(float)
    return Measures(
        dict(zip(COUNTS, (n, chars, symbols, duplicates, repeats), strict=True)),
        {
            "symbols_per_word": share(symbols, n),
            "signs_per_char": share(sums(SIGNS[data], offsets), letters),
            "upper_per_char": share(sums(UPPER[data], offsets), letters),
            "exclamations_per_word": share(sums((data == 33).astype(np.int64), offsets), n),
            "lone_signs_per_word": share(alone, n),
            "repeated_words": share(repeats, n),
            "repeated_lines": share(duplicates, lines),
            # Long texts repeat their common words, so the distinct ones count per 200 words.
            "distinct_words": share(distinct, np.minimum(n, 200)),
            "chars_per_word_low": share(chars, n),
            "chars_per_word_high": share(chars, n),
        },
    )


def votes(found: Measures) -> np.ndarray:
    """Votes by text and rule: 2 good, 0 bad, 1 abstains."""
    made = np.ones((len(found.counts["n_words"]), len(RULES)), np.int64)
    for k, (name, (good, bad)) in enumerate(RULES.items()):
        value = found.measures[name]
        if good < bad:
            made[value <= good, k], made[value >= bad, k] = 2, 0
        else:
            made[value >= good, k], made[value <= bad, k] = 2, 0
    return made


def pattern(given: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return given @ 3 ** np.arange(given.shape[1])


@dataclass
class LabelModel:
    """How often bad (0) and good (1) documents are there, and get each vote of each rule."""

    prior: np.ndarray  # class
    rates: np.ndarray  # class, rule, vote

    def posterior(self, given: np.ndarray) -> np.ndarray:
        """Probability of good for votes by text and rule."""
        score = np.log(self.prior)[:, None] + sum(
            np.log(self.rates[:, k, given[:, k]]) for k in range(given.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))


def fit_label_model(given: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over patterns of votes and their numbers of documents.

    It starts from documents with any bad vote being bad and keeps one pseudo-document per
    class, rule and vote, so that no rate is 0; without documents all rates are equal.
    """
    good = np.where((given == 0).any(1), 0.1, 0.95)
    for _ in range(rounds):
        weights = np.stack([(1 - good) * counts, good * counts])
        rates = np.ones((2, given.shape[1], 3))
        for vote in range(3):
            rates[:, :, vote] += weights @ (given == vote)
        model = LabelModel(
            (weights.sum(1) + 1) / (weights.sum() + 2), rates / rates.sum(2, keepdims=True)
        )
        good = model.posterior(given)
    return model


def fit(patterns: DataFrame) -> LabelModel:
    """Label model of a table of patterns (pattern), one row per document."""
    rows = patterns.groupBy("pattern").count().collect()
    numbers = np.array([r["pattern"] for r in rows], np.int64)
    given = numbers[:, None] // 3 ** np.arange(len(RULES)) % 3
    return fit_label_model(given, np.array([r["count"] for r in rows], float))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the pattern of votes of documents (doc_id, text)."""

    def measure_chunk(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(chunk.column("text"))
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                *(pa.array(found.counts[c].astype(np.int64)) for c in COUNTS),
                pa.array(pattern(votes(found))),
            ],
            ["doc_id", *COUNTS, "pattern"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"),
        map_chunks(measure_chunk),
        "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "pattern long",
    )


def posterior(model: LabelModel, number: Column) -> Column:
    """Probability of good by a pattern's number, in Spark's own functions."""
    ratios = np.log(model.rates[1]) - np.log(model.rates[0])
    score = F.lit(float(np.log(model.prior[1]) - np.log(model.prior[0])))
    for k in range(ratios.shape[0]):
        vote = F.pmod(F.floor(number / 3**k), F.lit(3)).cast("int")
        weights = F.array(*[F.lit(float(x)) for x in ratios[k]])
        score = score + F.get(weights, vote)
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and p_good of documents (doc_id, text).

    A narrow table of the counts is written once and gives both the model and the result.  A
    NULL or empty text has no words and fails; rows of one doc_id are judged each; further
    columns are left out; an empty table gives no rows.
    """
    table = written(measured(docs), "rules")
    good = posterior(fit(table.select("pattern")), F.col("pattern"))
    return (
        table.withColumn("base_failed", base_failed())
        .withColumn("p_good", good)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
        .select("doc_id", *COUNTS, "base_failed", "kept", "p_good")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents whose verdict is to keep them, with all their columns.

    Texts are measured twice, for the model and for the verdict, and never shuffled.
    """
    model = fit(measured(docs).select("pattern"))

    def keep(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(chunk.column("text"))
        n, repeats = found.counts["n_words"], found.counts["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        good = model.posterior(votes(found)) >= KEEP_AT
        return chunk.filter(pa.array(good & ~failed))

    return map_arrow(docs, map_chunks(keep), docs.schema)
