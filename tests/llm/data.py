"""Small documents for the operators' tests: prose, copies, junk and hard cases."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

# NULL, empty, blank, short, repeated, odd characters, special strings, one very long word.
HARD = [
    None,
    "",
    "  \n\t ",
    "a",
    "a b",
    "A B",
    "a b c a b c a b c",
    "x\r\nx\r\n y",
    "line\nline \nline\n\nline",
    "é # | <> É ß ́x ﬁ",
    "日本語 のテキスト 😀😀",
    "<|endoftext|> a<|endoftext|>b <s> </s> <0x41>",
    "▁▁x a▁b",
    "\x00a \x85b 　 c \xa0d",
    "it's we'LL don't 12 345,678.",
    "x" * 5000,
    " " * 60 + "q",
    "w " * 300,
]

SYLLABLES = "ba de ki lo mu na pe ri so tu va we".split()


def prose(seed: int, words: int = 120) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i : i + 20]).capitalize() + "." for i in range(0, words, 20)]
    return "\n".join(lines)


def junk(seed: int, words: int = 120) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choices(SYLLABLES, k=3)) + rng.choice(("###", "$$$")) for _ in range(words)]
    return " ".join(made)


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows with a hot source and copies."""
    texts = HARD + [prose(i) for i in range(60)] + [junk(i) for i in range(12)]
    texts += [prose(3)] * 8 + [prose(4).upper()]
    for k in range(12):
        words = prose(7, 200).split(" ")
        words[10 + k] = f"edit{k}"
        texts.append(" ".join(words))
    rows = [
        (i * 3 + 1, t, "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}", len(t or ""))
        for i, t in enumerate(texts)
    ]
    return [*rows, rows[20], (None, prose(99), "en", "hot", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
