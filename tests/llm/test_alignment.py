"""Token alignment against the two libraries and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lyrascope.llm import token_alignment
from tests.llm.data import documents, frame, prose

CODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(
    model_file=public_tokenizers.path("piece_bpe_32k.model")
)


def letters():
    """The bytes of the byte-level letters: printable ones are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


LETTERS = letters()


def tokens_of(text):
    if not text:
        return [], []
    ids = CODER.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(LETTERS[c] for c in CODER.id_to_token(i))) for i in ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()
        b.append((i, raw))
    whole = (" " + text).encode()
    if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return [], []
    return a, b


def brute(rows):
    counts, made = Counter(), []
    for doc_id, text, *_ in rows:
        a, b = tokens_of(text)
        ends_a = np.cumsum([0] + [len(t) for _, t in a]).tolist()[1:]
        ends_b = np.cumsum([0] + [len(t) for _, t in b]).tolist()[1:]
        common = sorted(set(ends_a) & set(ends_b))
        by_a, by_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        links = [(by_a[e][0], by_b[e][0]) for e in common]
        counts.update(links)
        parts, left_a, left_b = [], list(zip(ends_a, a))[::-1], list(zip(ends_b, b))[::-1]
        for e in common:
            sides = []
            for left in (left_a, left_b):
                side = []
                while left and left[-1][0] <= e:
                    side.append(str(left.pop()[1][0]))
                sides.append(",".join(side))
            parts.append("|".join(sides))
        made.append((doc_id, len(a), len(b), links, ";".join(parts)))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    rows = [
        (
            doc_id,
            n_a,
            n_b,
            len(links),
            len(links),
            sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        )
        for doc_id, n_a, n_b, links, text in made
    ]
    return sorted(rows, key=repr), counts, highest, {m[0]: m[4] for m in made}


@pytest.fixture(scope="module")
def expected():
    return brute(documents())


@pytest.mark.parametrize("parts, per_task", [(1, 1 << 20), (7, 100), (90, 1000)])
def test_documents_add_up_the_counts_of_the_corpus(spark, expected, parts, per_task):
    table = frame(spark).withColumnRenamed("lang", "n_a").withColumnRenamed("source", "run")
    got = token_alignment.align(table.repartition(parts), per_task=per_task).collect()
    assert sorted([tuple(r) for r in got], key=repr) == expected[0]


def test_pairs_and_groups(spark, expected):
    _, counts, highest, groups = expected
    got = token_alignment.pair_counts(frame(spark).repartition(3), per_task=500).collect()
    assert {(r["id_a"], r["id_b"]): (r["n"], r["best"]) for r in got} == {
        k: (n, n == highest[k[1]]) for k, n in counts.items()
    }
    assert len(got) == len(counts)
    made = {r["doc_id"]: r["groups"] for r in token_alignment.groups(frame(spark)).collect()}
    assert made == groups


def test_texts_that_do_not_come_back_have_no_tokens(spark):
    rows = [(1, "a▁b", "", "", 0), (2, "", "", "", 0), (3, None, "", "", 0), (4, " a  b", "", "", 0)]
    got = {r["doc_id"]: r for r in token_alignment.align(frame(spark, rows)).collect()}
    for doc_id in (1, 2, 3):
        assert tuple(got[doc_id])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[4]["n_a"] and got[4]["groups_sha256"]


def test_no_documents(spark):
    assert token_alignment.align(frame(spark, [])).count() == 0
    assert token_alignment.pair_counts(frame(spark, [])).count() == 0


def test_a_very_long_text(spark):
    text = "ab" * 300_000 + "\n" + prose(1, 20_000)
    (got,) = token_alignment.align(frame(spark, [(1, text, "", "", 0)])).collect()
    assert [tuple(got)] == brute([(1, text)])[0]


def test_merging_sums_equal_keys_over_runs(monkeypatch):
    monkeypatch.setattr(token_alignment, "STEP", 3)
    monkeypatch.setattr(token_alignment, "FAN_IN", 4)
    rng = np.random.default_rng(1)
    total, runs = Counter(), []
    for _ in range(23):
        keys = np.unique(rng.integers(0, 60, rng.integers(1, 40))) << 18
        counts = rng.integers(1, 9, len(keys))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append((token_alignment._steps(keys), token_alignment.squeeze(counts)))
    keys, counts, best = token_alignment.count_part(runs)
    assert dict(zip(keys.tolist(), counts.tolist())) == total
    assert (np.diff(keys) > 0).all()
    by_b = {}
    for k, n in total.items():
        by_b[k >> token_alignment.A_BITS] = max(n, by_b.get(k >> token_alignment.A_BITS, 0))
    assert best.tolist() == [n == by_b[k >> token_alignment.A_BITS] for k, n in sorted(total.items())]
