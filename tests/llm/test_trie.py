"""The prefix trie against one built in plain Python."""

import hashlib
import random
import zlib

import pytest

from lyrascope.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fa string"


def brute(rows):
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(built) + 1):
            nodes.setdefault(built[:d], []).append((c, d == len(built)))
    made = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [
            p for p in below if not any(len(q) > len(p) and q[: len(p)] == p for q in below)
        ]
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        smallest = min(c for c, _ in members)
        made[smallest, len(path)] = (
            min(c for c, _ in nodes[path[:-1]]) if path else None,
            len(members),
            len(children),
            len(leaves),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return made


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    made = [tuple(r) for r in prefix_trie.trie(table).drop("ref").collect()]
    got = {r[:2]: r[2:] for r in made}
    assert len(got) == len(made)
    return got


def conversations(seed, n=60, texts=3):
    rng = random.Random(seed)
    ids = [rng.randrange(0, 300) for _ in range(n)] + [100, 200]
    return [
        (c, turn, rng.choice(["user", "assistant"]), "é" * rng.randrange(texts))
        for c in set(ids)
        for turn in range(rng.randrange(1, 9))
    ]


HARD = [
    (7, None, None, None),
    (7, 1, "user", ""),
    (107, 3, "", None),
    (None, 1, "user", "of nobody"),
    (-3, 1, "user", "x"),
    (-103, 1, "user", "x"),
    (5, -4, "user", "late"),
    (5, 9, "user", "y" * 5000),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_the_plain_trie(spark, seed):
    rows = conversations(seed) + HARD
    assert found(spark, rows) == brute(rows)


def test_copies_of_a_conversation_and_long_ones_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    long = [(c, t, "user", f"t{t % 7}") for c in (4, 8, 11, 300) for t in range(40)]
    copies = [(c, t, "user", "same") for c in range(400, 440) for t in range(3)]
    rows = conversations(3, 20) + long + copies
    assert found(spark, rows) == brute(rows)


def test_no_conversations_have_no_nodes(spark):
    assert found(spark, []) == {}


def test_shared_fingerprints_are_noticed_and_other_powers_tried(spark, monkeypatch):
    turn = prefix_trie.Powers.turn

    def careless(self, role, text):
        # The first seed takes all turns for one.
        values = turn(self, role, text)
        return [v * 0 for v in values] if self.seed == 1 else values

    monkeypatch.setattr(prefix_trie.Powers, "turn", careless)
    rows = conversations(4, 10)
    assert found(spark, rows) == brute(rows)


def test_references_lead_to_the_last_turn(spark):
    rows = conversations(5, 30)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    by_conv = {}
    for c, turn, role, text in sorted(rows):
        by_conv.setdefault(c, []).append((role, text))
    for node in prefix_trie.trie(table).collect():
        if node["depth"]:
            base = by_conv.get(node["conv_id"] - node["conv_id"] % 100, [])
            h = zlib.crc32(str(node["conv_id"]).encode()) % 6
            built = base[:h] + by_conv[node["conv_id"]][h:]
            conv_id, place = node["ref"]
            assert by_conv[conv_id][place - 1] == built[node["depth"] - 1]
