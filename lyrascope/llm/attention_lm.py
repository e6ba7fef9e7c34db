"""Scoring texts by a causal self-attention model over subword ids (operator 1).

Words are lower-cased and coded alone, with a space before them, by a byte-level tokenizer.
The most frequent ids have a slot each; the others share two slots and are told apart by their
smoothed counts, on which the counts of what follows each id lean.  At each place the model attends to the SPAN places up to it, through queries
and keys of their ids and a bias for the distance.  What a place contributes is a distribution
over the next slot: that of what follows its id directly, after a gap of one, or further on; the
nearest place knows the place before it, if the two are one of the PAIRS most frequent pairs,
and its word so far, if frequent words begin like that.
The mean of these distributions under the attention weights, with a last share for the plain
frequencies, is the model's distribution, so no further normalisation is needed.

Pairs of ids of which one has no slot of its own are counted in a table that grows with the
corpus.  After an id without a slot, the next id's probability is that of its pairs, which leans on
the model's; after one with a slot, so is the share of an id in its shared slot.  The most frequent
of these pairs are sent to the tasks, and the others are joined by pair.

The distributions are counted from all training texts.  Queries, keys and biases are trained on
all training texts as well: every partition makes one pass of gradient steps in numpy over its
windows, and the results are averaged by their numbers of ids.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.bit_packing import WordEncoder
from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import chunks, map_chunks, sums, words

TOKENIZER = "byte_bpe_50k.json"
HELD_OUT = (7, 2)  # crc32 of the doc_id modulo the first is the second

SLOTS = 1024
# Ids without a slot share two, by whether a word starts with them.
RARE_START, RARE, END, PAD = SLOTS - 3, SLOTS - 2, SLOTS - 1, SLOTS

SPAN = 6  # places attended to
WINDOW = 64  # places scored by a window, which has SPAN - 1 more before them
WINDOWS = 1024  # windows in a batch
PLACES = 1 << 18  # places whose direct probabilities are worked out at once
DIMENSION = 8
RATE = 0.03
KINDS = 3  # next, after a gap of one, further on
WORD_SMOOTHING = 10.0
PAIRS = 8192

# A word is frequent if it makes up more than one in FREQUENT words; there are fewer than
# FREQUENT such words, which bounds the table that is broadcast.
FREQUENT = 1 << 19

# Likewise for the pairs of ids that the slots do not tell apart, which are sent to every task.
FREQUENT_PAIRS = 1 << 21
HELD_PAIRS = 1 << 20  # different pairs that a task holds before it passes their counts on
END_ID = 0xFFFF  # in a pair of ids, what is before a text and after it
GROUPS = 3  # of the next ids after one: all, or those of either shared slot


@cache
def encoder(name: str) -> WordEncoder:
    return WordEncoder(name, before=" ")


@dataclass
class Slots:
    """Slot of each id, its log10 probability within a shared slot, and which slots start words."""

    of: np.ndarray
    within: np.ndarray
    starts: np.ndarray


def choose_slots(counts: np.ndarray, starting: np.ndarray) -> Slots:
    """Slots for the most frequent ids; equal counts go by id."""
    order = np.argsort(-counts, kind="stable")[:RARE_START]
    of = np.where(starting, RARE_START, RARE).astype(np.int32)
    of[order] = np.arange(len(order))
    within = np.zeros(len(counts))
    for shared in (RARE_START, RARE):
        own = of == shared
        within[own] = np.log10((counts[own] + 1) / (counts[own] + 1).sum())
    starts = np.zeros(SLOTS, bool)
    starts[: len(order)] = starting[order]
    starts[[RARE_START, END]] = True
    return Slots(of, within, starts)


def kinds_of_ids(slots: Slots) -> np.ndarray:
    """By id, also END_ID: 0 with a slot of its own, else 1 or 2 by the shared slot."""
    kind = np.zeros(END_ID + 1, np.uint8)
    kind[: len(slots.of)] = np.where(
        slots.of == RARE_START, 1, np.where(slots.of == RARE, 2, 0)
    )
    return kind


def pairs_of_ids(
    ids: np.ndarray, counts: np.ndarray, kind: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of texts, with their ends, that slots alone do not tell, and pair and context.

    These are the places whose id, or the one before, has no slot of its own.  A context is an id
    with a group of next ids: all of them after an id without a slot, else a shared slot's.
    """
    stream = np.insert(ids, np.cumsum(counts), END_ID).astype(np.int64)
    last = np.r_[END_ID, stream[:-1]]
    last[np.cumsum(counts + 1) - counts - 1] = END_ID
    shared, after = kind[stream], kind[last] > 0
    place = np.flatnonzero(after | (shared > 0))
    last = last[place]
    group = np.where(after[place], 0, shared[place])
    return place, (last << 16) | stream[place], last * GROUPS + group


@dataclass
class IdPairs:
    """Counts of pairs of ids that slots do not tell apart.

    By context, ``seen`` has the places it was counted at and ``different`` its different next
    ids, by which a count leans on the model without the pairs.
    """

    kind: np.ndarray
    seen: np.ndarray
    different: np.ndarray
    pair: np.ndarray  # the frequent ones, sorted
    n: np.ndarray
    is_whole: bool  # whether all pairs are frequent

    def at_places(
        self, ids: np.ndarray, counts: np.ndarray, p: np.ndarray, within: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """Places and their texts, what the pairs add to the log10 probability there, the pairs,
        their odds, and whether they are frequent.

        ``p`` has the slots' probability of each place.  A pair that is not frequent adds another
        log10(1 + its count / its odds).
        """
        place, pair, context = pairs_of_ids(ids, counts, self.kind)
        known = self.different[context] > 0
        place, pair, context = place[known], pair[known], context[known]
        owner = np.searchsorted(np.cumsum(counts + 1), place, "right")
        # Ends, which are no ids, lie between the texts; they have a slot alone.
        is_id = (pair & END_ID) != END_ID
        log_share = np.zeros(len(place))
        log_share[is_id] = within[ids[(place - owner)[is_id]]]
        before = np.power(10.0, log_share) * np.where(context % GROUPS == 0, p[place], 1.0)
        seen, different = self.seen[context], self.different[context]
        odds = different * before
        logs = np.log10(different / (seen + different))
        found = np.zeros(len(pair), bool)
        if len(self.pair):
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            found = self.pair[at] == pair
            logs[found] += np.log10(1 + self.n[at[found]] / odds[found])
        return place, owner, logs, pair, odds, found

    def added(
        self, ids: np.ndarray, counts: np.ndarray, p: np.ndarray, within: np.ndarray
    ) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What the pairs add to each text, and texts, pairs and odds of those left over."""
        _, owner, logs, pair, odds, found = self.at_places(ids, counts, p, within)
        left = np.flatnonzero(~found) if not self.is_whole else np.empty(0, np.int64)
        total = np.bincount(owner, weights=logs, minlength=len(counts))
        return total, (owner[left], pair[left], odds[left])


@dataclass
class WordTree:
    """Frequent words by their slots: counts of those that begin so, and that end there.

    ``others`` counts the words that begin so and are none of the frequent ones.
    """

    edges: np.ndarray  # parent * SLOTS + slot, sorted
    child: np.ndarray
    through: np.ndarray  # by node; the root is 0
    ends: np.ndarray
    others: np.ndarray

    @classmethod
    def of(cls, words_slots: list[list[int]], counts: list[int]) -> "WordTree":
        node_of: dict[int, int] = {}
        through, ends = [0], [0]
        for slots, n in zip(words_slots, counts, strict=True):
            node = 0
            for slot in slots:
                edge = node * SLOTS + slot
                node = node_of.setdefault(edge, len(through))
                if node == len(through):
                    through.append(0)
                    ends.append(0)
                through[node] += n
            ends[node] += n
        edges = np.array(sorted(node_of), np.int64)
        child = np.array([node_of[e] for e in edges.tolist()], np.int64)
        none = np.zeros(len(ends))
        return cls(edges, child, np.array(through, float), np.array(ends, float), none)

    def step(self, node: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Nodes below, 0 for none."""
        if not len(self.edges):
            return np.zeros(len(node), np.int64)
        edge = node * SLOTS + slot
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, self.child[at], 0)

    def nodes(self, stream: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Node of each place's word so far, 0 where no frequent word begins like that."""
        first = np.zeros(len(stream), bool)
        first[np.cumsum(counts + 1) - counts - 1] = True
        begins = starts[stream] | first
        place = np.arange(len(stream))
        depth = place - np.maximum.accumulate(np.where(begins, place, 0))
        node = np.zeros(len(stream), np.int64)
        at = np.flatnonzero(begins)
        # Words begin below the root, whose edges are the first ones.
        root, n = np.zeros(SLOTS, np.int64), np.searchsorted(self.edges, SLOTS)
        root[self.edges[:n]] = self.child[:n]
        node[at] = root[stream[at]]
        level = 1
        while True:
            at = at[(at + 1 < len(stream))] + 1
            at = at[depth[at] == level]
            at = at[node[at - 1] > 0]
            if not len(at):
                return node
            node[at] = self.step(node[at - 1], stream[at])
            level += 1


def batches_of(
    stream: np.ndarray,
    counts: np.ndarray,
    direct: np.ndarray | None = None,
    windows: int | None = WINDOWS,
) -> Iterator[tuple]:
    """Places of texts, one after the other: inputs, targets, direct probabilities, and texts.

    ``stream`` has the slots of all texts, each with END behind it, ``counts`` their numbers
    without it.  Row k of the inputs has the slot that lies k + 1 places before each target: END
    before the first one of a text, PAD further out.  A text is cut into windows of WINDOW
    places; a batch has the places of ``windows`` windows, or all of them.
    """
    sizes = counts + 1
    begin = np.cumsum(sizes) - sizes
    n = -(-sizes // WINDOW)
    ends = np.cumsum(n)
    number = np.arange(0, ends[-1], windows or ends[-1]) if len(n) else np.empty(0, np.int64)
    text = np.searchsorted(ends, number, "right")
    starts = begin[text] + (number - ends[text] + n[text]) * WINDOW
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), sizes)
    last = before(stream, counts).astype(np.int32)
    for at, end in zip(starts, [*starts[1:], len(stream)], strict=True):
        own = owner[at:end]
        place = np.arange(at, end) - begin[own]
        inputs = np.full((SPAN, end - at), PAD, np.int32)
        for k in range(SPAN):
            skip = max(k - at, 0)
            inputs[k, skip:] = last[at + skip - k : end - k]
            inputs[k, place < k] = PAD
        yield inputs, stream[at:end], None if direct is None else direct[at:end], own


def count_tables(total: np.ndarray, inputs: np.ndarray, goal: np.ndarray) -> None:
    """Add a batch's (kind, slot, next slot) counts."""
    cells = SLOTS * SLOTS
    for k, seen in enumerate(inputs):
        kind = min(k, KINDS - 1)
        # The last cells are those of PAD, which is no slot.
        found = np.bincount(seen.astype(np.int64) * SLOTS + goal, minlength=cells + SLOTS)
        total[kind * cells : (kind + 1) * cells] += found[:cells]


def choose_pairs(tables: np.ndarray) -> np.ndarray:
    """Number of each of the PAIRS most frequent (slot, next slot), PAIRS for the others."""
    counts = tables[: SLOTS * SLOTS]
    order = np.argsort(-counts, kind="stable")[:PAIRS]
    order = order[counts[order] > 0]
    number = np.full(SLOTS * SLOTS, PAIRS, np.int32)
    number[order] = np.arange(len(order))
    return number


def before(stream: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slot before each place; END before the first one of a text."""
    made = np.r_[END, stream[:-1]]
    made[np.cumsum(counts + 1) - counts - 1] = END
    return made


def pairs_before(number: np.ndarray, stream: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of the pair of slots before each place, PAIRS where there is none."""
    last = before(stream, counts).astype(np.int64)
    pair = np.r_[PAIRS, number[last[:-1] * SLOTS + stream[:-1]]]
    pair[np.cumsum(counts + 1) - counts - 1] = PAIRS
    return pair


def count_pairs(total: np.ndarray, number: np.ndarray, stream: np.ndarray, counts) -> None:
    """Add the (pair, next slot) counts of texts."""
    pair = pairs_before(number, stream, counts).astype(np.int64)
    ok = pair < PAIRS
    np.add.at(total, pair[ok] * SLOTS + stream[ok], 1)


@dataclass
class Values:
    """What places contribute: next-slot distributions by kind, by pair, by word, and plain."""

    kinds: np.ndarray
    pairs: np.ndarray
    number: np.ndarray
    plain: np.ndarray
    tree: WordTree
    starts: np.ndarray
    start_share: np.ndarray  # by slot, and by pair, how much of what follows starts a word
    pair_share: np.ndarray

    def direct(self, stream: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each place by the nearest place, which knows its pair and its word.

        About PLACES places are worked on at once, whole texts each.
        """
        made = np.empty(len(stream), np.float32)
        ends = np.cumsum(counts + 1)
        piece = ends // PLACES
        cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else []
        for first, last in zip(cuts, [*cuts[1:], len(counts)], strict=True):
            at = slice(ends[first] - counts[first] - 1, ends[last - 1])
            made[at] = self._direct(stream[at], counts[first:last])
        return made

    def _direct(self, stream: np.ndarray, counts: np.ndarray) -> np.ndarray:
        last = before(stream, counts)
        pair = pairs_before(self.number, stream, counts)
        follows, share = self.kinds[0][last, stream], self.start_share[last]
        at = np.flatnonzero(pair < PAIRS)
        follows[at] = self.pairs[pair[at], stream[at]]
        share[at] = self.pair_share[pair[at]]
        node = self.tree.nodes(stream, counts, self.starts)
        known = np.r_[0, node[:-1]]
        known[np.cumsum(counts + 1) - counts - 1] = 0
        others = np.where(known > 0, self.tree.others[known], 0.0) + WORD_SMOOTHING
        total = np.where(known > 0, self.tree.through[known], 0.0) + others
        on = np.where(node > 0, self.tree.through[node], 0.0)
        new = self.tree.ends[known] * follows / share
        held = np.where(known > 0, np.where(self.starts[stream], new, on), 0.0)
        return ((held + others * follows) / total).astype(np.float32)


def leaning(counts: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Distributions from counts that lean on others by the number of different next slots."""
    held = counts.astype(np.float32)
    kinds = np.maximum((held > 0).sum(1, keepdims=True), 1).astype(np.float32)
    total = held.sum(1, keepdims=True)
    held += kinds * on
    held /= total + kinds
    return held


def distributions(
    tables: np.ndarray, number: np.ndarray, pairs: np.ndarray, tree: WordTree, starts: np.ndarray
) -> Values:
    """Distributions from counts; pairs lean on their last slot, slots on the plain counts."""
    counts = tables.reshape(KINDS, SLOTS, SLOTS)
    plain = ((counts[0].sum(0) + 0.5) / (counts[0].sum() + 0.5 * SLOTS)).astype(np.float32)
    # A padded place has no say; its row is there to be looked up.
    none = np.full((1, SLOTS), 1 / SLOTS, np.float32)
    kinds = np.stack([np.concatenate([leaning(c, plain), none]) for c in counts])
    last = np.zeros(PAIRS, np.int64)
    chosen = np.flatnonzero(number < PAIRS)
    last[number[chosen]] = chosen % SLOTS
    by_pair = leaning(pairs.reshape(PAIRS, SLOTS), kinds[0][last])
    shares = kinds[0][:, starts].sum(1), by_pair[:, starts].sum(1)
    return Values(kinds, by_pair, number, plain, tree, starts, *shares)


@dataclass
class Attention:
    """Queries and keys of the slots, biases of the distances and of the plain frequencies."""

    query: np.ndarray
    key: np.ndarray
    distance: np.ndarray
    plain: np.ndarray

    @classmethod
    def start(cls) -> "Attention":
        drawn = np.random.default_rng(1).normal(0, 0.1, (2, SLOTS, DIMENSION))
        bias = np.r_[2.0, 0.5, np.full(SPAN - 2, -1.5)]
        return cls(drawn[0], drawn[1], bias, np.full(SLOTS, -1.0))

    def vector(self) -> np.ndarray:
        parts = (self.query, self.key, self.distance, self.plain)
        return np.concatenate([part.ravel() for part in parts])

    @classmethod
    def of(cls, vector: np.ndarray) -> "Attention":
        n = SLOTS * DIMENSION
        return cls(
            vector[:n].reshape(SLOTS, DIMENSION),
            vector[n : 2 * n].reshape(SLOTS, DIMENSION),
            vector[2 * n : 2 * n + SPAN],
            vector[2 * n + SPAN :],
        )

    def scores(self) -> np.ndarray:
        """Attention scores by query and key slot; PAD is masked."""
        table = np.full((SLOTS, SLOTS + 1), -1e4, np.float32)
        table[:, :SLOTS] = self.query @ self.key.T
        return table


def attend(scores, distance, plain_bias, values: Values, inputs, goal, direct):
    """Weights, contributions and probability of each scored place.

    The last of the SPAN + 1 rows is the share of the plain frequencies.
    """
    seen, goal = inputs.astype(np.int64), goal.astype(np.int64)
    here, n = seen[0], len(goal)
    weight = np.empty((SPAN + 1, n), np.float32)
    for k in range(SPAN):
        weight[k] = np.take(scores, here * (SLOTS + 1) + seen[k]) + distance[k]
    weight[SPAN] = plain_bias[here]
    weight -= weight.max(0)
    np.exp(weight, out=weight)
    weight /= weight.sum(0)
    given = np.empty_like(weight)
    given[0] = direct
    for k in range(1, SPAN):
        given[k] = np.take(values.kinds[min(k, KINDS - 1)], seen[k] * SLOTS + goal)
    given[SPAN] = values.plain[goal]
    p = np.einsum("ij,ij->i", weight.T.copy(), given.T.copy())
    return seen, weight, given, p, slice(None)


def train(values: Values, windows: Iterator[tuple]) -> tuple[np.ndarray, int]:
    """One pass of Adam over windows from the common start: parameters and places seen."""
    vector = Attention.start().vector()
    first, second = np.zeros_like(vector), np.zeros_like(vector)
    seen_places = step = 0
    for inputs, goal, direct, _ in windows:
        now = Attention.of(vector)
        seen, weight, given, p, _ = attend(
            now.scores(), now.distance.astype(np.float32), now.plain, values, inputs, goal, direct
        )
        if not len(p):
            continue
        slope = weight * (given / p - 1)
        here = seen[0]
        by_place = slope[:SPAN].T.copy()
        pair = np.bincount(
            (here * (SLOTS + 1) + seen).T.ravel(),
            weights=by_place.ravel(),
            minlength=SLOTS * (SLOTS + 1),
        ).reshape(SLOTS, SLOTS + 1)[:, :SLOTS]
        gradient = np.concatenate(
            [
                (pair @ now.key).ravel(),
                (pair.T @ now.query).ravel(),
                by_place.sum(0),
                np.bincount(here, weights=slope[SPAN], minlength=SLOTS),
            ]
        ) / len(p)
        step += 1
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        update = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        vector = vector + RATE * update
        seen_places += len(p)
    return vector, seen_places


@dataclass
class LanguageModel:
    """All that scoring needs but the pairs of ids that are not frequent."""

    slots: Slots
    values: Values
    attention: Attention
    id_pairs: IdPairs | None = None

    def log10_probabilities(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included, without what pairs left over add."""
        return self.scored(ids, counts)[0]

    def scored(
        self, ids: np.ndarray, counts: np.ndarray
    ) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """log10 probability of each text, and the texts, pairs and odds of the pairs left over."""
        stream = with_ends(self.slots.of[ids], counts)
        total = sums(self.slots.within[ids], np.r_[0, np.cumsum(counts)])
        scores = self.attention.scores()
        distance = self.attention.distance.astype(np.float32)
        direct = self.values.direct(stream, counts)
        found, at = np.empty(len(stream), np.float32), 0
        for inputs, goal, given, own in batches_of(stream, counts, direct):
            p = attend(scores, distance, self.attention.plain, self.values, inputs, goal, given)[3]
            total += np.bincount(own, weights=np.log10(p), minlength=len(counts))
            found[at : at + len(p)] = p
            at += len(p)
        if self.id_pairs is None:
            return total, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        added, left = self.id_pairs.added(ids, counts, found, self.slots.within)
        return total + added, left


def with_ends(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slots of texts with END behind each text."""
    return np.insert(slots, np.cumsum(counts), END)


def _held_out() -> F.Column:
    divisor, rest = HELD_OUT
    # A NULL doc_id is in no fold, and its text is learnt from.
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def _base_counts(texts: DataFrame) -> DataFrame:
    """word and c of all training texts; the end of a text is the empty word."""

    def count(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = words(chunk.column("text"), lower=True)
        n = np.bincount(found.codes, minlength=len(found.distinct))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([found.distinct.cast(pa.binary()), pa.array([b""])]),
                pa.array(np.r_[n, chunk.num_rows], pa.int64()),
            ],
            ["word", "n"],
        )

    learnt = texts.filter("NOT held_out").select("text")
    counted = map_arrow(learnt, map_chunks(count), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def _coded(texts: DataFrame, frequent: dict[bytes, int], tokenizer: str) -> DataFrame:
    """Per text its ids, and the base figures of its frequent words with the words left over."""
    table = texts.sparkSession.sparkContext.broadcast(frequent)

    def code(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = words(chunk.column("text"), lower=True)
        ids, lengths = encoder(tokenizer).ids(found.distinct, found.codes)
        counts = sums(lengths, found.offsets)
        raw = found.distinct.to_pylist()
        c = np.array([table.value.get(w, -1) for w in raw], np.int64)
        each = c[found.codes] if len(c) else np.empty(0, np.int64)
        end = table.value.get(b"", 0)
        known = sums((each > 0).astype(np.int64), found.offsets) + (end > 0)
        logs = sums(np.where(each >= 0, np.log10(np.maximum(each, 0) + 1), 0.0), found.offsets)
        left = np.flatnonzero(each < 0)
        size = max(len(raw), 1)
        key, n = np.unique(found.owner[left] * size + found.codes[left], return_counts=True)
        places = np.searchsorted(key // size, np.arange(chunk.num_rows + 1))
        rest = found.distinct.take(pa.array(key % size)).cast(pa.binary())
        ends = np.cumsum(counts)
        small = ids.astype("<u2")
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("held_out"),
                pa.array(np.diff(found.offsets) + 1, pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(logs + np.log10(end + 1.0)),
                pa.array(
                    [
                        small[a:b].tobytes()
                        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)
                    ],
                    pa.binary(),
                ),
                pa.ListArray.from_arrays(pa.array(places, pa.int32()), rest),
                pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(n, pa.int32())),
            ],
            ["doc_id", "held_out", "n_tokens", "known", "logs", "ids", "rest", "rest_n"],
        )

    return map_arrow(
        texts,
        map_chunks(code),
        "doc_id long, held_out boolean, n_tokens long, known long, logs double, ids binary, "
        "rest array<binary>, rest_n array<int>",
    )


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches with their ids one after the other and the number of ids of each text."""
    for chunk in chunks(batches, "ids"):
        counts = pc.binary_length(chunk.column("ids")).to_numpy() // 2
        ids = np.frombuffer(b"".join(chunk.column("ids").to_pylist()), "<u2").astype(np.int64)
        yield chunk, ids, counts.astype(np.int64)


CELLS = "cell int, n long"


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the cells that are not 0."""
    some = np.flatnonzero(total)
    for at in range(0, len(some), 1 << 16):
        part = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["cell", "n"]
        )


def _summed(rows: DataFrame, cells: int) -> np.ndarray:
    """Sums by cell, which come to the driver as at most one row of 12 bytes a cell."""
    summed = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(cells, np.int64)
    total[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return total


def starting(tokenizer: str) -> np.ndarray:
    """Which ids start a word, that is, begin with a space."""
    own = encoder(tokenizer)
    names = own.tokenizer.get_vocab(with_added_tokens=True)
    made = np.zeros(own.size, bool)
    made[[i for name, i in names.items() if name.startswith("Ġ")]] = True
    return made


ID_PAIRS = "pair long, context int, n long"


def _id_pair_rows(
    pair: np.ndarray, n: np.ndarray, kind: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(pair), 1 << 16):
        some, times = pair[at : at + (1 << 16)], n[at : at + (1 << 16)]
        last, following = some >> 16, some & END_ID
        group = np.where(kind[last] > 0, 0, kind[following])
        context = (last * GROUPS + group).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(context), pa.array(times)], ["pair", "context", "n"]
        )


def count_id_pairs(texts: DataFrame, kind: np.ndarray) -> DataFrame:
    """pair, context and n of the pairs of ids in texts that slots do not tell apart, written."""
    sent = texts.sparkSession.sparkContext.broadcast(kind)

    def count(batches):
        pair, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, ids, sizes in _streams(batches):
            more, times = np.unique(
                pairs_of_ids(ids, sizes, sent.value)[1], return_counts=True
            )
            both, at = np.unique(np.r_[pair, more], return_inverse=True)
            n = np.bincount(at, weights=np.r_[n, times], minlength=len(both)).astype(np.int64)
            pair = both
            if len(pair) > HELD_PAIRS:
                yield from _id_pair_rows(pair, n, sent.value)
                pair, n = np.empty(0, np.int64), np.empty(0, np.int64)
        yield from _id_pair_rows(pair, n, sent.value)

    rows = map_arrow(texts, count, ID_PAIRS).groupBy("pair", "context")
    counted = written(rows.agg(F.sum("n").alias("n")), "id_pairs")
    sent.destroy()
    return counted


def frequent_id_pairs(counted: DataFrame, kind: np.ndarray) -> IdPairs:
    """What tasks are sent of the counted pairs: the contexts, and the frequent pairs."""
    size = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # At most GROUPS rows for each id.
    by_context = counted.groupBy("context").agg(
        F.sum("n").alias("seen"), F.count("*").alias("different")
    )
    found = by_context.toArrow()
    seen, different = np.zeros((END_ID + 1) * GROUPS), np.zeros((END_ID + 1) * GROUPS)
    seen[found["context"].to_numpy()] = found["seen"].to_numpy()
    different[found["context"].to_numpy()] = found["different"].to_numpy()
    # Fewer than FREQUENT_PAIRS rows.
    frequent = counted.filter(F.col("n") * FREQUENT_PAIRS > (size["n"] or 0))
    held = frequent.select("pair", "n").toArrow().sort_by("pair")
    return IdPairs(
        kind,
        seen,
        different,
        held["pair"].to_numpy(),
        held["n"].to_numpy(),
        held.num_rows == size["v"],
    )


def fit_parts(
    coded: DataFrame, frequent: dict[bytes, int], tokenizer: str = TOKENIZER
) -> tuple[Slots, Broadcast, Attention, DataFrame]:
    """Learn the model from the texts of ``_coded`` that are not held out, and count id pairs.

    ``frequent`` has the counts of frequent words in these texts.  The values, which are nearly
    all of the model, are returned as they were sent out.  What the executors were sent before is
    deleted there, as each keeps its copy on disk.
    """
    texts = coded.filter("NOT held_out").select("ids")
    n_ids = encoder(tokenizer).size
    context = coded.sparkSession.sparkContext

    def count_ids(batches):
        # The words are coded; what a worker knows of them would stay beside the values.
        encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        total = np.zeros(n_ids, np.int64)
        for _, ids, _ in _streams(batches):
            total += np.bincount(ids, minlength=n_ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    # At most a row for each id of the tokenizer.
    counts = np.zeros(n_ids, np.int64)
    by_id = map_arrow(texts, count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for row in by_id.collect():
        counts[row["id"]] = row["n"]
    slots = choose_slots(counts, starting(tokenizer))
    id_pairs = count_id_pairs(texts, kinds_of_ids(slots))
    of = context.broadcast(slots.of)

    common = sorted(w for w in frequent if w)
    ids, lengths = encoder(tokenizer).ids(
        pa.array(common, pa.large_binary()), np.arange(len(common))
    )
    parts = np.split(slots.of[ids], np.cumsum(lengths)[:-1]) if common else []
    tree = WordTree.of([p.tolist() for p in parts], [frequent[w] for w in common])
    grown = context.broadcast(tree)
    size, starts = KINDS * SLOTS * SLOTS, slots.starts

    def count_cells(batches):
        total = np.zeros(size, np.int64)
        visits = np.zeros(len(tree.ends), np.int64)
        for _, ids, sizes in _streams(batches):
            stream = with_ends(of.value[ids], sizes)
            visits += np.bincount(
                grown.value.nodes(stream, sizes, starts), minlength=len(visits)
            )
            for inputs, goal, _, _ in batches_of(stream, sizes, windows=None):
                count_tables(total, inputs, goal)
        yield from _cells(np.r_[total, visits])

    total = _summed(map_arrow(texts, count_cells, CELLS), size + len(tree.ends))
    tree.others = np.maximum(total[size:] - tree.through, 0)
    grown.destroy()
    tables = total[:size]
    number = choose_pairs(tables)
    numbered = context.broadcast(number)

    def count_pair_cells(batches):
        total = np.zeros(PAIRS * SLOTS, np.int32)
        for _, ids, sizes in _streams(batches):
            count_pairs(total, numbered.value, with_ends(of.value[ids], sizes), sizes)
        yield from _cells(total)

    pairs = _summed(map_arrow(texts, count_pair_cells, CELLS), PAIRS * SLOTS)
    numbered.destroy()
    values = distributions(tables, number, pairs, tree, starts)
    shared = context.broadcast(values)

    def windows(batches):
        for _, ids, sizes in _streams(batches):
            stream = with_ends(of.value[ids], sizes)
            yield from batches_of(stream, sizes, shared.value.direct(stream, sizes))

    def learn(batches):
        vector, places = train(shared.value, windows(batches))
        if places:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(vector)), pa.int32()),
                    pa.array(vector * places),
                    pa.array(np.full(len(vector), places, float)),
                ],
                ["i", "value", "places"],
            )

    # A row for each parameter.
    mean = (
        map_arrow(texts, learn, "i int, value double, places double")
        .groupBy("i")
        .agg((F.sum("value") / F.sum("places")).alias("value"))
        .collect()
    )
    vector = Attention.start().vector()
    for row in mean:
        vector[row["i"]] = row["value"]
    return slots, shared, Attention.of(vector), id_pairs


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of documents.

    NULL and empty texts are their end alone; a NULL doc_id is not held out; repeated rows count
    and are scored each; further columns are left out; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", _held_out())
    counts = written(_base_counts(texts), "words")
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"] or 0, size["v"]
    # Fewer than FREQUENT rows.
    frequent = {
        bytes(r["word"]): r["c"]
        for r in counts.filter((F.col("c") * FREQUENT > total) | (F.col("word") == b"")).collect()
    }
    coded = written(
        _coded(texts, frequent, tokenizer).withColumn("row", F.monotonically_increasing_id()),
        "coded",
        compression="zstd",
    )
    # A word that is left over is rare, so no task gets many of its rows.
    left = coded.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("w")).select(
        "row", F.col("w.rest").alias("word"), F.col("w.rest_n").alias("n")
    )
    known = F.col("c").isNotNull()
    rare = (
        left.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"),
        )
    )
    slots, shared, attention, counted = fit_parts(coded, frequent, tokenizer)
    id_pairs = frequent_id_pairs(counted, kinds_of_ids(slots))
    rest = coded.sparkSession.sparkContext.broadcast((slots, attention, id_pairs))

    def score_batches(batches):
        model = LanguageModel(rest.value[0], shared.value, *rest.value[1:])
        for chunk, ids, sizes in _streams(batches):
            found, (text, pair, odds) = model.scored(ids, sizes)
            places = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
            kept = ["row", "doc_id", "held_out", "n_tokens", "known", "logs"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(chunk.column(c) for c in kept),
                    pa.array(found),
                    pa.ListArray.from_arrays(places, pa.array(pair, pa.int64())),
                    pa.ListArray.from_arrays(places, pa.array(odds)),
                ],
                [*kept, "score", "pairs", "odds"],
            )

    scored = map_arrow(
        coded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "ids"),
        score_batches,
        "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, "
        "score double, pairs array<long>, odds array<double>",
    )
    more = F.lit(0.0)
    if not id_pairs.is_whole:
        scored = written(scored, "scored", compression="zstd")
        # A pair that is left over is rare, so no task gets many of its rows.
        left = scored.select("row", F.explode(F.arrays_zip("pairs", "odds")).alias("p"))
        by_text = (
            left.select("row", "p.pairs", "p.odds")
            .join(counted.select(F.col("pair").alias("pairs"), "n"), "pairs")
            .groupBy("row")
            .agg(F.sum(F.log10(1 + F.col("n") / F.col("odds"))).alias("pair_logs"))
        )
        scored = scored.join(by_text, "row", "left")
        more = F.coalesce("pair_logs", more)
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
