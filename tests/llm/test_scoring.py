"""The language model: base figures against brute force, and its distribution."""

import collections
import math
import tracemalloc
import zlib

import numpy as np

from lyrascope.llm import attention_lm as lm
from tests.llm.data import LOWER, WORD, by_id, documents, frame


def test_base_figures(spark, monkeypatch):
    # Few frequent words, so that most are joined.
    monkeypatch.setattr(lm, "FREQUENT", 64)
    got = by_id(lm.score(frame(spark)))
    tokens = [(d, [*WORD.findall((t or "").translate(LOWER)), None]) for d, t, *_ in documents()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens}
    counts = collections.Counter(w for d, own in tokens if not held[d] for w in own)
    total = sum(counts.values())
    for d, own in tokens:
        row = got[d]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert row["held_out"] == held[d] and row["train_tokens"] == total
        assert row["n_tokens"] == len(own)
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert row["score"] < 0


def test_no_documents(spark):
    assert lm.score(frame(spark, [])).count() == 0


def small_model():
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 40, 4000).astype(np.int32)
    counts = np.array([1500, 0, 2500])
    starts = np.zeros(lm.SLOTS, bool)
    starts[:20] = starts[[lm.RARE_START, lm.END]] = True
    full = lm.with_ends(stream, counts)
    tables = np.zeros(lm.KINDS * lm.SLOTS**2, np.int64)
    for inputs, goal, _, _ in lm.batches_of(full, counts):
        lm.count_tables(tables, inputs, goal)
    number = lm.choose_pairs(tables)
    pairs = np.zeros(lm.PAIRS * lm.SLOTS, np.int32)
    lm.count_pairs(pairs, number, full, counts)
    tree = lm.WordTree.of([[1, 25], [1, 25, 30], [2]], [30, 20, 10])
    values = lm.distributions(tables, number, pairs, tree, starts)
    return values, full, counts


def test_windows_score_each_place_once():
    _, full, counts = small_model()
    goals = np.concatenate([g[g >= 0] for _, g, _, _ in lm.batches_of(full, counts)])
    assert goals.tolist() == full.tolist()


def test_next_slots_make_a_distribution():
    values, full, counts = small_model()
    vector, places = lm.train(values, lm.batches_of(full, counts, values.direct(full, counts)))
    assert places == len(full)
    attention = lm.Attention.of(vector)
    scores, bias = attention.scores(), attention.distance.astype(np.float32)
    start = full[:70].copy()
    start[-1], start[-2] = 25, 1
    total = 0.0
    for y in range(lm.SLOTS):
        stream = np.r_[start, y, lm.END] if y != lm.END else np.r_[start, y]
        n = np.array([len(stream) - 1])
        for inputs, goal, direct, _ in lm.batches_of(stream, n, values.direct(stream, n)):
            p, used = lm.attend(scores, bias, attention.plain, values, inputs, goal, direct)[3:]
            flat = np.full(goal.shape, np.nan)
            flat[used] = p
            total += flat.ravel()[len(start)]
    assert abs(total - 1) < 1e-4


def test_direct_probabilities_take_little_memory(monkeypatch):
    values, full, counts = small_model()
    stream, many = np.tile(full, 250), np.tile(counts, 250)
    tracemalloc.start()
    found = values.direct(stream, many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Ten arrays of 8 bytes a place, of all places, were 80 MB.
    assert len(stream) > 1_000_000 and peak < 48e6
    monkeypatch.setattr(lm, "PLACES", 700)
    assert (values.direct(full, counts) == found[: len(full)]).all()
    assert (np.tile(found[: len(full)], 250) == found).all()


def test_a_batch_has_the_places_of_its_windows(monkeypatch):
    monkeypatch.setattr(lm, "WINDOW", 3)
    counts = np.array([4, 0, 7])
    stream = lm.with_ends(np.arange(11, dtype=np.int32), counts)
    got = [(g.tolist(), own.tolist()) for _, g, _, own in lm.batches_of(stream, counts, None, 2)]
    end = lm.END
    assert got == [
        ([0, 1, 2, 3, end], [0] * 5),
        ([end, 4, 5, 6], [1, 2, 2, 2]),
        ([7, 8, 9, 10, end], [2] * 5),
    ]
    ((inputs, goal, _, _),) = lm.batches_of(stream, counts, None, None)
    assert goal.tolist() == stream.tolist()
    pad = lm.PAD
    assert inputs[:, 4].tolist() == [3, 2, 1, 0, end, pad]
    assert inputs[:, 5].tolist() == [end] + [pad] * 5
    assert inputs[:, 7].tolist() == [4, end] + [pad] * 4


def test_training_helps():
    values, full, counts = small_model()
    direct = values.direct(full, counts)
    vector, _ = lm.train(values, lm.batches_of(full, counts, direct))
    slots = lm.Slots(np.arange(lm.SLOTS), np.zeros(lm.SLOTS), values.starts)
    stream = np.delete(full, np.cumsum(counts + 1) - 1)
    before = lm.LanguageModel(slots, values, lm.Attention.start())
    after = lm.LanguageModel(slots, values, lm.Attention.of(vector))
    assert (
        after.log10_probabilities(stream, counts).sum()
        > before.log10_probabilities(stream, counts).sum()
    )


def test_the_values_are_sent_once(spark, monkeypatch):
    sent, context = [], spark.sparkContext
    send = type(context).broadcast
    monkeypatch.setattr(
        type(context), "broadcast", lambda self, x: sent.append(type(x)) or send(self, x)
    )
    scored = lm.score(frame(spark))
    assert sent.count(lm.Values) == 1 and lm.LanguageModel not in sent
    rows = by_id(scored)
    assert rows and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())


def test_ids_without_a_slot_of_their_own_keep_their_share():
    counts = np.r_[np.arange(3000, 1000, -1), np.zeros(50)]
    slots = lm.choose_slots(counts, np.arange(len(counts)) % 3 == 0)
    for shared in (lm.RARE_START, lm.RARE):
        own = slots.of == shared
        assert own.any() and np.isclose((10.0 ** slots.within[own]).sum(), 1)
    assert (slots.within[slots.of < lm.RARE_START] == 0).all()


def rare_pairs():
    """Slots of 1100 ids, some of them rare, and the pairs of a stream that slots do not tell."""
    rng = np.random.default_rng(1)
    ids = np.r_[np.tile(np.arange(1100), 3), rng.integers(0, 1000, 4000)]
    ids = np.r_[ids, np.tile([1050, 1060, 1070, 3], 20)]
    counts = np.array([3000, 0, len(ids) - 3000])
    slots = lm.choose_slots(np.bincount(ids, minlength=1100), np.arange(1100) % 3 == 0)
    return ids, counts, slots, lm.kinds_of_ids(slots)


def test_pairs_of_ids_without_a_slot():
    ids, counts, slots, kind = rare_pairs()
    stream, texts = [], np.split(ids, np.cumsum(counts)[:-1])
    for text in texts:
        stream += zip([lm.END_ID, *text.tolist()], [*text.tolist(), lm.END_ID], strict=True)
    has_none = {i for i in range(1100) if slots.of[i] in (lm.RARE_START, lm.RARE)}
    want = [(i, a, b) for i, (a, b) in enumerate(stream) if a in has_none or b in has_none]
    place, pair, context = lm.pairs_of_ids(ids, counts, kind)
    assert list(zip(place.tolist(), (pair >> 16).tolist(), (pair & 0xFFFF).tolist())) == want
    for (_, a, b), c in zip(want, context.tolist(), strict=True):
        group = 0 if a in has_none else 1 if slots.of[b] == lm.RARE_START else 2
        assert c == a * lm.GROUPS + group


def counted_pairs(spark):
    ids, counts, slots, kind = rare_pairs()
    ends = np.cumsum(counts)
    rows = [(ids[e - n : e].astype("<u2").tobytes(),) for e, n in zip(ends, counts, strict=True)]
    texts = spark.createDataFrame(rows, "ids binary").repartition(3)
    return lm.count_id_pairs(texts, kind)


def test_ids_without_a_slot_have_their_own_next_ids(spark):
    ids, counts, slots, kind = rare_pairs()
    pairs = lm.frequent_id_pairs(counted_pairs(spark), kind)
    _, pair, _ = lm.pairs_of_ids(ids, counts, kind)
    want = collections.Counter(pair.tolist())
    assert pairs.is_whole
    assert dict(zip(pairs.pair.tolist(), pairs.n.tolist(), strict=True)) == want
    by_slot = np.random.default_rng(3).dirichlet(np.ones(lm.SLOTS))
    # After ids without a slot, and after others, probabilities of all next ids sum to 1.
    for last, rare in ((1065, True), (1099, True), (4, False), (1017, False)):
        assert (kind[last] > 0) == rare
        every = np.arange(1100)
        p = np.r_[by_slot[slots.of[every]], by_slot[lm.END]]
        plain = np.log10(p) + np.r_[slots.within, 0]
        text = np.r_[np.stack([np.full(1100, last), every], 1).ravel(), last]
        sizes = np.r_[np.full(1100, 2), 1]
        of_place = np.full(len(text) + len(sizes), 0.5)
        # The second place of each text is looked at: an id, or the end of the last text.
        looked = np.cumsum(sizes + 1) - sizes
        of_place[looked] = p
        place, _, logs, *_ = pairs.at_places(text, sizes, of_place, slots.within)
        added = np.zeros(len(of_place))
        added[place] = logs
        found = 10 ** (plain + added[looked])
        assert abs(found.sum() - 1) < 1e-9
        # What followed every time is likelier than by its share of a slot.
        if last == 1065:
            assert found[1066] > 0.4 > 20 * 10 ** plain[1066]


def test_pairs_that_are_not_frequent_are_left_over(spark, monkeypatch):
    ids, counts, slots, kind = rare_pairs()
    counted = counted_pairs(spark)
    p = np.random.default_rng(4).uniform(0.001, 0.1, len(ids) + len(counts))
    whole = lm.frequent_id_pairs(counted, kind)
    want, left = whole.added(ids, counts, p, slots.within)
    assert not len(left[0])
    monkeypatch.setattr(lm, "FREQUENT_PAIRS", 120)
    few = lm.frequent_id_pairs(counted, kind)
    assert not few.is_whole and 0 < len(few.pair) < len(whole.pair)
    got, (text, pair, odds) = few.added(ids, counts, p, slots.within)
    n = dict(zip(whole.pair.tolist(), whole.n.tolist(), strict=True))
    for t, key, odd in zip(text.tolist(), pair.tolist(), odds.tolist(), strict=True):
        got[t] += math.log10(1 + n.get(key, 0) / odd)
    assert len(text) and np.allclose(got, want, rtol=1e-9)


def vocabulary_documents():
    """Texts with more different ids than there are slots; rare words come in one order.

    The last five texts, which are held out, have rare words in any order.
    """
    names = lm.encoder(lm.TOKENIZER).tokenizer.get_vocab(with_added_tokens=True)
    found = sorted(n[1:] for n in names if n[0] == "Ġ" and n[1:].isascii() and n[1:].islower())
    rng = np.random.default_rng(2)
    common, rare = found[:1500], found[1500:2100]
    texts = [" ".join(rng.choice(common, 200)) for _ in range(80)]
    texts += [" ".join(rare[at : at + 40]) for at in range(0, 560, 20)]
    mixed = [" ".join(rng.permutation(rare)[:40]) for _ in range(5)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(2000)}
    learnt_ids, held_ids = ([i for i in held if held[i] == h] for h in (False, True))
    rows = [*zip(learnt_ids, texts), *zip(held_ids, mixed)]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def test_pairs_left_over_are_joined(spark, monkeypatch):
    rows = vocabulary_documents()
    want = by_id(lm.score(frame(spark, rows)))
    monkeypatch.setattr(lm, "FREQUENT_PAIRS", 1500)
    got = by_id(lm.score(frame(spark, rows)))
    assert len(want) == len(rows) and got.keys() == want.keys()
    for d, row in want.items():
        assert math.isclose(got[d]["score"], row["score"], rel_tol=1e-9)
    # Rare words in the order that was learnt are likelier than in any other, by far.
    learnt = [want[d]["score"] / want[d]["n_tokens"] for d, *_ in rows[80:-5]]
    mixed = [want[d]["score"] / want[d]["n_tokens"] for d, *_ in rows[-5:]]
    assert min(learnt) > max(mixed) + 1
