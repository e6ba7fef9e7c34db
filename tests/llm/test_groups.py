"""Near-duplicates, fingerprints and mixing against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lyrascope.llm import i_match, odd_sketch, pfair_mixing
from tests.llm.data import LOWER, WORD, by_id, documents, frame, prose


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, u) in enumerate(sets):
        for b, v in sets[:i]:
            if u and v and 100 * len(u & v) >= 85 * len(u | v):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: (len(s), top(d)) for d, s in sets}


def check_components(spark, rows):
    expected = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(odd_sketch.near_duplicates(df))
    named = {d: r for d, r in got.items() if d is not None}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in named.items()} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in named.values())
    return got


def test_near_duplicates_of_all_cases(spark):
    got = check_components(spark, [r[:2] for r in documents()])
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_large_groups_and_chains(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for k in range(90):  # pairs on both sides of the threshold
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(200)] = f"e{rng.random()}"
        rows.append((k, " ".join(words)))
    words = list(base)
    for k in range(25):  # a chain of edits
        words[rng.randrange(200)] = f"c{rng.random()}"
        rows.append((100 + k, " ".join(words)))
    rng.shuffle(rows)
    # Blocks far smaller than the group, so that it is cut.
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    check_components(spark, rows)


def test_near_copies_whose_buckets_are_all_large(spark, monkeypatch):
    # Passages that many longer documents embed, and two documents of little but the passage.
    rows = []
    for p in range(4):
        passage = [f"p{p}x{k}" for k in range(60)]
        for k in range(250):
            own = [f"o{p}x{k}x{i}" for i in range(30)]
            rows.append((1000 * p + k, " ".join(passage + own)))
        rows += [(1000 * p + 900 + k, " ".join([*passage, *[f"e{p}x{k}"] * 4])) for k in range(2)]
    monkeypatch.setattr(odd_sketch, "BLOCK", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(odd_sketch.near_duplicates(df))
    joined = {d: r["component_id"] for d, r in got.items() if r["component_id"] != d}
    assert joined == {1000 * p + 901: 1000 * p + 900 for p in range(4)}


def test_prefixes_and_filters_keep_all_links():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(150)]
    sets += [np.setdiff1d(s, s[:1]) for s in sets if len(s) > 1]
    counted = np.bincount(np.concatenate(sets).astype(np.int64), minlength=odd_sketch.SLOTS)
    rows = sorted(
        (int(v), i, bool(q), len(s), len(s) - place)
        for i, s in enumerate(sets)
        for place, v in enumerate(odd_sketch.prefix(s, counted))
        for q in (False, True)
    )
    columns = dict(zip(("shingle", "rep", "query", "size", "left"), zip(*rows, strict=True), strict=True))
    table = pa.table({k: list(v) for k, v in columns.items()} | {"component": list(columns["rep"])})
    made = odd_sketch.pass_filters(table, odd_sketch.group_ends(table, ["shingle"])).to_pydict()
    pairs = set(zip(made["a"], made["b"], strict=True))
    for b, v in enumerate(sets):
        for a, u in enumerate(sets[:b]):
            assert not odd_sketch.reaches(u, v) or (a, b) in pairs
    assert len(pairs) < len(sets) * (len(sets) - 1) / 2


def test_no_documents_and_no_links(spark):
    assert odd_sketch.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    check_components(spark, rows)


def test_odd_sketches_estimate_high_similarities():
    import numpy as np

    rng = np.random.default_rng(0)
    first = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
    for shared in (0.95, 0.9, 0.85):
        n = int(len(first) * 2 * shared / (1 + shared))
        other = np.unique(np.r_[first[:n], rng.integers(0, 1 << 63, len(first) - n, np.uint64)])
        drawn = odd_sketch.sketches(odd_sketch.samples([first, other]))
        assert abs(odd_sketch.similarities(drawn)[0, 1] - shared) < 0.1


def test_edited_texts_and_likeness(spark):
    rows = {r[0]: r[1] or "" for r in documents() if r[0] is not None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = by_id(i_match.fingerprints(docs, 1 / 100, 1 / 2))
    ids = sorted(rows, reverse=True)
    prints = collections.defaultdict(set)
    for k, d in enumerate(ids):
        text, after = rows[d], rows[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[d]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if edited == text:
            assert row["edited_fingerprint"] == row["fingerprint"] and row["near_edited"] == 1
        prints[text].add(row["fingerprint"])
        if text == after:
            assert row["near_next"] == 1
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for s in prints.values() for p in s}) > 0.8 * len(prints)
    mean = [sum(r[c] for r in got.values()) / len(got) for c in ("near_edited", "near_next")]
    assert mean[0] > mean[1]


def i_match_of(texts, least, most):
    """Sets of terms, their band, and a function from a text to its hashes, by plain loops."""

    def terms(text):
        return set(re.split(r"[\x20\x09-\x0D]+", text.lower())) - {""}

    def drawn(term):
        raw = term.encode()
        part = signed(le8(len(i_match.RATES)), raw) % i_match.WIDE
        bits = [part != j for j in range(i_match.WIDE)]
        bits += [signed(le8(j), raw) % rate == 0 for j, rate in enumerate(i_match.RATES)]
        return sum(1 << j for j, taken in enumerate(bits) if taken)

    def le8(number):
        return number.to_bytes(4, "little")

    def signed(number, raw):
        made = xxhash.xxh64_intdigest(number, xxhash.xxh64_intdigest(raw, 42))
        return made - (1 << 64) * (made >> 63)

    count = collections.Counter(t for text in texts for t in terms(text))
    band = {t: drawn(t) for t, n in count.items() if least * len(texts) <= n <= most * len(texts)}

    def hashes(text):
        own = sorted((t for t in terms(text) if t in band), key=str.encode)
        made = []
        for j in range(i_match.SUBSETS):
            h, some = 42, False
            for t in own:
                if band[t] >> j & 1:
                    h = xxhash.xxh64_intdigest(t.encode(), h)
                    h = xxhash.xxh64_intdigest(band[t].to_bytes(8, "little"), h)
                    some = True
            made.append(h if some else None)
        return made

    return hashes


def test_fingerprints_against_a_plain_version(spark):
    rows = {r[0]: r[1] or "" for r in documents() if r[0] is not None and (r[1] or "").isascii()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = by_id(i_match.fingerprints(docs, 1 / 100, 1 / 2))
    hashes = i_match_of(rows.values(), 1 / 100, 1 / 2)
    ids, compared = sorted(rows, reverse=True), 0
    for k, d in enumerate(ids):
        text, after = rows[d], rows[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        own, edited, following = map(hashes, (text, text[: len(text) - half] + after[:half], after))
        if not any(own):
            continue
        compared += 1
        assert got[d]["fingerprint"] == "".join("-" if h is None else f"{h:016x}" for h in own)
        for other, name in ((edited, "near_edited"), (following, "near_next")):
            either = [(a, b) for a, b in zip(own, other, strict=True) if a or b]
            assert math.isclose(got[d][name], sum(a == b for a, b in either) / len(either))
    assert compared > 60


def test_half_edited_texts_are_more_alike_than_neighbours(spark):
    rows = [(i, prose(1000 + i, 100 + 20 * i)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(i_match.fingerprints(docs, 1 / 100, 1 / 2))
    alike = [r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 500]
    assert len(alike) > 90 and sum(alike) >= 0.95 * len(alike)


def test_every_term_of_the_band_reaches_the_fingerprint(spark):
    common = " ".join(f"c{k}" for k in range(40))
    texts = [f"{common} own{i}" for i in range(60)]
    rows = [(i, text) for i, text in enumerate(texts * 2)]
    rows += [(1000 + i, f"x{i}") for i in range(200)]  # so that common terms are in the band
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    band = i_match.lexicon(docs, 1 / 200, 1 / 2).collect()
    wide = [r["subsets"] & (1 << i_match.WIDE) - 1 for r in band]
    assert {r["term"] for r in band} == {t for text in texts for t in text.split()}
    assert all(w.bit_count() == i_match.WIDE - 1 for w in wide)
    got = by_id(i_match.fingerprints(docs, 1 / 200, 1 / 2))
    assert len({got[i]["fingerprint"] for i in range(60)}) == 60
    assert all(got[i]["fingerprint"] == got[i + 60]["fingerprint"] for i in range(60))


def test_fingerprints_use_no_python(spark):
    plan = i_match.fingerprints(frame(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_fingerprints_of_hard_tables(spark):
    assert i_match.fingerprints(frame(spark, [])).count() == 0
    one = i_match.fingerprints(frame(spark, [(4, "a b c d", None, None, 0)])).first()
    assert one["near_next"] == 1
    rows = [(1, "a b", None, None, 0), (1, "a b", None, None, 0), (None, None, None, None, 0)]
    got = by_id(i_match.fingerprints(frame(spark, rows)))
    assert set(got) == {1, None} and got[None]["n_chars"] == 0


@pytest.mark.parametrize("seed", range(20))
def test_schedules_stay_within_a_block_of_the_weights(seed):
    rng = random.Random(seed)
    counts = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 8))}
    total, seen = sum(counts.values()), collections.Counter()
    made = pfair_mixing.schedule(counts)
    assert [slot for *_, slot, _, _ in made] == list(range(total))
    for source, k, slot, release, deadline in made:
        assert release <= slot < deadline and seen[source] == k
        seen[source] += 1
        for s, n in counts.items():
            assert abs(seen[s] - (slot + 1) * n / total) < 1


def test_mixed_rows_are_whole_and_follow_the_weights(spark):
    docs = frame(spark).withColumnRenamed("lang", "slot")
    shares = {"hot": 4, "s0": 2}
    rows = pfair_mixing.mix(docs, shares, block_rows=2).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in documents())
    source_of = collections.defaultdict(set)
    for r in rows:
        assert r["released"] <= r["slot"] < r["due"]
        source_of[r["slot"]].add(r["source"])
    assert sorted(source_of) == list(range(len(source_of)))
    assert all(len(s) == 1 for s in source_of.values())
    blocks = collections.Counter((r["source"], r["block"]) for r in rows)
    partial = collections.Counter(s for (s, _), n in blocks.items() if n < 2)
    assert max(blocks.values()) == 2 and max(partial.values(), default=0) <= 1
    # While all sources last, they come up by their weights.
    given = {s: shares.get(s, 1) for s in {r["source"] for r in rows}}
    n_blocks = collections.Counter(s for s, _ in blocks)
    cycles = min(n_blocks[s] // g for s, g in given.items())
    total = sum(given.values())
    seen = collections.Counter()
    for slot in range(cycles * total):
        seen[next(iter(source_of[slot]))] += 1
        for s, g in given.items():
            assert abs(seen[s] - (slot + 1) * g / total) < 1


def test_mixing_keeps_columns_and_empty_tables(spark):
    docs = frame(spark)
    assert pfair_mixing.in_mixed_order(docs).columns == docs.columns
    assert pfair_mixing.in_mixed_order(docs).count() == len(documents())
    assert pfair_mixing.mix(frame(spark, [])).count() == 0


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["slot", "block", "place", "released", "due", "_hash", "_cycle", "_number", "_row", "_b0"]
    docs = frame(spark)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.col("doc_id") * 10 + i)
    ordered = pfair_mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns
    rows = sorted(map(repr, ordered.collect()))
    assert rows == sorted(map(repr, docs.collect()))
    mixed = pfair_mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns)
    plain = {(r["doc_id"], r["slot"], r["place"]) for r in pfair_mixing.mix(frame(spark)).collect()}
    got = mixed.collect()
    assert {(r["doc_id"], r["slot"], r["place"]) for r in got} == plain
    assert all(r["_hash"] == r["doc_id"] * 10 + 5 for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("shares", [None, {"s0": 9, "s1": 5, "s40": 3, "s41": 2}])
def test_more_sources_than_own_shares(spark, monkeypatch, shares):
    monkeypatch.setattr(pfair_mixing, "OWN_SHARES", 6)
    sizes = {f"s{i}": 70 - i // 2 for i in range(80)} | {None: 90}
    ids = iter(range(10**6))
    docs = spark.createDataFrame(
        [(next(ids), s) for s, n in sizes.items() for _ in range(n)], "doc_id long, source string"
    )
    rows = pfair_mixing.mix(docs, shares, block_rows=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(sum(sizes.values())))
    source_of, places = {}, collections.Counter()
    for r in rows:
        assert r["released"] <= r["slot"] < r["due"]
        assert source_of.setdefault(r["slot"], r["source"]) == r["source"]
        places[r["slot"], r["place"]] += 1
    assert sorted(source_of) == list(range(sum(-(-n // 4) for n in sizes.values())))
    assert set(places.values()) == {1}
    # Inside a server sources of equal weight take turns while they last.
    named = shares or {}
    own = sorted(
        sizes, key=lambda s: (s not in named, -(-(-sizes[s] // 4)), s is not None, s or "")
    )[:6]
    servers = collections.defaultdict(list)
    for s, n in sizes.items():
        if s not in own:
            servers[int(math.log2(n**0.5 if shares is None else named.get(s, 1)))].append(s)
    assert len(servers) == (2 if shares is None else 1)
    for served in servers.values():
        order = [source_of[k] for k in sorted(source_of) if source_of[k] in served]
        for turn in range(min(-(-sizes[s] // 4) for s in served)):
            part = order[turn * len(served) : (turn + 1) * len(served)]
            assert sorted(part) == sorted(served)


def test_thousands_of_sources(spark):
    docs = spark.range(20_000).selectExpr(
        "id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 5000) end as source"
    )
    rows = pfair_mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(20_000))
    blocks = {(r["source"], r["block"], r["slot"]) for r in rows}
    assert sorted(slot for *_, slot in blocks) == list(range(len(blocks)))
    assert all(r["released"] <= r["slot"] < r["due"] for r in rows)


@pytest.mark.parametrize("part_edges", [1 << 20, 20])
def test_components_of_paths_stars_and_random_edges(spark, monkeypatch, part_edges):
    monkeypatch.setattr(odd_sketch, "PART_EDGES", part_edges)
    rng = random.Random(4)
    cases = [
        [(i, i + 1) for i in range(120)],
        [(0, i) for i in range(1, 90)] + [(500 + i, 500) for i in range(1, 40)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        [],
    ]
    for edges in cases:
        parent = {}

        def top(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for x, y in edges:
            p, q = top(x), top(y)
            parent[max(p, q)] = min(p, q)
        rng.shuffle(edges)
        table = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {r.rep: r.component for r in odd_sketch.components(table).collect()}
        assert got == {x: top(x) for x in parent if top(x) != x}
