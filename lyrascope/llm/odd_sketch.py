"""Near-duplicate documents by MinHash and odd sketches (operator 9).

1. A document's 5-word shingles are hashed to 64 bits.  Documents with equal sets form a class,
   and only its smallest doc_id goes on.
2. MinHash samples of the set are grouped into bands, whose hashes are the candidate buckets,
   and folded into an odd sketch: every (sample number, sample) flips one bit, so that two
   sketches differ in few bits exactly if the sets are very similar.
3. Within a bucket a maximum spanning forest over the estimated similarities joins documents
   that may be alike.  Large buckets are cut into blocks, by another hash for each band.
   The forests' components are clusters; links are only looked for inside them.
4. A cluster of at most BLOCK documents goes to one task with its full sets, which finds its
   components exactly.  In a larger one each document's two best forest edges are confirmed on
   the full sets first.  Then the documents outside the cluster's largest component meet all of
   the cluster, in blocks against blocks.
5. Two documents whose buckets are all large may have met in no block.  The documents of a large
   bucket that is not one component by now are joined exactly: a pair that reaches the threshold
   shares one of the rarest shingles of either set (prefix filter), and its sizes and the places
   of the first such shingle leave room for the overlap.  What passes is confirmed on full sets.

So the work is linear in the documents but for those last ones, the only pairs written are
forest edges, links and what passes the filters of step 5, and copies are never compared with
each other.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import map_chunks, words
from lyrascope.operators.skew import salted_join

WIDTH = 5
THRESHOLD = 85  # per cent

BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512

# Estimates from this on are proposed: the threshold less six standard errors of the samples,
# which leaves room for the sketch's own error, bits that are flipped twice.
PROPOSE_AT = 0.85 - 6 * (0.85 * 0.15 / SAMPLES) ** 0.5

# Documents of a bucket that are compared in one task.
BLOCK = 512

# Edges that one task puts together into components.
PART_EDGES = 1 << 20

# Slots by which shingles are counted for their order in step 5; any order finds the same pairs.
SLOTS = 1 << 20

# Rows of one shingle that are joined in one task.
HEAVY_SHINGLE = 10_000

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _random.integers(0, 1 << 32, SAMPLES, np.uint32)

# Shingles that are sampled at once, so that they stay in the processor's cache.
SAMPLED = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles."""
    found = words(texts, lower=True)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in found.distinct.to_pylist()], np.uint64)
    word = own[found.codes] if len(own) else np.empty(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(word) - WIDTH + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        rolled = mix(rolled * step + word[k : k + n] + np.uint64(k))
    sets = []
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            sets.append(np.unique(rolled[a : b - WIDTH + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * step + word[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples by set and sample, for sets that are not empty."""
    made = np.empty((len(sets), SAMPLES), np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    begin = 0
    while begin < len(sets):
        base = ends[begin] - len(sets[begin])
        end = max(int(np.searchsorted(ends, base + SAMPLED, "right")), begin + 1)
        values = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.r_[0, ends[begin : end - 1] - base].astype(np.int64)
        hashed = np.empty_like(values)
        for k in range(SAMPLES):
            np.multiply(values, FACTORS[k], out=hashed)
            np.add(hashed, TERMS[k], out=hashed)
            made[begin:end, k] = np.minimum.reduceat(hashed, starts)
        begin = end
    return made


def sketches(made: np.ndarray) -> np.ndarray:
    """Odd sketches: the parity of the samples that fall on each bit, as packed bytes."""
    numbered = made.astype(np.uint64) << np.uint64(8) | np.arange(SAMPLES, dtype=np.uint64)
    bit = (mix(numbered) % np.uint64(SKETCH_BITS)).astype(np.int64)
    place = np.arange(len(made))[:, None] * SKETCH_BITS + bit
    parity = np.bincount(place.ravel(), minlength=len(made) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(made), SKETCH_BITS), axis=1)


def similarities(rows: np.ndarray) -> np.ndarray:
    """Estimated similarities of all pairs of one block's sketches."""
    packed = np.ascontiguousarray(rows).view(np.uint64)
    differ = np.zeros((len(rows), len(rows)), np.int64)
    for k in range(packed.shape[1]):
        differ += np.bitwise_count(packed[:, None, k] ^ packed[None, :, k])
    # Each of d differing samples flips two bits; the logarithm undoes bits flipped twice.
    odd = np.minimum(2 * differ / SKETCH_BITS, 1 - 1e-9)
    flips = -SKETCH_BITS / 2 * np.log1p(-odd)
    return 1 - flips / (2 * SAMPLES)


def band_keys(made: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(made), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + made[:, k::ROWS])
    return keys.view(np.int64)


FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("key1", pa.int64()),
        ("key2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ]
)


SPEC = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sketch binary"


def describe(chunk: pa.RecordBatch) -> pa.RecordBatch:
    """Set size, two hashes of the whole set, band keys and sketch of each text."""
    sets = shingle_sets(chunk.column("text"))
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    bands = np.zeros((len(sets), 0), np.int64)
    drawn = np.empty((len(sets), 0), np.uint8)
    keys = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        made = samples([sets[i] for i in full])
        bands = np.zeros((len(sets), BANDS), np.int64)
        bands[full] = band_keys(made)
        drawn = np.zeros((len(sets), SKETCH_BITS // 8), np.uint8)
        drawn[full] = sketches(made)
        for i in full:
            keys[0, i] = sets[i].sum(dtype=np.uint64)
            keys[1, i] = mix(sets[i] + np.uint64(1)).sum(dtype=np.uint64)
    places = pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(places, pa.array(bands.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            chunk.column("doc_id"),
            pa.array(sizes, pa.int64()),
            pa.array(keys[0].view(np.int64)),
            pa.array(keys[1].view(np.int64)),
            lists,
            pa.array([row.tobytes() for row in drawn], pa.binary()),
        ],
        schema=FEATURES,
    )


def forest(rep: np.ndarray, packed: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a maximum spanning forest over one block's estimates, from PROPOSE_AT on.

    Prim's method, a row of similarities at a time.
    """
    alike = similarities(packed)
    n = len(rep)
    best, parent = np.full(n, -2.0), np.full(n, -1)
    left = np.ones(n, bool)
    edges = []
    for _step in range(n):
        i = int(np.argmax(np.where(left, best, -3.0)))
        left[i] = False
        if best[i] >= PROPOSE_AT:
            edges.append((int(rep[i]), int(rep[parent[i]]), float(best[i])))
        nearer = left & (alike[i] > best)
        best[nearer], parent[nearer] = alike[i][nearer], i
    return edges


PROPOSALS = pa.schema([("child", pa.int64()), ("parent", pa.int64()), ("alike", pa.float64())])


def by_group(function, keys: list[str]):
    """A function for mapInArrow over rows sorted by keys, which gives ``function`` whole groups."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            ends = group_ends(held, keys)
            # The last group may go on in the next batch.
            if len(ends) > 1:
                yield function(held.slice(0, int(ends[-2])), ends[:-1])
                held = held.slice(int(ends[-2]))
        if held is not None and held.num_rows:
            yield function(held, group_ends(held, keys))

    return apply


def group_ends(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        values = table.column(key).to_numpy()
        new |= values[1:] != values[:-1]
    return np.r_[np.flatnonzero(new) + 1, table.num_rows]


def _packed(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("sketch").to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, SKETCH_BITS // 8)


def propose(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """Forest edges of groups of rows (rep, sketch)."""
    rep, packed = table.column("rep").to_numpy(), _packed(table)
    edges = []
    for a, b in pairwise([0, *ends.tolist()]):
        edges += forest(rep[a:b], packed[a:b])
    columns = list(zip(*edges, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, PROPOSALS.types, strict=True)], schema=PROPOSALS
    )


def reaches(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    low, high = sorted((len(u), len(v)))
    if 100 * low < THRESHOLD * high:
        return False
    common = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return 100 * common >= THRESHOLD * (low + high - common)


def resolve(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """Links of groups of rows (rep, component, query, sketch, members), enough to join them.

    Pairs without a query document, and pairs of one component, are left out.
    """
    links = []
    rep, packed = table.column("rep").to_numpy(), _packed(table)
    own, query = table.column("component").to_numpy(), table.column("query").to_numpy()
    for a, b in pairwise([0, *ends.tolist()]):
        # A query document may be there as one of the block as well.
        order = a + np.lexsort((~query[a:b], rep[a:b]))
        order = order[np.r_[True, rep[order][1:] != rep[order][:-1]]]
        alike = np.triu(similarities(packed[order]), 1)
        alike[~(query[order][:, None] | query[order][None, :])] = 0
        x, y = np.nonzero(alike >= PROPOSE_AT)
        best = np.argsort(-alike[x, y], kind="stable")
        _, group = np.unique(own[order], return_inverse=True)
        root = list(range(int(group.max()) + 1))

        def top(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        sets = {}
        for i, j in zip(x[best].tolist(), y[best].tolist(), strict=True):
            p, q = top(group[i]), top(group[j])
            if p == q:
                continue
            for k in (i, j):
                if k not in sets:
                    raw = table.column("members")[int(order[k])].as_py()
                    sets[k] = np.frombuffer(raw, np.uint64)
            if reaches(sets[i], sets[j]):
                root[max(p, q)] = min(p, q)
                links.append((int(rep[order[i]]), int(rep[order[j]])))
    columns = list(zip(*links, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["a", "b"]
    )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a partition's own edges, as edges to their smallest rep."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root[x]) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(root.setdefault(x, x)), top(root.setdefault(y, y))
            if p != q:
                root[max(p, q)] = min(p, q)
    made = [(x, top(x)) for x in root]
    columns = list(zip(*[e for e in made if e[0] != e[1]], strict=True)) or [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Edges, written, and their number and hash, which the write itself counts."""
    seen = Observation()
    pair = F.xxhash64("a", "b")
    observed = edges.observe(
        seen,
        F.count("*").alias("n"),
        F.bit_xor(pair).alias("x"),
        F.sum(F.shiftright(pair, 20)).alias("s"),
    )
    table = written(observed, name)
    return table, tuple(seen.get[k] for k in "nxs")


def components(edges: DataFrame) -> DataFrame:
    """rep and the smallest rep of its component, for the ends of edges (a, b).

    Parts of PART_EDGES edges are put together first, each by itself.  If there are several
    parts, large-star and small-star steps follow in turn; every step is a written table, and a
    turn that leaves the edges as they were is the last.
    """
    own = edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    table, (n, *_) = _counted(own, "edges")
    parts = max(1, -(-n // PART_EDGES))
    forest = map_arrow(table.coalesce(parts), _forest, "a long, b long")
    if parts == 1:
        return written(forest, "components").select(
            F.col("a").alias("rep"), F.col("b").alias("component")
        )
    current, before = _counted(forest.distinct(), "forest")
    while True:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_b"))
        least = least.select("a", F.least("a", "_b").alias("least"))
        upper = both.filter("b > a").join(least, "a")
        # Every edge points down: a > b.  Some are there several times until the small step.
        large = written(upper.select(F.col("b").alias("a"), F.col("least").alias("b")), "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
                    F.struct(F.col("a"), F.col("least").alias("b")),
                )
            ).alias("e")
        )
        current, after = _counted(small.select("e.*").filter("a <> b").distinct(), "small")
        if after == before:
            break
        before = after
    # Stars: every rep points at its component's smallest one.
    return current.select(F.col("a").alias("rep"), F.col("b").alias("component"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                reaches(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(batch.column("left"), batch.column("right"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return map_arrow(both.select("a", "b", "left", "right"), compare, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and members, the bytes of the full set, of some documents."""

    def members(chunk: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(chunk.column("text"))
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("rep"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.view(np.int64).sum() for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            ["rep", "n_shingles", "key1", "members"],
        )

    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    made = map_arrow(
        texts.join(reps.select("rep"), "rep", "left_semi"),
        map_chunks(members),
        "rep long, n_shingles long, key1 long, members binary",
    )
    # Of several rows with one doc_id, the one that stands for it.
    return made.join(reps, ["rep", "n_shingles", "key1"], "left_semi").dropDuplicates(["rep"])


def _grouped(rows: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "rep")
    return map_arrow(dealt, by_group(function, keys), schema)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of documents (doc_id, text).

    NULL, empty and blank texts have no shingle, are linked with nothing and are kept.  Rows of
    one doc_id are one node: a link of any of them is a link of the doc_id; each row is
    returned with its own set size.  A NULL doc_id is linked with nothing and has itself (NULL)
    as component.  Further columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = written(map_arrow(texts, map_chunks(describe), SPEC), "features")
    keys = ["n_shingles", "key1", "key2"]
    own = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    chosen = own.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("set"))
    classes = written(
        chosen.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes"
    )
    copies = (
        salted_join(
            chosen,
            classes.select("set", "rep"),
            ["set"],
            "doc_id",
            counts=classes.select("set", "n"),
        )
        .filter("doc_id <> rep")
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    first = classes.select(F.col("rep").alias("doc_id"), "set.*")
    reps = written(
        own.join(first, ["doc_id", *keys], "left_semi")
        .dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("rep"), "n_shingles", "key1", "bands", "sketch"),
        "representatives",
    )
    links = _links(texts, reps)
    edges = copies if links is None else copies.unionByName(links)
    labels = components(edges).withColumnRenamed("rep", "doc_id")
    return (
        features.select("doc_id", "n_shingles")
        .join(labels, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def _buckets(reps: DataFrame) -> DataFrame:
    """bucket, n and first of the buckets of more than one document."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first"))
    return counted.filter("n > 1")


def _forests(reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """child, parent and alike: forest edges of all blocks of all buckets."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep", "bucket"), n_blocks).cast("int"))
    # The bucket's first document is in all of its blocks.
    at = F.when(F.col("rep") == F.col("first"), F.sequence(F.lit(0), n_blocks - 1)).otherwise(own)
    blocks = rows.join(buckets, "bucket").select("rep", "bucket", F.explode(at).alias("block"))
    rows = blocks.join(reps.select("rep", "sketch"), "rep")
    return _grouped(rows, ["bucket", "block"], propose, "child long, parent long, alike double")


def _links(texts: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) between representatives, enough to connect all components."""
    buckets = written(_buckets(reps), "buckets")
    links = _met_links(texts, reps, buckets)
    large = buckets.filter(F.col("n") > BLOCK).select("bucket")
    if large.isEmpty():
        return links
    rows = reps.select("rep", F.explode("bands").alias("bucket")).join(large, "bucket")
    if links is None:
        rows = rows.withColumn("component", F.col("rep"))
    else:
        links = written(links, "links")
        rows = rows.join(components(links), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
    mixed = (
        rows.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high")
    )
    unmet = written(
        rows.join(mixed, "bucket", "left_semi").select("rep", "component").distinct(), "unmet"
    )
    if unmet.isEmpty():
        return links
    more = _unmet_links(texts, reps, unmet)
    return more if links is None else links.unionByName(more)


def _counted_slots(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall on each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column("members"):
                slots = np.frombuffer(raw.as_py(), np.uint64) % np.uint64(SLOTS)
                np.add.at(n, slots.astype(np.int64), 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["slot", "n"])

    partial = map_arrow(sets.select("members"), count, "slot long, n long")
    found = partial.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counted = np.zeros(SLOTS, np.int64)
    counted[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counted


def prefix(members: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that any set reaching the threshold has one too."""
    n = len(members)
    rarity = counted[(members % np.uint64(SLOTS)).astype(np.int64)]
    return members[np.lexsort((members, rarity))[: n + 1 + -THRESHOLD * n // 100]]


def pass_filters(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """Pairs of a query row and another whose sizes and places leave room for the overlap.

    Groups of rows (rep, component, query, size, left), where ``left`` is how many shingles of
    the set do not come before the group's shingle.
    """
    rep, component, query, size, left = (
        table.column(c).to_numpy() for c in ("rep", "component", "query", "size", "left")
    )
    firsts, seconds = [], []
    for a, b in pairwise([0, *ends.tolist()]):
        asked = a + np.flatnonzero(query[a:b])
        other = a + np.flatnonzero(~query[a:b])
        x, y = asked[:, None], other[None, :]
        room = np.minimum(np.minimum(left[x], left[y]), np.minimum(size[x], size[y]))
        fits = (100 + THRESHOLD) * room >= THRESHOLD * (size[x] + size[y])
        i, j = np.nonzero(fits & (component[x] != component[y]))
        firsts.append(rep[asked[i]])
        seconds.append(rep[other[j]])
    one = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    two = np.concatenate(seconds) if seconds else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"]
    )


def _blocks_against_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows with row, turn and query: all rows of a key meet all that are ``open``.

    Rows have n and n_open of their key.  A row of the query side is there as one of the others
    as well.
    """
    dealt = rows.withColumn("rows", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "turns", F.ceil(F.col("n_open") / BLOCK).cast("int")
    )
    row = F.pmod(F.xxhash64("rep", key, F.lit(1)), F.col("rows")).cast("int")
    turn = F.pmod(F.xxhash64("rep", key, F.lit(2)), F.col("turns")).cast("int")
    every_row = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    every_turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    kept = dealt.select("*", row.alias("row")).select("*", every_turn.alias("turn"))
    asked = dealt.filter("open").select("*", turn.alias("turn"))
    asked = asked.select("*", every_row.alias("row"))
    return kept.withColumn("query", F.lit(False)).unionByName(
        asked.withColumn("query", F.lit(True))
    )


def _unmet_links(texts: DataFrame, reps: DataFrame, unmet: DataFrame) -> DataFrame:
    """All links (a, b) between documents (rep, component) of different components."""
    keyed = reps.select("rep", "n_shingles", "key1").join(unmet, "rep", "left_semi")
    sets = written(_sets(texts, keyed), "unmet-sets").select("rep", "members")
    counted = _counted_slots(sets)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_members = [np.frombuffer(m.as_py(), np.uint64) for m in batch.column("members")]
            rarest = [prefix(m, counted) for m in all_members]
            sizes = np.array([len(m) for m in all_members], np.int64)
            lengths = np.array([len(p) for p in rarest], np.int64)
            places = np.concatenate([np.arange(n) for n in [0, *lengths.tolist()]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, np.uint64), *rarest]).view(np.int64)),
                    pa.array(np.repeat(batch.column("rep").to_numpy(), lengths)),
                    pa.array(np.repeat(batch.column("component").to_numpy(), lengths)),
                    pa.array(np.repeat(sizes, lengths)),
                    pa.array(np.repeat(sizes, lengths) - places),
                ],
                ["shingle", "rep", "component", "size", "left"],
            )

    spec = "shingle long, rep long, component long, size long, left long"
    rows = written(map_arrow(sets.join(unmet, "rep"), prefixes, spec), "prefixes")
    shared = (
        rows.groupBy("shingle", "component")
        .agg(F.count("*").alias("m"))
        .groupBy("shingle")
        .agg(
            F.sum("m").alias("n"),
            (F.sum("m") - F.max("m")).alias("n_open"),
            F.max_by("component", F.struct("m", -F.col("component"))).alias("largest"),
        )
        .filter("n_open > 0")
    )
    shared = written(shared, "shared")
    dealt = salted_join(
        rows, shared, ["shingle"], "rep", counts=shared.select("shingle", "n"),
        heavy_rows=HEAVY_SHINGLE,
    ).withColumn("open", F.col("component") != F.col("largest"))
    met = _blocks_against_blocks(dealt, "shingle")
    keys = ["shingle", "row", "turn"]
    met = met.select(*keys, "rep", "component", "query", "size", "left")
    pairs = _grouped(met, keys, pass_filters, "a long, b long").distinct()
    return _confirmed(written(pairs, "pairs"), sets)


def _met_links(texts: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) between representatives that met, enough to connect them."""
    edges = written(_forests(reps, buckets), "forests")
    if edges.isEmpty():
        return None
    ends = edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    clusters = components(ends).withColumnRenamed("component", "cluster")
    # The smallest document of a cluster points at no other.
    firsts = clusters.select(F.col("cluster").alias("rep"), "cluster").distinct()
    clusters = clusters.unionByName(firsts)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    clusters = written(clusters.join(sizes, "cluster"), "clusters")
    keyed = reps.select("rep", "n_shingles", "key1", "sketch").join(clusters, "rep", "left_semi")
    sets = written(_sets(texts, keyed.drop("sketch")), "sets").select("rep", "members")
    described = sets.join(keyed.select("rep", "sketch"), "rep")

    small = clusters.filter(F.col("n") <= BLOCK).join(described, "rep")
    small = small.withColumn("component", F.col("rep")).withColumn("query", F.lit(True))
    columns = ["rep", "component", "query", "sketch", "members"]
    links = _grouped(small.select("cluster", *columns), ["cluster"], resolve, "a long, b long")

    large = written(clusters.filter(F.col("n") > BLOCK).select("rep", "cluster", "n"), "large")
    if large.isEmpty():
        return links
    best = F.sort_array(F.collect_set(F.struct("alike", "parent")), asc=False)
    pairs = (
        edges.join(large.select(F.col("rep").alias("child")), "child", "left_semi")
        .groupBy("child")
        .agg(F.slice(best, 1, 2).alias("best"))
        .select("child", F.explode("best.parent").alias("parent"))
        .select(F.greatest("child", "parent").alias("a"), F.least("child", "parent").alias("b"))
        .distinct()
    )
    confirmed = written(_confirmed(pairs, sets), "confirmed")
    labelled = large.join(components(confirmed), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    largest = (
        labelled.groupBy("cluster", "component")
        .agg(F.count("*").alias("m"))
        .groupBy("cluster")
        .agg(
            F.max_by("component", F.struct("m", -F.col("component"))).alias("_largest"),
            (F.sum("m") - F.max("m")).alias("_open"),
        )
    )
    # Blocks of all documents of a cluster against blocks of those outside its largest component.
    dealt = written(
        labelled.join(largest, "cluster")
        .filter("_open > 0")
        .withColumn("query", F.col("component") != F.col("_largest"))
        .withColumn("rows", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("turns", F.ceil(F.col("_open") / BLOCK).cast("int"))
        .select("rep", "cluster", "component", "query", "rows", "turns"),
        "open",
    )
    row = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rows")).cast("int")
    turn = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("turns")).cast("int")
    every_row = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    every_turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    kept = dealt.select("*", row.alias("row")).select("*", every_turn.alias("turn"))
    asked = dealt.filter("query").select("*", turn.alias("turn"))
    asked = asked.select("*", every_row.alias("row"))
    met = kept.withColumn("query", F.lit(False)).unionByName(asked).join(described, "rep")
    keys = ["cluster", "row", "turn"]
    more = _grouped(met.select(*keys, *columns), keys, resolve, "a long, b long")
    return links.unionByName(confirmed).unionByName(more)
