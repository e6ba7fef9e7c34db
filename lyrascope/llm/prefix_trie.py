"""Prefix trie of rebuilt conversations by composable fingerprints (operator 13).

A sequence of turns has the fingerprint ``sum(t[i] * b**i) mod p`` for four primes p.  With the
power ``b**length`` beside it this is a monoid: the fingerprint of a sequence follows from those
of its parts.  A rebuilt conversation is the head of one conversation and a suffix of another,
so all its prefixes have fingerprints made of running sums of the two; no text is put together,
or moved, to get them.  Prefixes of one depth and fingerprint are one node.

Equality is verified: the members of every node agree in their parent node, and turns that
share a fingerprint are compared whole, so by induction all members of a node have the same
turns.  If any comparison fails, all is done again with other powers.  Every node keeps a
reference (conversation, place) to its last turn, from where its text can be read.

Sums over subtrees need no walk: nodes of one smallest member form a chain down to that
member's end, and a subtree is a chain's rest and the whole chains of its other members.
"""

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.operators.skew import id_buckets, number_rows, salted_join

# Conversations of one group are rebuilt on the head of the group's first one.
GROUP = 100

# The head has the crc32 of the id modulo this many turns.
HEADS = 6

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)

# Turns or nodes of one conversation that one task runs sums over: 2 to this power.
RUN_BITS = 16

# Powers are looked up by digits of so many bits, which is enough for 2^40 turns.
DIGIT_BITS, DIGITS = 8, 5

# Other powers are tried so often if different turns share a fingerprint.
TRIES = 5

# Characters of ids that are hashed at a time.
PIECE = 1 << 16

NODE = ["depth", "fa", "fb"]


@dataclass
class Powers:
    """Bases of the four fingerprints and what is derived from them."""

    seed: int

    def __post_init__(self):
        draw = random.Random(self.seed)
        self.bases = [draw.randrange(1 << 20, p - 1) for p in PRIMES]

    def turn(self, role: Column, text: Column) -> list[Column]:
        """The four values of a turn, from two 64-bit hashes."""
        first, second = (F.xxhash64(F.lit(2 * self.seed + i), role, text) for i in (0, 1))
        halves = [
            part
            for x in (first, second)
            for part in (x.bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(x, 33))
        ]
        return [half % p for half, p in zip(halves, PRIMES, strict=True)]

    def power(self, place: str, i: int) -> Column:
        """``base**place`` by the digits of the place."""
        p, base, made = PRIMES[i], self.bases[i], F.lit(1).cast("long")
        for digit in range(DIGITS):
            shift = DIGIT_BITS * digit
            step = pow(base, 1 << shift, p)
            table = _table([pow(step, k, p) for k in range(1 << DIGIT_BITS)])
            index = f"cast(shiftright({place}, {shift}) & {(1 << DIGIT_BITS) - 1} as int)"
            made = made * F.expr(f"{table}[{index}]") % p
        return made

    def shift_back(self, places: str, i: int) -> Column:
        """``base**-places`` for up to HEADS places."""
        table = _table([pow(self.bases[i], -k, PRIMES[i]) for k in range(HEADS + 1)])
        return F.expr(f"{table}[cast({places} as int)]")


def _table(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _run(column: str) -> Column:
    return F.shiftright(column, RUN_BITS).alias("run")


def _packed(values: list[Column]) -> list[Column]:
    """Four residues in two integers."""
    return [F.shiftleft(values[i], 31).bitwiseOR(values[i + 1]) for i in (0, 2)]


FOUR = range(4)


def number_turns(conversations: DataFrame, powers: Powers) -> DataFrame:
    """conv_id, place (from 1), weights w0 to w3 and n_chars of every turn, without its text.

    Turns are ordered by their number, NULL first, and by a fixed hash of role and text.  Rows
    without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.xxhash64(role, text).alias("tie"),
        F.length(text).cast("long").alias("n_chars"),
        *[value.alias(f"t{i}") for i, value in enumerate(powers.turn(role, text))],
    )
    order = [F.asc_nulls_first("turn"), F.col("tie"), F.col("t0"), F.col("t2")]
    numbered = number_rows(turns, ["conv_id"], id_buckets("turn"), order, "place")
    weights = [
        (F.col(f"t{i}") * powers.power("place", i) % PRIMES[i]).alias(f"w{i}") for i in FOUR
    ]
    return numbered.withColumn("place", F.col("place").cast("long")).select(
        "conv_id", "place", "n_chars", *weights
    )


def _sum_of(heads: str, count: str, i: int) -> Column:
    added = f"aggregate(slice({heads}, 1, {count}), 0L, (s, x) -> s + x.w{i})"
    return F.expr(added) % PRIMES[i]


def rebuilt_turns(turns: DataFrame, powers: Powers) -> DataFrame:
    """One row per rebuilt conversation and depth, from 0: its node and its parent node.

    Columns: conv_id, depth, fa and fb (the fingerprint), pa and pb (its parent's), n_chars and
    ref (conversation and place of the last turn), length (turns of the rebuilt conversation).
    """
    item = F.struct("place", "n_chars", *[f"w{i}" for i in FOUR])
    own = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("place") < HEADS, item))).alias("head"),
        F.count("*").alias("n_own"),
    )
    bases = own.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    info = (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
        .join(bases, "base", "left")
        .withColumn("base_head", F.coalesce("base_head", F.filter("head", lambda _: F.lit(False))))
        .withColumn("h", h.cast("int"))
        .withColumn("taken", F.least("h", F.size("base_head")))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
        .select(
            "*",
            *[_sum_of("base_head", "taken", i).alias(f"b{i}") for i in FOUR],
            *[_sum_of("head", "h", i).alias(f"s{i}") for i in FOUR],
            *[powers.shift_back("h - taken", i).alias(f"v{i}") for i in FOUR],
        )
    )

    def rows(source: DataFrame, whole: list[Column], last: list[Column]) -> DataFrame:
        """Nodes of ``source`` with the fingerprint and what its last turn adds to it."""
        before = [(f - w + p) % p for f, w, p in zip(whole, last, PRIMES, strict=True)]
        fa, fb = _packed(whole)
        pa_, pb = _packed(before)
        return source.select(
            "conv_id",
            F.col("depth").cast("long"),
            fa.alias("fa"),
            fb.alias("fb"),
            pa_.alias("pa"),
            pb.alias("pb"),
            F.col("n_chars").cast("long"),
            "ref",
            F.col("length").cast("long"),
        )

    heads = info.select("*", F.explode(F.sequence(F.lit(0), "taken")).alias("depth")).withColumn(
        "last", F.expr("try_element_at(base_head, nullif(depth, 0))")
    )
    zero = F.lit(0).cast("long")
    ref = F.struct(F.col("base").alias("conv_id"), F.col("depth").cast("long").alias("place"))
    shared = rows(
        heads.withColumn("n_chars", F.coalesce("last.n_chars", zero)).withColumn(
            "ref", F.when(F.col("depth") > 0, ref)
        ),
        [_sum_of("base_head", "depth", i) for i in FOUR],
        [F.coalesce(f"last.w{i}", zero) for i in FOUR],
    )

    # Running sums inside runs of places, and the sums of the runs before.
    by_run = turns.select("*", _run("place"))
    inside = Window.partitionBy("conv_id", "run").orderBy("place")
    summed = by_run.select(
        "conv_id",
        "run",
        "place",
        "n_chars",
        *[f"w{i}" for i in FOUR],
        *[F.sum(f"w{i}").over(inside).alias(f"r{i}") for i in FOUR],
    )
    earlier = (
        Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = by_run.groupBy("conv_id", "run").agg(
        *[(F.sum(f"w{i}") % PRIMES[i]).alias(f"w{i}") for i in FOUR]
    )
    runs = runs.select(
        "conv_id",
        "run",
        *[
            (F.coalesce(F.sum(f"w{i}").over(earlier), zero) % PRIMES[i]).alias(f"e{i}")
            for i in FOUR
        ],
    ).join(info.drop("head", "base_head", "base"), "conv_id")
    suffix = (
        summed.join(runs, ["conv_id", "run"])
        .filter(F.col("place") > F.col("h"))
        .withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
        .withColumn("ref", F.struct("conv_id", "place"))
    )
    whole, last = [], []
    for i in FOUR:
        own_part = (F.col(f"e{i}") + F.col(f"r{i}") - F.col(f"s{i}") + PRIMES[i]) % PRIMES[i]
        whole.append((F.col(f"b{i}") + F.col(f"v{i}") * own_part) % PRIMES[i])
        last.append(F.col(f"v{i}") * F.col(f"w{i}") % PRIMES[i])
    return shared.unionByName(rows(suffix, whole, last))


def _verified(conversations: DataFrame, nodes: DataFrame, powers: Powers) -> bool:
    """Whether turns of one fingerprint are equal, and nodes have one parent and last turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = conversations.filter("conv_id IS NOT NULL").select(
        *[k.alias(n) for n, k in zip("xy", _packed(powers.turn(role, text)), strict=True)],
        F.struct(role.alias("role"), text.alias("text")).alias("turn"),
    )
    unlike = keyed.groupBy("x", "y").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    if not unlike.filter("low <> high").isEmpty():
        return False
    return nodes.filter("NOT one_parent").isEmpty()


def build(conversations: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie and the rows (conversation, depth) that are their members.

    Nodes have depth, fa, fb, pa, pb, conv_id (the smallest member), n_convs, n_chars and ref.
    """
    for attempt in range(TRIES):
        powers = Powers(seed + attempt)
        turns = written(number_turns(conversations, powers), "turns")
        members = written(rebuilt_turns(turns, powers), "members")
        nodes = written(
            members.groupBy(*NODE).agg(
                F.min("conv_id").alias("conv_id"),
                F.count("*").alias("n_convs"),
                F.max("n_chars").alias("n_chars"),
                F.min("pa").alias("pa"),
                F.min("pb").alias("pb"),
                F.min("ref").alias("ref"),
                (
                    (F.min("pa") == F.max("pa"))
                    & (F.min("pb") == F.max("pb"))
                    & (F.min("n_chars") == F.max("n_chars"))
                ).alias("one_parent"),
            ),
            "nodes",
        )
        if _verified(conversations, nodes, powers):
            return nodes, members
    raise RuntimeError("different turns share a fingerprint for every choice of powers")


def _with_chains(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the sums of their chain from themselves on, and the chains.

    A chain are the nodes of one smallest member, down to its end; it has ``top`` (its smallest
    depth), ``cost`` (all its nodes' saved characters) and ``leaf`` (1 if its end is childless).
    """
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")
    )
    counted = (
        nodes.join(children.agg(F.count("*").alias("n_children")), NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
        .withColumn("run", _run("depth"))
    )
    inside = Window.partitionBy("conv_id", "run").orderBy("depth")
    summed = counted.withColumn("up_to", F.sum("saved").over(inside))
    whole = Window.partitionBy("conv_id")
    runs = (
        counted.groupBy("conv_id", "run")
        .agg(
            F.sum("saved").alias("saved"),
            F.min("depth").alias("top"),
            F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"),
        )
        .select(
            "conv_id",
            "run",
            (F.sum("saved").over(whole.orderBy("run")) - F.col("saved")).alias("earlier"),
            F.sum("saved").over(whole).alias("cost"),
            F.min("top").over(whole).alias("top"),
            F.sum("leaf").over(whole).alias("leaf"),
        )
    )
    runs = written(runs, "chains")
    below = F.col("cost") - F.col("earlier") - F.col("up_to") + F.col("saved")
    joined = summed.join(runs, ["conv_id", "run"]).withColumn("cost_below", below)
    return joined.drop("up_to", "earlier", "saved", "run", "cost"), runs.select(
        "conv_id", "top", "cost", "leaf"
    ).distinct()


def _others(members: DataFrame, chains: DataFrame) -> DataFrame:
    """Sums over the chains of a node's members that hang below it.

    A member's chain hangs below every node of its path above the chain's top.
    """
    hanging = chains.filter("top > 0 AND (cost > 0 OR leaf > 0)").select(
        "conv_id",
        "top",
        "cost",
        "leaf",
        F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("top") - 1, RUN_BITS))).alias(
            "run"
        ),
    )
    return (
        members.select("conv_id", *NODE, _run("depth"))
        .join(hanging, ["conv_id", "run"])
        .filter("depth < top")
        .groupBy(*NODE)
        .agg(F.sum("cost").alias("other_cost"), F.sum("leaf").alias("other_leaves"))
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """parent_conv_id of the nodes at the top of a chain; others have their own conv_id."""
    tops = nodes.filter("depth = top AND depth > 0").select(
        "depth", "fa", "fb", (F.col("depth") - 1).alias("up"), "pa", "pb"
    )
    above = nodes.filter("n_children > 0").select(
        F.col("depth").alias("up"),
        F.col("fa").alias("pa"),
        F.col("fb").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    joined = salted_join(tops, above, ["up", "pa", "pb"], "fa")
    return joined.select(*NODE, "parent_conv_id")


KEY = pa.schema([(c, pa.int64()) for c in NODE])
PIECES = KEY.append(pa.field("first", pa.int64())).append(pa.field("ids", pa.string()))
HASHES = KEY.append(pa.field("ends_sha256", pa.string()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of node and conv_id as strings of ids of a bounded size."""
    node, first, held, size = None, 0, [], 0
    for batch in batches:
        made = []
        for *key, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != node or size > PIECE:
                if held:
                    made.append((*node, first, ",".join(held)))
                node, first, held, size = key, conv_id, [], 0
            held.append(str(conv_id))
            size += len(held[-1]) + 1
        if made:
            yield _batch(made, PIECES)
    if held:
        yield _batch([(*node, first, ",".join(held))], PIECES)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its pieces, which come in order; nothing is put together."""
    node, held = None, None
    for batch in batches:
        made = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == node:
                held.update(b"," + ids.encode())
                continue
            if held is not None:
                made.append((*node, held.hexdigest()))
            node, held = key, hashlib.sha256(ids.encode())
        if made:
            yield _batch(made, HASHES)
    if held is not None:
        yield _batch([(*node, held.hexdigest())], HASHES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _ends(members: DataFrame) -> DataFrame:
    """ends_sha256 of every node at which rebuilt conversations end.

    Ids are sorted over ranges, so a node with very many ends is spread over several tasks; a
    single one then hashes its pieces one after the other.
    """
    columns = [*NODE, "conv_id"]
    ends = members.filter("depth = length").select(*columns)
    ordered = ends.repartitionByRange(*columns).sortWithinPartitions(*columns)
    long_key = ", ".join(f"{c} long" for c in NODE)
    pieces = map_arrow(ordered, _pieces, f"{long_key}, first long, ids string")
    together = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return map_arrow(together, _hashes, f"{long_key}, ends_sha256 string")


def trie(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (conv_id, turn, role, text).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and ref: conversation and place of a row that holds the node's last turn (NULL
    for the root).  NULL roles and texts are empty ones, repeated rows are turns of their own,
    turns of one number are ordered by a hash, rows without a conv_id are left out, further
    columns do not matter.  An empty table has no nodes.
    """
    nodes, members = build(conversations, seed)
    chained, chains = _with_chains(nodes)
    chained = written(chained, "chained")
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    own_parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id"))
    return (
        chained.join(_others(members, chains), NODE, "left")
        .join(_parents(chained), NODE, "left")
        .join(_ends(members), NODE, "left")
        .select(
            "conv_id",
            "depth",
            F.coalesce(own_parent, "parent_conv_id").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            (F.col("leaf") + F.coalesce("other_leaves", zero)).alias("n_leaves"),
            (F.col("cost_below") + F.coalesce("other_cost", zero)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
            "ref",
        )
    )
