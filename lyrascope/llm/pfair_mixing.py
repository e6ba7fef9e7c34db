"""Mixing sources to target weights by Pfair scheduling (operator 3).

Every source's rows are put in the order of a hash and cut into blocks.  A source with the
integer share n of the D shares in all has the weight n / D: its k-th block (from 0) is released
at slot floor(k * D / n) and due before slot ceil((k + 1) * D / n).  Taking the released block
with the earliest deadline in each slot meets all deadlines, so at every slot each source has
come up less than one block more or less often than its weight says.

The schedule repeats after D slots, a cycle.  Sources that run out leave the later cycles, and
in the cycle in which they run out they take part with the blocks they have left; so all rows
are kept, and at most two kinds of cycles more than sources need a schedule.

Only so many sources as OWN_SHARES take part by themselves.  Beyond that smaller sources weigh a
power of two each, and those of one weight share a server, which has the weight of all of them,
is scheduled like a source and serves them in turn, which is the Pfair schedule of equal weights.
So a server keeps within a block of its weight, and a source within a block of its weight inside
the server.  There are few powers of two, so the schedules, whose size depends neither on the
rows nor on the sources, are made in one small job, and blocks of served sources are numbered by
Spark.
"""

import heapq
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.operators.skew import number_rows

BLOCK_ROWS = 64

# Shares in a cycle, about; a source has one share at least.
CYCLE = 256

# Sources with a share of their own in a cycle; a cycle needs a slot for each.
OWN_SHARES = 1024

# Slots of a cycle at most, about; larger shares are scaled down together.
MOST_SLOTS = 1 << 14

# Phases are looked up in steps of so many.
STEP = 48

NEW = ["block", "slot", "released", "due", "place"]

# Schedule rows (under 100 bytes) that may be broadcast.
BROADCAST_ROWS = 200_000


def schedule(counts: Mapping) -> list[tuple]:
    """(source, k, slot, release, deadline) of a cycle with so many blocks of each source."""
    total = sum(counts.values())
    names = list(counts)
    jobs = sorted(
        (k * total // counts[s], -(-(k + 1) * total // counts[s]), i, k)
        for i, s in enumerate(names)
        for k in range(counts[s])
    )
    ready, made, at = [], [], 0
    for slot in range(total):
        while at < len(jobs) and jobs[at][0] <= slot:
            release, deadline, i, k = jobs[at]
            heapq.heappush(ready, (deadline, i, k, release))
            at += 1
        deadline, i, k, release = heapq.heappop(ready)
        made.append((names[i], k, slot, release, deadline))
    return made


@dataclass
class Phase:
    """Cycles ``first`` and on with the same blocks of each source, from slot ``slot`` on."""

    first: int
    slot: int
    counts: dict

    @property
    def width(self) -> int:
        return sum(self.counts.values())


def phases(shares: Mapping, blocks: Mapping) -> list[Phase]:
    """All kinds of cycles in order, for sources with so many shares and blocks."""
    changes = {0}
    for s, n in shares.items():
        changes |= {blocks[s] // n, -(-blocks[s] // n)}
    made, slot = [], 0
    ordered = sorted(changes)
    for first, after in zip(ordered, ordered[1:], strict=False):
        counts = {
            s: min(n, blocks[s] - first * n) for s, n in shares.items() if blocks[s] > first * n
        }
        made.append(Phase(first, slot, counts))
        slot += (after - first) * made[-1].width
    return made


def scaled(weights: Mapping, slots: int) -> dict:
    """Integer shares, at least 1, that are in proportion to weights and make up about ``slots``."""
    total = sum(weights.values())
    return {s: max(1, round(slots * w / total)) for s, w in weights.items()}


def mix(
    docs: DataFrame,
    shares: Mapping | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of documents (doc_id, source) with block, slot, released, due and place.

    ``shares`` has integer target shares by source, 0 or more; sources without one get 1, and
    without any shares a source weighs the square root of its rows, which lifts small sources
    (see above for more sources than OWN_SHARES, named and large ones first).
    ``slot`` is the block's place in the mixed order, ``released <= slot < due`` (of a server's
    block: the server's window), ``place`` the row's place in its block.  NULL is a source of
    its own; rows with equal doc_ids and sources are told apart by nothing and come one after
    the other; an empty table gives no rows.  Columns of the input that have one of the new
    names are replaced; ``in_mixed_order`` keeps them.
    """
    mixed = _mixed(docs, shares, block_rows)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in NEW]
    return mixed.select(*kept, *NEW)


def _weights(docs: DataFrame, shares: Mapping | None, block_rows: int) -> DataFrame:
    """source, weight, blocks, whether it is named, and the power of two below its weight."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    weight, named = F.sqrt("n"), F.lit(False)
    if shares is not None:
        # As many rows as the caller names.
        given = docs.sparkSession.createDataFrame(
            [(s, float(max(1, w))) for s, w in shares.items()], "_named string, _share double"
        )
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_named")), "left")
        weight, named = F.coalesce("_share", F.lit(1.0)), F.col("_share").isNotNull()
    return sizes.select(
        "source",
        weight.alias("weight"),
        F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"),
        named.alias("named"),
        F.floor(F.log2(weight)).alias("power"),
    )


def _in_turn(rows: DataFrame, small: DataFrame, block: Column) -> DataFrame:
    """Rows of the sources ``small`` with the number ``_at`` of their block at its server."""
    blocks = small.select(
        "power",
        "source",
        F.xxhash64("source").alias("tie"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
    )
    ordered = number_rows(
        blocks,
        ["power"],
        [F.col("block"), F.shiftright("tie", 52)],
        [F.col("block"), F.col("tie"), F.col("source")],
        "_number",
    ).select(
        F.struct("source", "block").alias("_key"),
        (F.col("_number") - 1).alias("_at"),
        F.col("power").alias("_power"),
    )
    keyed = rows.withColumn("_key", F.struct("source", block.alias("block")))
    return keyed.join(ordered, "_key").drop("_key")


def _mixed(docs: DataFrame, shares: Mapping | None, block_rows: int) -> DataFrame:
    """The input's rows as one column ``_row``, so that no name of theirs matters, and NEW."""
    spark = docs.sparkSession
    docs = docs.select(F.struct("*").alias("_row"), "source", "doc_id")
    weights = written(_weights(docs, shares, block_rows), "sources")
    # OWN_SHARES rows at most.
    most = weights.orderBy(F.desc("named"), F.desc("blocks"), "source").limit(OWN_SHARES).collect()
    most.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    own = F.broadcast(
        spark.createDataFrame(
            [(r["source"], i) for i, r in enumerate(most)], "_own string, _own_number long"
        )
    )
    small = weights.join(own, weights["source"].eqNullSafe(own["_own"]), "left_anti")
    # A row for each power of two.
    servers = (
        small.groupBy("power")
        .agg(F.count("*").alias("sources"), F.sum("blocks").alias("blocks"))
        .orderBy("power")
        .collect()
    )
    weight_of = dict(enumerate(r["weight"] for r in most))
    blocks_of = dict(enumerate(r["blocks"] for r in most))
    server_of = {}
    for number, r in enumerate(servers, len(most)):
        server_of[r["power"]] = number
        weight_of[number] = r["sources"] * 2.0 ** r["power"]
        blocks_of[number] = r["blocks"]
    slots = sum(weight_of.values()) if shares is not None else CYCLE
    if shares is not None and slots <= MOST_SLOTS:
        share_of = {s: round(w) for s, w in weight_of.items()}
    else:
        share_of = scaled(weight_of, min(slots, MOST_SLOTS))
    cycles = phases(share_of, blocks_of)

    def schedules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                made = np.array(schedule(cycles[number].counts), np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(made), number)), *map(pa.array, made.T)],
                    ["_phase", "_source", "_k", "_offset", "_release", "_deadline"],
                )

    table = map_arrow(
        spark.range(0, len(cycles), 1, max(1, len(cycles) // 64)),
        schedules,
        "_phase long, _source long, _k long, _offset long, _release long, _deadline long",
    )
    if sum(phase.width for phase in cycles) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    hashed = docs.withColumn("_hash", F.xxhash64("doc_id"))
    numbered = number_rows(
        hashed,
        ["source"],
        [F.shiftright("_hash", 52)],
        [F.col("_hash"), F.col("doc_id")],
        "_number",
    ).join(own, F.col("source").eqNullSafe(F.col("_own")), "left")
    block = F.floor((F.col("_number") - 1) / block_rows)
    number = F.col("_own_number")
    found = numbered.withColumn("_at", block)
    if servers:
        of_power = F.create_map(*[F.lit(v).cast("long") for pair in server_of.items() for v in pair])
        served = _in_turn(numbered.filter(number.isNull()), small, block)
        found = found.filter(number.isNotNull()).unionByName(
            served.withColumn("_own_number", of_power[F.col("_power")]).drop("_power")
        )

    def constants(values: Iterable[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    def of_phase(values: Iterable[int]) -> Column:
        return F.get(constants(values), F.col("_phase"))

    def last(firsts: Column) -> Column:
        return F.size(F.filter(firsts, lambda f: f <= F.col("_cycle"))) - 1

    firsts = [p.first for p in cycles]
    placed = (
        found.withColumn("block", block)
        .withColumn("place", ((F.col("_number") - 1) % block_rows).cast("int"))
        .withColumn("_source", number)
        .withColumn("_share", F.get(constants(share_of.values()), F.col("_source").cast("int")))
        .withColumn("_cycle", F.floor(F.col("_at") / F.col("_share")))
        .withColumn("_step", last(constants(firsts[::STEP])) * STEP)
        .withColumn(
            "_phase",
            F.col("_step") + last(F.slice(constants(firsts), F.col("_step") + 1, STEP)),
        )
        .withColumn("_k", F.col("_at") - F.col("_cycle") * F.col("_share"))
        .withColumn(
            "_start",
            of_phase(p.slot for p in cycles)
            + (F.col("_cycle") - of_phase(firsts)) * of_phase(p.width for p in cycles),
        )
    )
    return (
        placed.join(table, ["_source", "_phase", "_k"])
        .withColumns(
            {
                "slot": F.col("_start") + F.col("_offset"),
                "released": F.col("_start") + F.col("_release"),
                "due": F.col("_start") + F.col("_deadline"),
            }
        )
        .select("_row", *NEW)
    )


def in_mixed_order(
    docs: DataFrame, shares: Mapping | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows of documents in the mixed order: partition by partition, and within each.

    All columns of the input stay as they are, whatever their names.
    """
    return (
        _mixed(docs, shares, block_rows)
        .repartitionByRange("slot", "place")
        .sortWithinPartitions("slot", "place")
        .select("_row.*")
    )
