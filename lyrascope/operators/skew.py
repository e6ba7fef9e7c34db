"""Joins and row numbers that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that a single task may take.  A table of N rows has at most N / HEAVY_ROWS
# heavier keys, which bounds the broadcast list of heavy keys.
HEAVY_ROWS = 1_000_000


def salted_join(
    probe: DataFrame,
    build: DataFrame,
    on: Sequence[str],
    spread_by: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    wide: bool = False,
) -> DataFrame:
    """Equi-join of a probe side with heavy keys to a build side with one row per key.

    Keys with more than ``heavy_rows`` probe rows are cut into slices of that size: the
    probe row picks a slice by a hash of ``spread_by`` and the build row is repeated per
    slice.  ``counts`` (key columns and ``n``) may be passed where it is known already.
    Build rows that are ``wide`` are never broadcast: Spark judges a table by its file, and
    arrays of few different labels are a hundred times larger in memory.
    """
    on = list(on)
    if counts is None:
        counts = probe.groupBy(*on).agg(F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / heavy_rows).cast("int")
    heavy = F.broadcast(
        counts.filter(F.col("n") > heavy_rows).select(*on, slices.alias("_slices"))
    )
    probe = probe.join(heavy, on, "left").withColumn(
        "_slice",
        F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_slices")).cast("int"), F.lit(0)),
    )
    build = build.join(heavy, on, "left").withColumn(
        "_slice",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)),
    )
    probe, build = probe.drop("_slices"), build.drop("_slices")
    if wide:
        probe, build = probe.hint("merge"), build.hint("merge")
    return probe.join(build, [*on, "_slice"], how).drop("_slice")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    name: str,
) -> DataFrame:
    """Exact row_number() per group, from 1, without sorting a whole group in one task.

    ``buckets`` cut a group into consecutive ranges of ``order``, coarse ones first.  Rows
    are numbered inside the finest range; the sizes of the ranges before it are added.
    """
    cut = [f"_b{i}" for i in range(len(buckets))]
    ranges = [bucket.alias(c) for bucket, c in zip(buckets, cut)]
    df = df.select("*", F.struct(*group).alias("_group"), *ranges)
    sizes = df.groupBy("_group", *cut).agg(F.count("*").alias("_size"))
    before = None
    for depth in range(len(cut)):
        outer = _range_key(cut[:depth])
        running = (
            Window.partitionBy("_outer")
            .orderBy(cut[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = (
            sizes.groupBy("_group", *cut[: depth + 1])
            .agg(F.sum("_size").alias("_size"))
            .select(
                outer.alias("_outer"),
                _range_key(cut[: depth + 1]).alias("_range"),
                cut[depth],
                "_size",
            )
            .withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        )
        if before is not None:
            coarse = before.select(
                F.col("_range").alias("_outer"), F.col("_before").alias("_earlier")
            )
            step = step.join(coarse, "_outer").withColumn(
                "_before", F.col("_before") + F.col("_earlier")
            )
        before = step.select("_range", "_before")
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        df.withColumn("_range", _range_key(cut))
        .withColumn("_inside", F.row_number().over(inside))
        .join(before, "_range")
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_range", "_group", *cut)
    )


def _range_key(cut: Sequence[str]) -> Column:
    """Group and ranges as one struct: unlike bare columns, its NULL fields match in a join."""
    return F.struct("_group", *cut)


def id_buckets(column: str) -> list[Column]:
    """Ranges of a bigint id, at most 2^22 by 2^21 per group and 2^21 ids in each."""
    return [F.shiftright(column, 42), F.shiftright(column, 21)]


def top_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread_by: str, name: str
) -> DataFrame:
    """The k first rows of each group with their rank, chosen in slices of a group first."""
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(64)))
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    overall = Window.partitionBy(*group).orderBy(*order)
    candidates = sliced.withColumn(name, F.row_number().over(within)).filter(F.col(name) <= k)
    return (
        candidates.drop(name, "_slice")
        .withColumn(name, F.row_number().over(overall))
        .filter(F.col(name) <= k)
    )
