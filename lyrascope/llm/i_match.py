"""Document fingerprints by I-Match over randomised lexicons (operator 8), in Spark's functions.

The lexicon holds the terms of a band of inverse document frequency.  A fingerprint is one hash
for each of several random subsets of the lexicon: that of the document's distinct terms in the
subset, in sorted order.  Wide subsets leave out one part of the lexicon each, so that every term
of the band is in all of them but one.  Coarse subsets tell short documents apart, fine ones show how much
two long documents share; the likeness of two fingerprints is the share of equal hashes among
the subsets that either document has a term of.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrascope.llm.shared import written

# Documents with a term, as a share of all: the band of the lexicon.
LEAST, MOST = 1 / 2048, 1 / 8

# Wide subsets, by their number the part of the lexicon that is left out.
WIDE = 4

# A narrow subset takes one of so many terms, by subset.  Two texts with d different band terms
# share most hashes at a rate of about d, so the rates go up in steps of two.
PER_RATE = 6
RATES = [1 << k for k in range(4, 12) for _ in range(PER_RATE)]

SUBSETS = WIDE + len(RATES)

# Lexicon rows (a term and a number, about 50 bytes) that may be broadcast.  The lexicon has at
# most (mean distinct terms of a document) / LEAST of them.
BROADCAST_ROWS = 300_000

# Stands for a NULL doc_id in joins.
NO_ID = -(2**63)

GAP = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text; the empty string stands for none."""
    return F.array_distinct(F.split(F.lower(text), GAP))


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """term and subsets (one bit for each) of the band's terms, from all texts."""
    n = texts.count()
    # An outer explode: the plain one adds a filter that splits the text a second time.
    found = texts.select(F.explode_outer(terms(F.col("text"))).alias("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    bits = F.lit(0).cast("long")
    part = F.pmod(F.xxhash64("term", F.lit(len(RATES))), F.lit(WIDE))
    drawn = [part != j for j in range(WIDE)]
    drawn += [
        F.pmod(F.xxhash64("term", F.lit(j)), F.lit(rate)) == 0 for j, rate in enumerate(RATES)
    ]
    for j, taken in enumerate(drawn):
        bits = bits.bitwiseOR(F.when(taken, F.lit(1 << j)).otherwise(0).cast("long"))
    in_band = (F.col("term") != "") & (F.col("n") >= least * n) & (F.col("n") <= most * n)
    return counts.filter(in_band).select("term", bits.alias("subsets"))


def _hashes(kept: Column) -> Column:
    """One hash per subset of sorted (term, subsets), NULL for a subset without a term."""

    def within(own: Column, numbers: range) -> Column:
        bits = sum(1 << j for j in numbers)
        return F.filter(own, lambda term: term["subsets"].bitwiseAND(F.lit(bits)) != 0)

    def hashed(own: Column, numbers: range) -> Column:
        return F.transform(
            F.array(*[F.lit(1 << j).cast("long") for j in numbers]),
            lambda bit: F.xxhash64(
                F.filter(own, lambda term: term["subsets"].bitwiseAND(bit) != 0)
            ),
        )

    def once(own: Column, numbers: range, function) -> Column:
        # As a lambda's variable the terms are filtered once, not for every subset.
        return F.flatten(F.transform(F.array(within(own, numbers)), function))

    def by_rate(own: Column) -> Column:
        levels = [range(j, j + PER_RATE) for j in range(WIDE, SUBSETS, PER_RATE)]
        return F.flatten(F.array(*[one_rate(own, numbers) for numbers in levels]))

    def one_rate(own: Column, numbers: range) -> Column:
        return once(own, numbers, lambda few: hashed(few, numbers))

    fine = once(kept, range(WIDE, SUBSETS), by_rate)
    made = F.concat(hashed(kept, range(WIDE)), fine)
    # The hash of an empty array is its seed.
    return F.transform(made, lambda h: F.when(h != 42, h))


def _as_text(hashes: Column, whole: Column) -> Column:
    """Hex digits of all hashes, ``-`` for an empty subset; the whole hash if all are empty."""

    def digits(number: Column) -> Column:
        return F.lower(F.lpad(F.hex(number), 16, "0"))

    joined = F.array_join(F.transform(hashes, digits), "", "-")
    return F.when(F.exists(hashes, lambda h: h.isNotNull()), joined).otherwise(digits(whole))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Share of equal hashes among the subsets that are filled on either side.

    Without any, 1 for equal sets of terms and 0 for others.
    """
    pairs = F.zip_with(
        a,
        b,
        lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(
            F.coalesce((x == y).cast("int"), F.lit(0))
        ),
    )
    either = F.size(F.filter(pairs, lambda p: p.isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p == 1))
    return F.when(either > 0, same / either).otherwise((whole_a == whole_b).cast("double"))


def followers(ids: DataFrame) -> DataFrame:
    """Adds ``next`` to rows with distinct ``key``: the next smaller key, after the last the first.

    Keys are dealt to ranges; only the ends of the ranges meet in one place.
    """
    dealt = written(
        ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids"
    )
    inside = dealt.withColumn(
        "next", F.lag("key").over(Window.partitionBy("part").orderBy("key"))
    )
    # One row for each range.
    ends = dealt.groupBy("part").agg(F.max("key").alias("high"))
    ranges = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    below = ends.select(
        "part", F.coalesce(F.lag("high").over(ranges), F.max("high").over(whole)).alias("_below")
    )
    return (
        inside.join(below, "part")
        .withColumn("next", F.coalesce("next", "_below"))
        .drop("part", "_below")
    )


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text, edited) of all documents, and their (key, next).

    The edited text has the last half of the code points, rounded down, replaced by as many
    from the start of the next document in descending doc_id.  Rows of one doc_id are one
    document, with the shortest of their texts, and among those the one of least hash.
    """
    size = F.struct(F.length("text"), F.xxhash64("text"))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ids = rows.groupBy("key").agg(F.min(size).alias("size"))
    pairs = written(
        followers(ids.select("key", (F.col("size.col1") / 2).cast("long").alias("half"))), "pairs"
    )
    # Hashed by key once: both joins below read the same exchange.
    own = rows.groupBy("key").agg(F.min_by("text", size).alias("text"))
    lent = own.withColumnsRenamed({"key": "next", "text": "lender"})
    heads = pairs.join(lent, "next").select(
        "key", F.expr("substring(lender, 1, int(half))").alias("head"), "half"
    )
    edited = own.join(heads, "key").select(
        "key",
        "text",
        F.concat(F.expr("substring(text, 1, int(length(text) - half))"), "head").alias("edited"),
    )
    return edited, pairs.select("key", "next")


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    NULL texts are empty; a document without a term of the band has the hash of all its terms;
    a NULL doc_id comes last in descending order; one document is its own next; further columns
    are left out; no rows give no rows.
    """
    texts, pairs = edited_pairs(docs)
    band = written(
        lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), least, most), "lexicon"
    )
    if band.count() <= BROADCAST_ROWS:
        band = F.broadcast(band)
    sides = F.array(
        *[
            F.struct(F.lit(k).alias("edited"), terms(F.col(c)).alias("terms"))
            for k, c in enumerate(("text", "edited"))
        ]
    )
    split = texts.select("key", F.explode(sides).alias("side")).select(
        "key", F.col("side.edited").alias("edited"), F.explode("side.terms").alias("term")
    )
    # The documents stay where the join by key has put them.
    hashed = (
        split.join(band, "term")
        .groupBy("key", "edited")
        .agg(F.sort_array(F.collect_list(F.struct("term", "subsets"))).alias("kept"))
        .select("key", "edited", _hashes(F.col("kept")).alias("hashes"))
    )
    prints = hashed.groupBy("key").agg(
        *[
            F.max(F.when(F.col("edited") == k, F.col("hashes"))).alias(name)
            for k, name in enumerate(("hashes", "hashes_edited"))
        ]
    )
    empty = F.array_repeat(F.lit(None).cast("long"), SUBSETS)
    both = written(
        texts.select(
            "key",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited"), 256).alias("edited_sha256"),
            F.xxhash64(F.sort_array(terms(F.col("text")))).alias("whole"),
            F.xxhash64(F.sort_array(terms(F.col("edited")))).alias("whole_edited"),
        )
        .join(prints, "key", "left")
        .withColumn("hashes", F.coalesce("hashes", empty))
        .withColumn("hashes_edited", F.coalesce("hashes_edited", empty)),
        "fingerprints",
    )
    following = both.select(
        F.col("key").alias("next"),
        F.col("whole").alias("whole_next"),
        F.col("hashes").alias("hashes_next"),
    )
    return (
        both.join(pairs, "key")
        .join(following, "next")
        .select(
            F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            _as_text(F.col("hashes"), F.col("whole")).alias("fingerprint"),
            _as_text(F.col("hashes_edited"), F.col("whole_edited")).alias("edited_fingerprint"),
            likeness(
                F.col("hashes"), F.col("hashes_edited"), F.col("whole"), F.col("whole_edited")
            ).alias("near_edited"),
            likeness(
                F.col("hashes"), F.col("hashes_next"), F.col("whole"), F.col("whole_next")
            ).alias("near_next"),
        )
    )
