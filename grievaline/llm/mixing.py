"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grievaline.llm.common import pinned, without

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
POSITION_BITS = 33  # of monotonically_increasing_id
# A run of characters other than ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources (source, words)`` with ``target``, the words to take of each source.

    Sources by code point, null last, have the weights in turn. ``share`` of all words
    is divided by weight; a source stops at ``cap`` times its words and what it leaves
    goes to the others by weight until none is above. That fixpoint has one level: the
    sources that need the most per weight are full, counted in that order. A source
    without words has target 0. One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(int(w)) for w in weights])
    weighted = sources.select(
        "source",
        "words",
        F.element_at(ring, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
    )
    # full first: least words per weight
    filling = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = weighted.select(
        "source",
        "words",
        "weight",
        (F.sum("words").over(whole) * F.lit(share) - F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(cap)).alias("rest"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    ).withColumn("level", F.when(F.col("rest") / F.col("open") * F.col("weight") <= F.col("words") * F.lit(cap), F.col("rest") / F.col("open")))
    # the first source that is not filled sets the level; all behind it have the same one
    first = F.first("level", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.select(
        "source",
        "words",
        F.coalesce(F.least(first * F.col("weight"), F.col("words") * F.lit(cap)), F.col("words") * F.lit(cap)).alias("target"),
    )


def offset(source, seed: int):
    """The random offset of a source, in [0, 1): 32 bits of an MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, size: str = "size", seed: int = 1, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` with ``source_size, target, copies``: how often the mix takes each row.

    ``docs`` has ``doc_id, source`` and a long column of sizes. Every row of a source is
    expected ``target / source_size`` times. Along the source, ordered by size and id,
    the expected copies are summed, one random offset is added, and a row is taken once
    per whole number its step crosses; so it is taken the expected number of times
    rounded down or up, never more than ``cap``, and the ordering by size keeps the
    words taken near the target. The rank of a row comes from its place in a range
    partition and the rows of its source in partitions before, so that no source is one
    task. Rows that agree in all of source, size and id may trade places. Null sources
    are one source, null ids come first, an empty table gives no rows. Columns named
    like the results are replaced.
    """
    docs = without(docs, "source_size", "target", "copies")
    names = [F.col(f"`{c}`") for c in docs.columns]
    ordered = (
        docs.select(F.struct(*names).alias("doc"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), F.col(size).alias("size"), "doc_id")
        .repartitionByRange("no_source", "name", "size", "doc_id")
        .sortWithinPartitions("no_source", "name", "size", "doc_id")
        .withColumn("at", F.monotonically_increasing_id())
        .select("doc", "no_source", "name", "size", F.shiftrightunsigned("at", POSITION_BITS).alias("part"), F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("place"))
    )
    rows = pinned(ordered)
    pieces = pinned(
        rows.groupBy("no_source", "name", "part").agg(
            F.min("place").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words")
        )
    )
    running = Window.partitionBy("no_source", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = pieces.select("no_source", "name", "part", "first", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    source = F.when(~F.col("no_source"), F.col("name"))
    sums = pieces.groupBy("no_source", "name").agg(F.sum("words").alias("words")).select(source.alias("source"), "words")
    plan = targets(sums, weights, share, cap).select(
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.col("words").alias("source_size"),
        "target",
        offset(F.col("source"), seed).alias("offset"),
    )
    steps = ranks.join(plan, ["no_source", "name"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("place") - F.col("first")
    copies = F.floor((rank + 1) * rate + F.col("offset")) - F.floor(rank * rate + F.col("offset"))
    return rows.join(steps, ["no_source", "name", "part"]).select(
        "doc.*", "source_size", "target", copies.cast("int").alias("copies")
    )


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    names = docs.columns
    boxed = docs.select(
        "doc_id",
        "source",
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"),
        word_count("text").alias("size"),
    )
    taken = mix(boxed, seed=seed).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(names)]
    )
