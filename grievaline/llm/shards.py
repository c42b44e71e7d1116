"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

DataFrame functions only. Counts of rows from each partition to each shard are drawn
first, so that the exchange needs no global order and no second pass over the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grievaline.llm.common import pinned, row_hash, without

POSITION_BITS = 33  # of monotonically_increasing_id
SIGMAS = 9.0  # the tails beyond weigh less than a double can tell
BLOCK_ROWS = 1 << 12


def uniform(*keys: str) -> str:
    """SQL for a number in (0, 1) that is fixed by the keys."""
    return f"(shiftrightunsigned(xxhash64({', '.join(keys)}), 12) + 0.5D) / {float(1 << 52)!r}D"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL for how many of ``draws`` out of ``total`` are among the ``good``.

    By inversion at ``u``. The probabilities follow from one another by their ratios,
    from the low end of the support, which is cut nine deviations off the mean. The
    arguments are doubles with whole values.
    """
    ratio = "(v.g - k) * (v.d - k) / ((k + 1D) * (v.t - v.g - v.d + k + 1D))"
    mass = (
        "aggregate(b.steps, named_struct('w', 1D, 's', 1D), (acc, k) -> "
        + let("w", f"acc.w * {ratio}", "named_struct('w', w, 's', acc.s + w)")
        + ", acc -> acc.s)"
    )
    found = (
        f"aggregate(b.steps, named_struct('w', 1D, 'left', v.u * {mass} - 1D, 'k', b.low), (acc, k) -> "
        + let(
            "w",
            f"acc.w * {ratio}",
            "named_struct('w', w, 'left', acc.left - w, 'k', if(acc.left > 0, k + 1D, acc.k))",
        )
        + ", acc -> acc.k)"
    )
    ends = (
        "named_struct("
        f"'low', greatest(0D, v.d + v.g - v.t, double(floor(m.mean - {SIGMAS}D * m.dev)) - 10D), "
        f"'high', least(v.d, v.g, double(ceil(m.mean + {SIGMAS}D * m.dev)) + 10D))"
    )
    steps = (
        "named_struct('low', e.low, 'steps', if(e.high > e.low, "
        "transform(sequence(bigint(e.low), bigint(e.high) - 1), x -> double(x)), array()))"
    )
    moments = (
        "named_struct('mean', v.d * v.g / greatest(v.t, 1D), "
        "'dev', sqrt(v.d * v.g / greatest(v.t, 1D) * (1D - v.g / greatest(v.t, 1D))))"
    )
    values = f"named_struct('t', {total}, 'g', {good}, 'd', {draws}, 'u', {u})"
    return let("v", values, let("m", moments, let("e", ends, let("b", steps, found))))


def _spread(room: str, rows: str, salt: str, shards: int) -> str:
    """SQL for a row of the matrix: ``rows`` over shards with ``room`` left in each."""
    one = hypergeometric("a.total", f"element_at({room}, s)", "a.draws", uniform(salt, "s"))
    return (
        f"aggregate(sequence(1, {shards}), named_struct('draws', {rows}, "
        f"'total', aggregate({room}, 0D, (x, y) -> x + y), 'out', cast(array() as array<double>)), (a, s) -> "
        + let(
            "c",
            one,
            f"named_struct('draws', a.draws - c, 'total', a.total - element_at({room}, s), "
            "'out', concat(a.out, array(c)))",
        )
        + ", a -> a.out)"
    )


def _matrix(parts: DataFrame, group: list[str], shards: int, salt: str) -> DataFrame:
    """``parts (group..., room, list of (id, rows))`` to one drawn row per id."""
    drawn = let(
        "drawn",
        _spread("f.room", "p.rows", f"concat('{salt}:', p.id)", shards),
        "named_struct('room', zip_with(f.room, drawn, (x, y) -> x - y), "
        "'out', concat(f.out, array(named_struct('id', p.id, 'counts', drawn))))",
    )
    folded = (
        "aggregate(list, named_struct('room', room, 'out', "
        "cast(array() as array<struct<id:bigint,counts:array<double>>>)), "
        f"(f, p) -> {drawn}, f -> f.out)"
    )
    return parts.select(*group, F.explode(F.expr(folded)).alias("p")).select(*group, "p.id", "p.counts")


def communication_matrix(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``part, counts``: exact numbers of rows from each partition to each shard.

    ``parts (part, rows)``. Row sums are the partitions' rows, column sums the shards'
    sizes, which differ by at most one. The joint law is that of a uniform shuffle:
    shard sizes are dealt to groups of partitions and each group's to its partitions,
    so the two folds have about the square root of the number of partitions as steps.
    """
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count("*").alias("p")).first()
    wide = math.isqrt(max(0, total["p"] - 1)) + 1
    room = [float(total["n"] // shards + (s < total["n"] % shards)) for s in range(shards)]
    grouped = parts.select(
        "part", F.col("rows").cast("double").alias("rows"), F.expr(f"part div {wide}").alias("grp")
    )
    groups = (
        grouped.groupBy("grp")
        .agg(F.sum("rows").alias("rows"))
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct(F.col("grp").alias("id"), "rows"))).alias("list"))
        .withColumn("room", F.array(*map(F.lit, room)))
    )
    dealt = _matrix(groups, [], shards, f"{seed}:group").select(F.col("id").alias("grp"), F.col("counts").alias("room"))
    members = grouped.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct(F.col("part").alias("id"), "rows"))).alias("list")
    )
    drawn = _matrix(members.join(dealt, "grp"), ["grp"], shards, f"{seed}:part")
    return drawn.select(F.col("id").alias("part"), F.transform("counts", lambda c: c.cast("long")).alias("counts"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniform shuffle, shard sizes at most one apart.

    Each partition is permuted where it is and written once; the matrix says how many of
    its rows go to each shard, so the shard of a row follows from its place. Inside a
    shard, rows get random blocks of about ``block_rows`` and a random order in their
    block, which together permute the whole shard; slots run from 0 without a gap. No
    task holds a shard, and a repeated row or key weighs like any other row. Every row
    goes to one slot, whatever its columns hold; an empty table gives no rows. Columns
    named like the results are replaced.
    """
    docs = without(docs, "shard", "slot")
    names = [F.col(f"`{c}`") for c in docs.columns]
    local = (
        docs.select(F.struct(*names).alias("doc"), row_hash(docs, F.lit(seed), F.monotonically_increasing_id()).alias("u"))
        .sortWithinPartitions("u")
        .select("doc", F.monotonically_increasing_id().alias("at"))
    )
    rows = pinned(local).select(
        "doc",
        F.shiftrightunsigned("at", POSITION_BITS).alias("part"),
        F.col("at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("place"),
        F.xxhash64("at", F.lit(seed + 1)).alias("r1"),
        F.xxhash64("at", F.lit(seed + 2)).alias("r2"),
    )
    parts = pinned(rows.groupBy("part").agg(F.count("*").alias("rows")))
    matrix = pinned(communication_matrix(parts, shards, seed))
    # first place behind each shard's rows of the partition
    stops = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("long"), lambda a, b: a + b),
    )
    n = parts.agg(F.sum("rows")).first()[0] or 0
    blocks = F.lit(n // (block_rows * shards) + 1)
    sent = (
        rows.join(matrix.select("part", stops.alias("stops")), "part")
        .select(
            "doc",
            F.size(F.filter("stops", lambda s: s <= F.col("place"))).alias("shard"),
            F.pmod("r1", blocks).alias("block"),
            "r2",
            "part",
            "place",
        )
    )
    order = Window.partitionBy("shard", "block").orderBy("r2", "part", "place")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "block").count().select(
        "shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    placed = sent.withColumn("in_block", F.row_number().over(order) - 1).join(starts, ["shard", "block"])
    return placed.select("doc.*", "shard", (F.col("start") + F.col("in_block")).alias("slot"))
