"""Point-in-time join: the newest right row at or before the time of each left row.

Both sides meet in one union that is passed once in time order, so no pair is made and
nothing is joined on a range. A group with very many rows of both sides together is cut
into slabs at quantiles of the time; of a slab only its newest right row is carried to
the slabs behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grievaline.operators.numbering import FLOOR, in_slabs


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    tie: str,
    values: list[str],
    floor: int = FLOOR,
) -> DataFrame:
    """``left`` with ``values`` of the newest ``right`` row of its key at or before its time.

    Of right rows with one time that with the greatest ``tie`` counts. A left row without
    an earlier right row, or with a null key or time, keeps its place with null values;
    right rows with a null key or time match nothing. Left columns named like ``values``
    give way to them.
    """
    kept = [c for c in left.columns if c not in values]
    taken = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    asked = left.select(
        F.col(key).alias("k"),
        F.unix_micros(F.col(left_time).cast("timestamp")).alias("at"),
        F.struct(*kept).alias("row"),
    )
    shown = right.select(
        F.col(key).alias("k"),
        F.unix_micros(F.col(right_time).cast("timestamp")).alias("at"),
        F.col(tie).alias("tie"),
        taken.alias("value"),
    ).where("k IS NOT NULL AND at IS NOT NULL")
    # A right row comes before the left rows of its time.
    both = asked.where("k IS NOT NULL AND at IS NOT NULL").withColumn("asks", F.lit(True)).unionByName(
        shown.withColumn("asks", F.lit(False)), allowMissingColumns=True
    )
    cut, any_hot = in_slabs(both, ["k"], "at", floor)
    order = [F.col("at"), F.col("asks"), F.asc_nulls_first("tie")]
    past = W.partitionBy("k", "_slab").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = cut.withColumn("seen", F.last("value", ignorenulls=True).over(past)).where("asks")
    if any_hot:
        newest = (
            cut.where("_slab > 0 AND NOT asks")
            .groupBy("k", "_slab")
            .agg(F.max_by("value", F.struct("at", F.col("tie").isNotNull().alias("given"), "tie")).alias("newest"))
        )
        # a slab may hold left rows only, so slabs without a right row are listed too
        slabs = cut.where("_slab > 0").select("k", "_slab").distinct().join(newest, ["k", "_slab"], "left")
        before = W.partitionBy("k").orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
        carried = slabs.select("k", "_slab", F.last("newest", ignorenulls=True).over(before).alias("carried"))
        # fewer than SHARE hot keys, each with at most MAX_CUTS slabs
        found = found.join(F.broadcast(carried), ["k", "_slab"], "left").withColumn(
            "seen", F.coalesce("seen", "carried")
        )
    nothing = asked.where("k IS NULL OR at IS NULL").withColumn(
        "seen", F.lit(None).cast(shown.schema["value"].dataType)
    )
    rows = found.select("row", "seen").union(nothing.select("row", "seen"))
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        *[F.col("seen").getField(f"v{i}").alias(v) for i, v in enumerate(values)],
    )
