"""As-of alignment. Spark has no ASOF JOIN, so both sides are stacked and the last right-hand row is carried."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import BLOCK_ROWS, grid_index


def asof(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    *,
    keys: Sequence[str] = ("instrument",),
    pos: str = "date",
    strict: bool = False,
    seconds: int | None = None,
    block: int = BLOCK_ROWS,
    default: Column | None = None,
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row; its NULL values stay NULL.

    ``default`` replaces values only where no earlier row exists. Right rows must be unique per (keys, pos). Long
    keys are cut into time blocks; the last row of each block is carried over, so a hot key is many tasks.
    """
    keys = list(keys)
    carried = F.struct(*values)
    blank = F.lit(None)
    rights = right.select(*keys, pos, F.lit(None).alias("_left"), carried.alias("_right"), F.lit(1 if strict else 0).alias("_turn"))
    lefts = left.select(
        *keys, pos, F.struct(*left.columns).alias("_left"), blank.cast(rights.schema["_right"].dataType).alias("_right"),
        F.lit(0 if strict else 1).alias("_turn"),
    )
    rights = rights.withColumn("_left", F.lit(None).cast(lefts.schema["_left"].dataType))
    both = lefts.unionByName(rights).withColumn("_block", F.floor(grid_index(pos, seconds) / F.lit(block)))
    w = Window.partitionBy(*keys, "_block").orderBy(pos, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(*keys, "_block")
        .agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col(pos))).alias("_latest"))
        .select(*keys, "_block", F.last("_latest", ignorenulls=True).over(earlier).alias("_carry"))
    )
    seen = both.withColumn("_near", F.last("_right", ignorenulls=True).over(w)).filter(F.col("_left").isNotNull())
    out = seen.join(carry, [*keys, "_block"]).withColumn("_seen", F.coalesce("_near", "_carry"))
    pick = lambda v: F.col(f"_seen.{v}") if default is None else F.when(F.col("_seen").isNull(), default).otherwise(F.col(f"_seen.{v}"))
    return out.select("_left.*", *[pick(v).alias(v) for v in values])


def asof_month(left: DataFrame, schedule_months: DataFrame, pos: str = "date") -> DataFrame:
    """Latest schedule month at or before each date's month start as ``schedule_month`` (NULL before the first).

    Only the distinct months, at most twelve per year, go through the as-of window.
    """
    months = left.select(F.trunc(pos, "MM").alias("month")).distinct().withColumn("_k", F.lit(1))
    known = schedule_months.select("month").distinct().withColumn("schedule_month", F.col("month")).withColumn("_k", F.lit(1))
    aligned = asof(months, known, ["schedule_month"], keys=["_k"], pos="month").drop("_k")
    return left.withColumn("month", F.trunc(pos, "MM")).join(aligned, "month", "left").drop("month")
