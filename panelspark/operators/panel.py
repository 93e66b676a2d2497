"""Building and aligning the panel: bars from ticks, dense calendars, field attachment, benchmark columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import vwap

# The field names of the daily panel, in storage order.
BAR_FIELDS = (
    "open", "high", "low", "close", "volume", "amount", "trades", "taker_buy_base", "taker_buy_amount", "vwap", "factor",
)
DERIVATIVE_FIELDS = ("oi", "oi_value", "ls_top", "ls_global", "taker_ratio", "basis")
PANEL_FIELDS = (*BAR_FIELDS, "funding", *DERIVATIVE_FIELDS)
ZERO_WHEN_SUSPENDED = ("volume", "amount", "trades", "taker_buy_base", "taker_buy_amount")


def bars_from_ticks(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One bar per key from (price, quantity, is_buyer_maker) ticks; a single map-side combined aggregate.

    With one numeric order column every buffer is fixed-width and Spark hashes; several columns need a struct, which
    makes it sort the ticks, so a single tick id is the fast form.
    """
    seq = order_key(order)
    taker = ~F.col("is_buyer_maker")
    value = F.col("price") * F.col("quantity")
    bars = ticks.groupBy(*keys).agg(
        F.min_by("price", seq).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", seq).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(value).alias("amount"),
        F.count(F.lit(1)).cast("double").alias("trades"),
        F.sum(F.when(taker, F.col("quantity")).otherwise(0.0)).alias("taker_buy_base"),
        F.sum(F.when(taker, value).otherwise(0.0)).alias("taker_buy_amount"),
        *extra,
    )
    return bars.withColumn("vwap", vwap("amount", "volume", "close")).withColumn("factor", F.lit(1.0))


def order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def calendar(df: DataFrame) -> DataFrame:
    """Every day between the first and the last row of the panel."""
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))


def instrument_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("instrument").agg(
        F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.count(F.lit(1)).alias("rows")
    )


def densify(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Fill every missing day between an instrument's first and last row with NULL fields.

    Each row is stretched up to the day before its successor, so the fill needs no join and no second scan. A
    (instrument, date) panel holds at most one row per calendar day, which bounds the window of each instrument.
    """
    fields = list(fields or [c for c in df.columns if c not in ("instrument", "date")])
    following = F.lead("date").over(Window.partitionBy("instrument").orderBy("date"))
    stretched = df.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col("date"))).withColumn(
        "_day", F.explode(F.sequence("date", "_last", F.expr("INTERVAL 1 DAY")))
    )
    return stretched.select(
        "instrument",
        F.col("_day").alias("date"),
        *[F.when(F.col("_day") == F.col("date"), F.col(c)).alias(c) for c in fields],
    )


def densify_union_calendar(df: DataFrame) -> DataFrame:
    """Every instrument on every day of the whole panel (the loader for hand-made OHLCV files)."""
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = F.sequence(span.select("lo").scalar(), span.select("hi").scalar(), F.expr("INTERVAL 1 DAY"))
    grid = df.select("instrument").distinct().withColumn("date", F.explode(days))
    return grid.join(df, ["instrument", "date"], "left")


def attach_field(panel: DataFrame, series: DataFrame) -> DataFrame:
    """Left equi-join on (instrument, date); absent values stay NULL."""
    return panel.join(series, ["instrument", "date"], "left")


def with_benchmark(panel: DataFrame, symbol: str, field: str = "close", out: str = "bench") -> DataFrame:
    """Benchmark value of the same date on every row. The benchmark is one row per day; AQE broadcasts it if small."""
    bench = panel.filter(F.col("instrument") == symbol).select("date", F.col(field).alias(out))
    return panel.join(bench, "date", "left")


def suspension_value(field: str) -> Column:
    """Field value of a day without trading: volume-like 0, factor 1, everything else NULL."""
    if field in ZERO_WHEN_SUSPENDED:
        return F.lit(0.0)
    return F.lit(1.0) if field == "factor" else F.lit(None).cast("double")


def suspension_rows(spans: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(instrument, from_date, to_date) spans to one suspension row per day; empty spans give none."""
    return (
        spans.filter(F.col("from_date") <= F.col("to_date"))
        .select("instrument", F.explode(F.sequence("from_date", "to_date", F.expr("INTERVAL 1 DAY"))).alias("date"))
        .select("instrument", "date", *[suspension_value(f).alias(f) for f in fields])
    )


def fill_suspended(panel: DataFrame, observed: str = "trades") -> DataFrame:
    """Turn the empty rows of a densified panel into suspension rows."""
    fields = [c for c in panel.columns if c not in ("instrument", "date")]
    gone = F.col(observed).isNull()
    return panel.select(
        "instrument", "date", *[F.when(gone, suspension_value(f)).otherwise(F.col(f)).alias(f) for f in fields]
    )


def slice_dates(panel: DataFrame, start: str, end: str) -> DataFrame:
    return panel.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
