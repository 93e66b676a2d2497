"""The given tables in the shapes of market data.

``bars``    daily bars of the line numbers as instruments, all 18 panel fields, from lineitem (sparse)
``names``   daily bars of the suppliers as instruments, from lineitem (many instruments, sparse)
``hourly``  hourly closes of the event types, from events
``trials``  daily returns of the instruments of ``bars`` as trials
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import ratio
from panelspark.layout import trailing
from panelspark.operators.panel import bars_from_ticks, densify
from panelspark.operators.windows import forward_return, momentum

# Prices are in an irrational unit, so that no rounded result can be an exact decimal tie.
PRICE_UNIT = 314.1592653589793
TICK_ORDER = ("seq",)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC wall-clock times
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("instrument"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity") / F.lit(PRICE_UNIT)).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "N").alias("is_buyer_maker"),
        (F.col("l_orderkey") * 4096 + F.pmod("l_partkey", F.lit(4096))).alias("seq"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_tax",
    )


def exact_sum(whole: str, factor: str) -> Column:
    """Sum of ``whole`` x ``factor`` (to 12 decimals) in decimals: equal sums are equal whatever the order of the rows, so they tie.

    Where a factor is no decimal number (NaN, a million and more) the sum is that of doubles.
    """
    product = F.col(whole) * F.col(factor)
    exact = F.col(whole).cast("decimal(19,0)") * F.col(factor).try_cast("decimal(18,12)")
    return F.when(F.count(exact) == F.count(product), F.sum(exact).cast("double")).otherwise(F.round(F.sum(product), 12))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    canon = lambda c: F.round(c, 12)
    taker, maker = (F.sum(F.when(cond, F.col("quantity")).otherwise(0.0)) for cond in (~F.col("is_buyer_maker"), F.col("is_buyer_maker")))
    extra = [
        canon(F.sum(F.col("l_tax") - 0.04)).alias("funding"),
        (F.sum("l_partkey") + 1).cast("double").alias("oi"),
        exact_sum("l_partkey", "l_discount").alias("oi_value"),
        canon(F.avg("l_discount") + 0.5).alias("ls_top"),
        canon(F.avg("l_tax")).alias("ls_global"),
        canon(ratio(taker, maker)).alias("taker_ratio"),
        canon(F.avg(F.col("l_discount") - F.col("l_tax"))).alias("basis"),
    ]
    return bars_from_ticks(ticks(spark, sf), ["instrument", "date"], TICK_ORDER, extra)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return densify(bars(spark, sf))


def names(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).drop("instrument").withColumnRenamed("supplier", "instrument")
    return bars_from_ticks(t, ["instrument", "date"], TICK_ORDER)


def orders_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily panel of the order priorities: close of the last order, amount and count."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.sum("o_totalprice").alias("amount"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars (symbol, ts, OHLCV) of the event types."""
    seq = F.unix_micros("ts")
    return events(spark, sf).groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", seq).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", seq).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ).withColumnRenamed("hour", "ts")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Dense panel with the daily return ``ret`` and the next day's ``fwd``."""
    body = lambda df, w: df.withColumns({"ret": momentum("close", 1, w), "fwd": forward_return("close", w)})
    return trailing(dense(spark, sf), 1, body, ahead=1)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """(trial, date, ret) with returns scaled to daily size."""
    r = returns(spark, sf).filter(F.col("ret").isNotNull())
    return r.select(F.col("instrument").alias("trial"), "date", (F.col("ret") / 100).alias("ret"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every DOUBLE column for comparison."""
    return df.select(
        *[F.round(f.name, special.get(f.name, digits)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )
