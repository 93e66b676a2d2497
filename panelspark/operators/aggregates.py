"""Daily and per-trade aggregates. All of them combine on the map side, so hot symbols cost no more than cold ones."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import ratio
from panelspark.layout import group_quantiles
from panelspark.operators.panel import order_key

TAKER_PREMIUM = 0.0002
PROBE_FRACTION = 0.005


def daily_funding(settlements: DataFrame, symbol: str = "perp_symbol") -> DataFrame:
    """Sum of settlement rates per UTC date, whatever the cadence."""
    return settlements.groupBy(symbol, F.to_date("ts").alias("date")).agg(F.sum("rate").alias("funding"))


def last_of_day(metrics: DataFrame, fields: Sequence[str], symbol: str = "symbol", tie: str | None = None) -> DataFrame:
    """Fields of the latest row per (symbol, day). Without ``tie`` (times are unique) the aggregate hashes, not sorts."""
    order = F.struct("create_time", tie) if tie else F.col("create_time")
    return metrics.groupBy(symbol, F.to_date("create_time").alias("date")).agg(*[F.max_by(f, order).alias(f) for f in fields])


def mapped_fields(cells: DataFrame, source: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields of the perp each (instrument, date) maps to; dates mapped elsewhere cannot bleed in."""
    return cells.join(source.select("perp_symbol", "date", *fields), ["perp_symbol", "date"], "left").select(
        "instrument", "date", *fields
    )


def trade_summary(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("side") == "buy").alias("buys"),
        F.count_if(F.col("side") == "sell").alias("sells"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("turnover"),
    )


def trades_per_symbol(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))


def cross_sectional_median(panel: DataFrame, field: str, out: str = "median") -> DataFrame:
    return group_quantiles(panel, ["date"], field, {out: 0.5})


def field_coverage(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(instrument, field): first and last non-NULL date, non-NULL rows, rows. One aggregate, unpivoted afterwards."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in fields:
        there = F.when(F.col(f).isNotNull(), F.col("date"))
        aggs += [F.min(there).alias(f"_{f}_a"), F.max(there).alias(f"_{f}_b"), F.count(f).alias(f"_{f}_n")]
    wide = panel.groupBy("instrument").agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f"_{f}_a").alias("first_date"), F.col(f"_{f}_b").alias("last_date"),
                F.col(f"_{f}_n").alias("non_null"),
            )
            for f in fields
        ]
    )
    return wide.select("instrument", "rows", F.explode(entries).alias("_e")).select("instrument", "_e.*", "rows")


def estimate_fill(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maker share of volume and the taker-over-maker price spread per bar."""
    maker = F.col("is_buyer_maker")
    out = ticks.groupBy(*keys).agg(
        F.sum("quantity").alias("_qty"),
        F.sum(F.when(maker, F.col("quantity")).otherwise(0.0)).alias("_maker_qty"),
        F.avg(F.when(maker, F.col("price"))).alias("_maker_px"),
        F.avg(F.when(~maker, F.col("price"))).alias("_taker_px"),
        F.avg("price").alias("_mid"),
    )
    spread = F.greatest(ratio(F.col("_taker_px") - F.col("_maker_px"), "_mid"), F.lit(0.0))
    return out.select(
        *keys, F.coalesce(ratio("_maker_qty", "_qty"), F.lit(0.0)).alias("fill_rate"), F.coalesce(spread, F.lit(0.0)).alias("spread")
    )


def book_walk_impact(
    ticks: DataFrame, keys: Sequence[str], order: Sequence[str], fraction: float = PROBE_FRACTION, bucket: Column | None = None
) -> DataFrame:
    """Impact coefficient per bar: walk trades from the open until ``fraction`` of the bar's value is consumed.

    A walk of two levels. One aggregate sums value and quantity per (bar, ``bucket``); running sums over the buckets find the one in
    which the target is reached, and only its trades are put in order, the last one partially taken. ``bucket`` must not fall along
    ``order``; by default it is the second of a time stamp, so a day has at most 86,400 of them however many trades it has. Other
    orders need one of their own; without it a bar is one bucket. Trades without price or quantity have no value.
    """
    keys = list(keys)
    if bucket is None:
        bucket = F.unix_seconds(order[0]) if ticks.schema[order[0]].dataType.typeName() == "timestamp" else F.lit(0).cast("long")
    value = F.col("price") * F.col("quantity")
    marked = ticks.select(*keys, *order, "price", value.alias("_v"), bucket.alias("_bucket"))
    buckets = marked.groupBy(*keys, "_bucket").agg(
        F.sum("_v").alias("_v"), F.sum(ratio("_v", "price")).alias("_q"), F.min_by("price", order_key(order)).alias("_p")
    )
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumns({
        "_before": F.coalesce(F.sum("_v").over(along), F.lit(0.0)), "_target": F.sum("_v").over(Window.partitionBy(*keys)) * F.lit(fraction)
    })
    upto = F.col("_before") + F.coalesce("_v", F.lit(0.0))
    reached = (F.col("_before") < F.col("_target")) & (upto >= F.col("_target"))
    whole = upto < F.col("_target")
    bars = placed.groupBy(*keys).agg(
        F.sum(F.when(whole, F.col("_v"))).alias("_whole_v"), F.sum(F.when(whole, F.col("_q"))).alias("_whole_q"), F.min_by("_p", "_bucket").alias("_first"),
        F.max("_target").alias("_target"), F.max(F.when(reached, F.col("_bucket"))).alias("_bucket"), F.max(F.when(reached, F.col("_before"))).alias("_before"),
    )
    last = marked.join(bars.select(*keys, "_bucket", "_before", "_target"), [*keys, "_bucket"]).filter(F.col("_v").isNotNull())
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_target") - F.col("_before") - F.coalesce(F.sum("_v").over(inside), F.lit(0.0))
    taken = last.select(*keys, "price", F.least("_v", left).alias("_taken")).filter(F.col("_taken") > 0)
    tail = taken.groupBy(*keys).agg(F.sum("_taken").alias("_tail_v"), F.sum(ratio("_taken", "price")).alias("_tail_q"))
    total = lambda c: F.coalesce(f"_whole_{c}", F.lit(0.0)) + F.coalesce(f"_tail_{c}", F.lit(0.0))
    slip = ratio(F.abs(ratio(total("v"), total("q")) - F.col("_first")), "_first")
    return bars.join(tail, keys, "left").select(*keys, F.coalesce(slip / F.lit(fraction**2), F.lit(0.0)).alias("impact"))


def calibrate_costs(per_bar: DataFrame, tiers: DataFrame, premium: float = TAKER_PREMIUM) -> DataFrame:
    """Per-tier means and the overall mean of tiers from (symbol, impact, fill_rate, spread) bars.

    Bars are averaged per symbol before tiers are looked up, so only one row per symbol meets the tier table.
    """
    symbol = per_bar.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in ("impact", "fill_rate", "spread")]
    )
    tier = (
        symbol.join(tiers, "symbol", "left")
        .groupBy(F.coalesce("tier", F.lit("mid")).alias("tier"))
        .agg(*[(F.sum(f"_{c}") / F.sum("_n")).alias(c) for c in ("impact", "fill_rate", "spread")])
        .withColumn("haircut", (1 - F.col("fill_rate")) * (F.col("spread") / 2 + F.lit(premium)))
    )
    overall = tier.agg(
        F.lit("overall").alias("tier"), F.avg("impact").alias("impact"), F.lit(None).cast("double").alias("fill_rate"),
        F.lit(None).cast("double").alias("spread"), F.avg("haircut").alias("haircut"),
    )
    return tier.unionByName(overall)


def seed_summary(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per metric mean, sample deviation (0 for one run), min, max and n; non-finite values count as 0."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    tall = runs.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    v = F.coalesce(F.when(F.abs("v") < float("inf"), F.col("v")), F.lit(0.0))
    return tall.withColumn("v", v).groupBy(*keys, "metric").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n"),
    )


def separation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gap of two seed summaries per metric in units of their pooled deviation."""
    x = a.select("metric", F.col("mean").alias("_ma"), F.col("std").alias("_sa"))
    y = b.select("metric", F.col("mean").alias("_mb"), F.col("std").alias("_sb"))
    gap = F.col("_ma") - F.col("_mb")
    pooled = F.sqrt((F.col("_sa") ** 2 + F.col("_sb") ** 2) / 2)
    z = F.when(pooled > 0, gap / F.nullif(pooled, F.lit(0.0))).when(gap != 0, F.lit(float("inf"))).otherwise(0.0)
    return x.join(y, "metric").select("metric", gap.alias("mean_gap"), pooled.alias("pooled_std"), z.alias("z"))


def seed_mean_series(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*keys, "date").agg(F.avg("ret").alias("ret"))


def stress_aggregate(windows: DataFrame) -> DataFrame:
    """Across-window summary of (ls_sharpe_mean, delta_sharpe)."""
    return windows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("ls_sharpe_mean") > 0).alias("windows_positive"),
        F.min("ls_sharpe_mean").alias("ls_sharpe_worst"),
        F.avg("ls_sharpe_mean").alias("ls_sharpe_mean"),
        F.avg("delta_sharpe").alias("delta_mean"),
    )


def path_histogram(paths: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return paths.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
