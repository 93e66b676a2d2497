"""Weights, gates, tilts, overlays, costs and portfolio returns as panel operators.

Cross-sections are handled with joined-back aggregates, so a date with many names is never one task. Returns assume a
daily rebalance to target without cash, lots or drift; they are not an account simulation.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import ratio
from panelspark.layout import group_stats, settle, trailing
from panelspark.operators.aggregates import cross_sectional_median
from panelspark.operators.asof import asof, asof_month
from panelspark.operators.joins import leg_entries
from panelspark.operators.ranking import liquidity_schedule, top_bottom_k, top_per_group
from panelspark.operators.windows import (
    forward_return, momentum, oi_divergence, pct_above_sma, ref, roll_mean, roll_std, zscore,
)

# Fixed values: (open, close) fee fractions per preset, calibrated impact coefficient and per-side haircut.
FEE_PRESETS = {"vip2_bnb": (0.0006, 0.0006), "vip2_std": (0.0008, 0.0008), "zero": (0.0, 0.0)}
IMPACT_COST = 85.14243442280177
MAKER_FILL_HAIRCUT = 0.00021654821992135172


def inverse_vol_weights(df: DataFrame, vol: str = "vol", keys: Sequence[str] = ("date",), out: str = "weight") -> DataFrame:
    """Weights in proportion to 1/vol over usable vols; unusable names 0; equal weights where none is usable."""
    inv = F.when(F.col(vol) > 0, ratio(F.lit(1.0), vol))
    stats = group_stats(df.withColumn("_inv", inv), keys, F.sum("_inv").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    w = F.when(F.col("_sum").isNull(), 1.0 / F.col("_n")).otherwise(F.coalesce(F.col("_inv") / F.col("_sum"), F.lit(0.0)))
    return stats.withColumn(out, w).drop("_inv", "_sum", "_n")


class Tilt(NamedTuple):
    """Multiply weights by exp(sign * k * z) of ``signal``; rows where ``active`` is not true switch the date off."""

    signal: str
    k: float | Column
    sign: int
    active: Column | None = None


def tilt_chain(df: DataFrame, tilts: Sequence[Tilt], *, keys: Sequence[str] = ("date",), weight: str = "weight") -> DataFrame:
    """Apply tilts in order, renormalising after each.

    z-scores use the population deviation over the names present; a NULL signal is neutral; below two signals, or at
    zero deviation, a tilt does nothing. Tilts never remove names, so the moments of all signals come from one
    aggregate, and as renormalising only rescales a date, one final total replaces the totals in between.
    """
    if not tilts:
        return df
    aggs = []
    for n, t in enumerate(tilts):
        aggs += [F.count(t.signal).alias(f"_n{n}"), F.avg(t.signal).alias(f"_m{n}"), F.stddev_pop(t.signal).alias(f"_s{n}")]
    both = group_stats(df, keys, *aggs)
    raised, any_use = F.col(weight), F.lit(False)
    for n, t in enumerate(tilts):
        use = (F.col(f"_n{n}") >= 2) & (F.col(f"_s{n}") > 0)
        if t.active is not None:
            use = use & t.active
        use = F.coalesce(use, F.lit(False))
        k = t.k if isinstance(t.k, Column) else F.lit(float(t.k))
        factor = F.coalesce(F.exp(t.sign * k * ratio(F.col(t.signal) - F.col(f"_m{n}"), f"_s{n}")), F.lit(1.0))
        raised, any_use = F.when(use, raised * factor).otherwise(raised), any_use | use
    moved = both.withColumns({"_w": raised, "_use": any_use}).drop(*[f"_{x}{n}" for n in range(len(tilts)) for x in "nms"])
    total = group_stats(moved, keys, F.sum("_w").alias("_t"))
    return total.withColumn(
        weight, F.when(F.col("_use") & (F.col("_t") > 0), F.col("_w") / F.col("_t")).otherwise(F.col("_w"))
    ).drop("_use", "_w", "_t")


def tilt(df: DataFrame, signal: str, k: float | Column, sign: int, *, keys: Sequence[str] = ("date",), active: Column | None = None) -> DataFrame:
    return tilt_chain(df, [Tilt(signal, k, sign, active)], keys=keys)


def trend_filter(panel: DataFrame, n: int) -> DataFrame:
    """Keep names closing above their own n-day mean; dates with fewer than n calendar rows keep every name."""
    first = panel.agg(F.min("date")).scalar()
    body = lambda df, w: df.withColumn("_sma", roll_mean("close", n, w))
    marked = trailing(panel, n, body)
    young = F.datediff(F.col("date"), first) + 1 < n
    return marked.filter(young | F.coalesce(F.col("close") > F.col("_sma"), F.lit(False))).drop("_sma")


def membership_filter(panel: DataFrame, universe: DataFrame, top_n: int, lookback: int, strict: bool = False) -> DataFrame:
    """Keep the month's liquidity members; dates before the first schedule month are unrestricted."""
    schedule = liquidity_schedule(universe, top_n, lookback, strict=strict)
    dated = asof_month(panel, schedule.select("month"))
    members = schedule.select(F.col("month").alias("schedule_month"), "instrument", F.lit(True).alias("_in"))
    return (
        dated.join(members, ["schedule_month", "instrument"], "left")
        .filter(F.col("schedule_month").isNull() | F.col("_in"))
        .drop("_in", "schedule_month")
    )


def froth_signal(panel: DataFrame, field: str, lookback: int) -> DataFrame:
    """Trailing z-score of the cross-sectional median, one row per date."""
    median = panel.select("date").distinct().join(cross_sectional_median(panel, field), "date", "left")
    one = median.withColumn("instrument", F.lit("all"))
    return trailing(one, lookback, lambda df, w: df.withColumn("z", zscore("median", lookback, w))).select("date", "z")


def carried(rows: DataFrame, series: DataFrame, value: str, *, strict: bool = False, default: Column | None = None) -> DataFrame:
    """(date, value): the series' latest row at or before (``strict``: before) each date of ``rows``; a NULL in it stays NULL."""
    days = rows.select("date").distinct().withColumn("_k", F.lit(1))
    return asof(days, series.select("date", value).withColumn("_k", F.lit(1)), [value], keys=["_k"], strict=strict, default=default).drop("_k")


def derisk(exposure: DataFrame, signal: DataFrame, threshold: float, factor: float, *, strict: bool) -> DataFrame:
    """Scale exposure where the as-of z exceeds the threshold; a NULL z and a date before the first signal do nothing."""
    at = carried(exposure, signal.withColumnRenamed("z", "_z"), "_z", strict=strict)
    return exposure.join(at, "date", "left").withColumn(
        "exposure", F.when(F.col("_z") > threshold, F.col("exposure") * factor).otherwise(F.col("exposure"))
    ).drop("_z")


def strategy_signals(
    panel: DataFrame, *, vol_lookback: int = 30, momentum_lookback: int = 30, oi_lookback: int = 14, directional: bool = False
) -> DataFrame:
    """Strictly prior volatility and tilt signals of a dense panel: every value at date t is that of t - 1."""
    def body(df, w):
        df = df.withColumn("_ret", momentum("close", 1, w))
        df = df.withColumns(
            {
                "_vol": roll_std("_ret", vol_lookback, w),
                "_mom": momentum("close", momentum_lookback, w),
                "_oid": oi_divergence("close", "oi", oi_lookback, w, directional),
                "_smart": ratio("ls_top", "ls_global"),
            }
        )
        return df.withColumns(
            {
                "vol": ref("_vol", 1, w), "crowding": ref("basis", 1, w), "oi_div": ref("_oid", 1, w),
                "smart": ref("_smart", 1, w), "mom": ref("_mom", 1, w),
            }
        ).drop("_ret", "_vol", "_mom", "_oid", "_smart")

    return trailing(panel, max(vol_lookback, momentum_lookback, oi_lookback) + 3, body)


def strong_trend(panel: DataFrame, benchmark: str, n: int) -> DataFrame:
    """Benchmark close over its n-day mean, dated one day later (strictly prior use)."""
    bench = panel.filter(F.col("instrument") == benchmark)
    body = lambda df, w: df.withColumn("_above", pct_above_sma("close", n, w))
    return trailing(bench, n, body).select(F.date_add("date", 1).alias("date"), F.col("_above").alias("trend"))


def target_weights(
    signals: DataFrame, *, crowding_k: float | None = None, oi_k: float | None = None, smart_k: float | None = None,
    momentum_k: float | None = None, oi_active: Column | None = None, keys: Sequence[str] = ("date",),
) -> DataFrame:
    """Inverse-vol weights of the names left by the filters, then crowding, OI, smart-money and momentum tilts.

    The filtered signals are written once, because every cross-sectional step reads them again.
    """
    w = inverse_vol_weights(settle(signals, "signals"), "vol", keys)
    chain = [
        Tilt("crowding", crowding_k, -1), Tilt("oi_div", oi_k, +1, oi_active), Tilt("smart", smart_k, +1), Tilt("mom", momentum_k, +1),
    ]
    return tilt_chain(w, [t for t in chain if t.k is not None], keys=keys).filter(F.col("weight") > 0)


def apply_exposure(weights: DataFrame, exposure: DataFrame, base: float = 0.95, gate: bool = True, gate_lag: int = 0) -> DataFrame:
    """Weight times base times the market exposure as of the date (``gate_lag`` days earlier).

    A date without an exposure of its own has the latest one; before the first, and where it is NULL, exposure is 1.
    """
    if not gate:
        return weights.withColumn("target", F.col("weight") * base)
    shifted = exposure.select(F.date_add("date", gate_lag).alias("date"), F.col("exposure").alias("_e"))
    return weights.join(carried(weights, shifted, "_e"), "date", "left").withColumn(
        "target", F.col("weight") * base * F.coalesce("_e", F.lit(1.0))
    ).drop("_e")


def cost_model(
    trades: DataFrame, *, fee_preset: str = "vip2_bnb", haircut: float = MAKER_FILL_HAIRCUT, impact: float = IMPACT_COST,
    fees_only: bool = False, bar_value: str = "amount",
) -> DataFrame:
    """Cost per trade row (side, value, bar value): fee plus haircut per side and impact * (order / bar)^2."""
    buy, sell = FEE_PRESETS[fee_preset]
    fee = F.when(F.col("side") == "buy", F.lit(buy)).otherwise(F.lit(sell))
    rate = fee if fees_only else fee + F.lit(haircut) + F.lit(impact) * F.coalesce(
        ratio("value", bar_value) * ratio("value", bar_value), F.lit(0.0)
    )
    return trades.withColumn("cost_rate", rate).withColumn("cost", rate * F.col("value"))


def weight_changes(weights: DataFrame, calendar: DataFrame, keys: Sequence[str] = (), weight: str = "weight") -> DataFrame:
    """|w_t - w_{t-1}| per name through one full outer equi-join with the next calendar row; no dense grid needed."""
    w = Window.partitionBy(*keys).orderBy("date")
    steps = calendar.select(*keys, "date").distinct().withColumn("_next", F.lead("date").over(w))
    before = weights.join(steps, [*keys, "date"]).filter(F.col("_next").isNotNull()).select(
        *keys, F.col("_next").alias("date"), "instrument", F.col(weight).alias("_was")
    )
    now = weights.select(*keys, "date", "instrument", F.col(weight).alias("_now"))
    return now.join(before, [*keys, "date", "instrument"], "full").select(
        *keys, "date", "instrument", F.abs(F.coalesce("_now", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))).alias("traded")
    )


def portfolio_returns(
    weights: DataFrame, fwd: DataFrame, calendar: DataFrame, cost_rate: float = 0.0, keys: Sequence[str] = (),
    weight: str = "weight",
) -> DataFrame:
    """Daily (gross, turnover, cost, ret) of target weights against next-day returns (instrument, date, fwd)."""
    by = [*keys, "date"]
    gross = weights.join(fwd.select("instrument", "date", "fwd"), ["instrument", "date"], "left").groupBy(*by).agg(
        F.sum(F.col(weight) * F.coalesce("fwd", F.lit(0.0))).alias("gross")
    )
    turnover = weight_changes(weights, calendar, keys, weight).groupBy(*by).agg(F.sum("traded").alias("turnover"))
    daily = calendar.select(*by).distinct().join(gross, by, "left").join(turnover, by, "left")
    return daily.select(
        *by, F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover")
    ).withColumn("cost", F.col("turnover") * cost_rate).withColumn("ret", F.col("gross") - F.col("cost"))


def long_short_spread(scored: DataFrame, k: int, cost: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Daily dollar-neutral spread of (date, instrument, score, fwd) rows, net of entry costs per leg."""
    by = [*keys, "date"]
    usable = settle(scored.filter(F.col("score").isNotNull() & F.col("fwd").isNotNull()), "scored")
    legs = top_bottom_k(usable, k, keys)
    dates = usable.select(*by).distinct()
    entries = leg_entries(legs, dates, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("entries"))
    sides = legs.groupBy(*by).agg(
        F.avg(F.when(F.col("leg") == "long", F.col("fwd"))).alias("_long"),
        F.avg(F.when(F.col("leg") == "short", F.col("fwd"))).alias("_short"),
        F.max("k").alias("k"),
    )
    spread = F.col("_long") - F.col("_short") - cost * F.coalesce("entries", F.lit(0)) / F.col("k")
    return dates.join(sides, by, "left").join(entries, by, "left").select(
        *by, F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce(spread, F.lit(0.0)).alias("ret"),
    )


def topk_members(scored: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal weights on the k best scores per date."""
    by = [*keys, "date"]
    best = top_per_group(scored.filter(F.col("score").isNotNull()), by, [F.desc("score"), "instrument"], k)
    return group_stats(best, by, F.count(F.lit(1)).alias("_n")).withColumn("weight", 1.0 / F.col("_n")).drop("_n")
