"""Joins and set alignment of panels, trials, windows and positions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.panel import instrument_ranges, suspension_rows


def perp_symbols(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Symbol to read derivatives from on each (instrument, date).

    ``mapping`` holds (instrument, perp, valid_from, valid_to) with open ends as NULL. Instruments without any mapping
    map to themselves; a mapped instrument outside its valid ranges has none (NULL). The mapping is joined by
    equality on instrument first, so the date range is only a residual condition.
    """
    m = mapping.withColumnRenamed("instrument", "_mapped")
    inside = (
        (F.col("instrument") == F.col("_mapped"))
        & (F.col("valid_from").isNull() | (F.col("date") >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (F.col("date") <= F.col("valid_to")))
    )
    known = mapping.select("instrument").distinct().withColumn("_known", F.lit(True))
    out = cells.join(m, inside, "left").join(known, "instrument", "left")
    perp = F.when(F.col("_known").isNull(), F.col("instrument")).otherwise(F.col("perp"))
    return out.withColumn("perp_symbol", perp).drop("_mapped", "perp", "valid_from", "valid_to", "_known")


def align_common_dates(trials: DataFrame, trial: str = "trial") -> DataFrame:
    """Keep the dates every trial has. Per-date counts are combined before the shuffle."""
    wanted = trials.agg(F.countDistinct(trial)).scalar()
    common = trials.groupBy("date").agg(F.countDistinct(trial).alias("_n")).filter(F.col("_n") == wanted)
    return trials.join(common.select("date"), "date", "left_semi")


def alignment_report(trials: DataFrame, trial: str = "trial") -> DataFrame:
    """Common span against the longest trial, flagged below 95 percent. All inputs are one-row aggregates."""
    common = align_common_dates(trials, trial).agg(
        F.countDistinct("date").alias("common_days"), F.min("date").alias("from_date"), F.max("date").alias("to_date")
    )
    longest = trials.groupBy(trial).count().agg(F.max("count")).scalar()
    return common.withColumn("longest_trial", longest).withColumn(
        "differs", F.col("common_days") < F.lit(0.95) * F.col("longest_trial")
    )


def union_trial_sharpes(in_run: DataFrame, register: DataFrame, key: str = "config_hash") -> DataFrame:
    """In-run Sharpes, then the register's whose exact value is not already there."""
    extra = register.join(in_run.select("sharpe").distinct(), "sharpe", "left_anti")
    return in_run.select(key, "sharpe").unionByName(extra.select(key, "sharpe"))


def filter_members(panel: DataFrame, members: DataFrame, on: Sequence[str] = ("instrument", "date")) -> DataFrame:
    return panel.join(members, list(on), "left_semi")


def leg_entries(legs: DataFrame, evaluated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leg members that were not in the same leg on the previous evaluated date.

    ``evaluated`` lists every evaluated date (one row each), including skipped ones, which therefore reset the legs.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    steps = evaluated.select(*keys, "date").distinct().withColumn("_prev", F.lag("date").over(w))
    held = legs.select(*keys, F.col("date").alias("_prev"), "leg", "instrument")
    return legs.join(steps, [*keys, "date"]).join(held, [*keys, "_prev", "leg", "instrument"], "left_anti").drop("_prev")


def label_windows(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Tag rows inside named inclusive date ranges (label, start, end).

    Ranges are expanded to days first, so the panel only sees an equi-join on date and never a range comparison.
    """
    return panel.join(window_days(windows, "label"), "date")


def window_days(windows: DataFrame, label: str) -> DataFrame:
    """One (label, date) row per day of each inclusive (label, start, end) range."""
    return windows.filter(F.col("start") <= F.col("end")).select(
        label, F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date")
    )


def position_diff(positions: DataFrame) -> DataFrame:
    """Buys and sells between consecutive snapshots (date, symbol, amount, price); a missing symbol counts as 0.

    Each position is looked up at the next snapshot and paired by a full outer equi-join, which needs no dense grid.
    """
    dates = positions.select("date").distinct()
    steps = dates.withColumn("_next", F.lead("date").over(Window.orderBy("date")))  # one row per snapshot date
    before = positions.join(steps, "date").filter(F.col("_next").isNotNull()).select(
        F.col("_next").alias("date"), "symbol", F.col("amount").alias("_was"), F.col("price").alias("_old_price")
    )
    both = positions.join(before, ["date", "symbol"], "full")
    delta = F.coalesce("amount", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0))
    return (
        both.withColumn("_delta", delta)
        .filter(F.abs("_delta") > 1e-12)
        .select(
            "date",
            F.when(F.col("_delta") > 0, "buy").otherwise("sell").alias("side"),
            "symbol",
            F.abs("_delta").alias("qty"),
            F.coalesce("price", "_old_price").alias("price"),
        )
        .withColumn("value", F.col("qty") * F.col("price"))
    )


def trades(positions: DataFrame) -> DataFrame:
    """(line, date, side, symbol, qty, price, value) of a holding's changes, numbered by date and symbol.

    Each date is numbered by itself and the dates' counts carry over, so no task orders all trades.
    """
    t = position_diff(positions)
    per_day = t.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    base = per_day.select("date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    line = F.row_number().over(Window.partitionBy("date").orderBy("symbol")) + F.col("_base")
    return t.join(base, "date").select(line.cast("long").alias("line"), "date", "side", "symbol", "qty", "price", "value")


def cross_params(panel: DataFrame, grid: Sequence[dict]) -> DataFrame:
    """Every row under every parameter set of a hand-written grid: an explode of literals, so no join and no shuffle."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in params.items()]) for params in grid])
    return panel.withColumn("_p", F.explode(rows)).select(*panel.columns, "_p.*")


def pair_returns(candidate: DataFrame, null: DataFrame) -> DataFrame:
    return candidate.select("date", F.col("ret").alias("cand")).join(null.select("date", F.col("ret").alias("null_ret")), "date")


def stitch_rename(panel: DataFrame, old: str, new: str) -> DataFrame:
    """Relabel ``old`` as ``new``, filling the days between the two histories with suspension rows.

    Overlapping histories are refused: the overlap becomes a row-level error raised when the plan runs.
    """
    fields = [c for c in panel.columns if c not in ("instrument", "date")]
    ranges = instrument_ranges(panel.filter(F.col("instrument").isin(old, new)))
    edge = ranges.agg(
        F.max(F.when(F.col("instrument") == old, F.col("to_date"))).alias("_old_to"),
        F.min(F.when(F.col("instrument") == new, F.col("from_date"))).alias("_new_from"),
    )
    checked = edge.withColumn(
        "_ok",
        F.when(F.col("_new_from") <= F.col("_old_to"), F.raise_error(F.lit(f"histories of {old} and {new} overlap")).cast("boolean"))
        .otherwise(F.lit(True)),
    )
    gap = checked.filter("_ok").select(
        F.lit(new).alias("instrument"), F.date_add("_old_to", 1).alias("from_date"), F.date_sub("_new_from", 1).alias("to_date")
    )
    moved = panel.withColumn("instrument", F.when(F.col("instrument") == old, F.lit(new)).otherwise(F.col("instrument")))
    return moved.unionByName(suspension_rows(gap, fields))
