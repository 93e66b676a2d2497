"""Dataset maintenance: verification, gap reports, extension plans, drop, rename, retrofit.

Findings and plans are DataFrames; nothing is raised unless the caller asks for it with ``require_clean``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.aggregates import field_coverage
from panelspark.operators.joins import stitch_rename
from panelspark.operators.panel import calendar, instrument_ranges, suspension_rows
from panelspark.operators.windows import gap_islands

GRACE_DAYS = 7


def synthetic_days(panel: DataFrame) -> DataFrame:
    """Ranges of days without a close, per instrument."""
    return gap_islands(panel.filter(F.col("close").isNull()).select("instrument", "date"))


def missing_spans(panel: DataFrame) -> DataFrame:
    """Gaps inside each instrument's own range as (instrument, first_day, last_day): the space between a row's day and the next one.

    A gap has rows on both sides, so it is a contiguous range as it stands and its days are never expanded.
    """
    following = F.lead("date").over(Window.partitionBy("instrument").orderBy("date"))
    gaps = panel.select("instrument", "date").withColumn("_next", following).filter(F.datediff("_next", "date") > 1)
    return gaps.select("instrument", F.date_add("date", 1).alias("first_day"), F.date_sub("_next", 1).alias("last_day"))


def missing_days(panel: DataFrame) -> DataFrame:
    """Expected days of each instrument's own range that have no row, as (instrument, date).

    Only gaps are expanded, not the whole calendar.
    """
    return missing_spans(panel).select("instrument", F.explode(F.sequence("first_day", "last_day", F.expr("INTERVAL 1 DAY"))).alias("date"))


def duplicate_days(panel: DataFrame) -> DataFrame:
    return panel.groupBy("instrument", "date").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def uncovered_days(ranges: DataFrame) -> DataFrame:
    """Calendar days inside no instrument's range, as (first_day, last_day) spans.

    Ranges are swept in start order with a running maximum of the ends: one row per instrument, no day expansion.
    """
    w = Window.orderBy("from_date", "to_date").rowsBetween(Window.unboundedPreceding, -1)
    swept = ranges.groupBy("from_date").agg(F.max("to_date").alias("to_date")).withColumn("_reach", F.max("to_date").over(w))
    return swept.filter(F.datediff("from_date", "_reach") > 1).select(
        F.date_add("_reach", 1).alias("first_day"), F.date_sub("from_date", 1).alias("last_day")
    )


def verify_panel(panel: DataFrame, fields: Sequence[str], fail_on_gap: bool = False) -> DataFrame:
    """Findings (check, instrument, field, severity, detail): duplicates, missing rows, synthetic days, coverage, gaps."""
    none = F.lit(None).cast("string")

    def findings(df: DataFrame, check: str, severity: str, detail, instrument=F.col("instrument"), field=none) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), instrument.alias("instrument"), field.alias("field"), F.lit(severity).alias("severity"),
            detail.alias("detail"),
        )

    span = lambda a, b: F.concat_ws("..", F.col(a).cast("string"), F.col(b).cast("string"))
    duplicates = duplicate_days(panel).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    holes = missing_spans(panel)
    coverage = field_coverage(panel, fields)
    out = findings(duplicates, "duplicate_day", "error", F.col("n").cast("string"))
    out = out.unionByName(findings(holes, "missing_day", "error", span("first_day", "last_day")))
    out = out.unionByName(findings(synthetic_days(panel), "synthetic_day", "note", span("first_day", "last_day")))
    described = F.when(F.col("non_null") == 0, F.lit("no coverage")).otherwise(
        F.concat(span("first_date", "last_date"), F.lit(" ("), F.col("non_null").cast("string"), F.lit("/"), F.col("rows").cast("string"), F.lit(")"))
    )
    out = out.unionByName(findings(coverage, "coverage", "note", described, field=F.col("field")))
    if fail_on_gap:
        gaps = uncovered_days(instrument_ranges(panel))
        out = out.unionByName(findings(gaps, "uncovered_day", "error", span("first_day", "last_day"), instrument=none))
    return out


def require_clean(findings: DataFrame) -> None:
    """Raise with the first few errors, if there are any."""
    errors = findings.filter(F.col("severity") == "error").limit(5).collect()
    if errors:
        raise ValueError("; ".join(f"{r['check']} {r['instrument'] or ''} {r['detail']}".strip() for r in errors))


def backfill_plan(ranges: DataFrame, listing: DataFrame, arrivals: DataFrame, to: str, grace: int = GRACE_DAYS) -> DataFrame:
    """Status per known instrument from (instrument, from_date, to_date), (instrument, status) and (instrument, date).

    Only arrivals after the known end and up to ``to`` count. Statuses: not_trading, caught_up, waiting (nothing new
    within the grace period), error_no_data, error_gap, extend.
    """
    limit = F.lit(to).cast("date")
    new = arrivals.join(ranges.select("instrument", "to_date"), "instrument").filter(
        (F.col("date") > F.col("to_date")) & (F.col("date") <= limit)
    )
    found = new.groupBy("instrument").agg(F.min("date").alias("first_new"), F.max("date").alias("last_new"))
    joined = ranges.join(listing, "instrument", "left").join(found, "instrument", "left")
    start = F.date_add("to_date", 1)
    status = (
        F.when(F.coalesce("status", F.lit("TRADING")) != "TRADING", "not_trading")
        .when(F.col("to_date") >= limit, "caught_up")
        .when(F.col("first_new").isNull() & (F.datediff(limit, "to_date") > grace), "error_no_data")
        .when(F.col("first_new").isNull(), "waiting")
        .when(F.col("first_new") > start, "error_gap")
        .otherwise("extend")
    )
    return joined.withColumn("action", status).select(
        "instrument", "action",
        F.when(F.col("action") == "extend", start).alias("fetch_from"), F.when(F.col("action") == "extend", F.col("last_new")).alias("fetch_to"),
    )


def extend_plan(ranges: DataFrame, requested: DataFrame, arrivals: DataFrame, from_: str, to: str, grace: int = GRACE_DAYS) -> DataFrame:
    """Status per requested or known instrument when a download of [from_, to] is asked for.

    Adds to ``backfill_plan``: new instruments (is_new), error_absent for known ones not requested, error_truncation when
    ``to`` is before the known calendar end, and error_left_gap when ``from_`` leaves a hole after it.
    """
    lo, hi = F.lit(from_).cast("date"), F.lit(to).cast("date")
    end = ranges.agg(F.max("to_date")).scalar()
    every = requested.select("instrument").distinct().withColumn("_req", F.lit(True)).join(ranges, "instrument", "full")
    known = F.col("to_date").isNotNull()
    start = F.when(known, F.date_add(end, 1)).otherwise(lo)
    placed = every.withColumn("_start", start)
    found = arrivals.join(placed.select("instrument", "_start"), "instrument").filter(
        (F.col("date") >= F.col("_start")) & (F.col("date") <= hi)
    ).groupBy("instrument").agg(F.min("date").alias("first_new"), F.max("date").alias("last_new"))
    action = (
        F.when(F.col("_req").isNull(), "error_absent")
        .when(hi < end, "error_truncation")
        .when(known & (lo > F.date_add(end, 1)), "error_left_gap")
        .when(F.col("first_new").isNull() & ~known, "error_no_data")
        .when(F.col("first_new").isNull() & (F.datediff(hi, end) > grace), "error_no_data")
        .when(F.col("first_new").isNull(), "waiting")
        .when(known & (F.col("first_new") > F.col("_start")), "error_gap")
        .otherwise("fetch")
    )
    out = placed.join(found, "instrument", "left").withColumn("action", action)
    return out.select(
        "instrument", (~known).alias("is_new"), "action",
        F.when(F.col("action") == "fetch", F.col("first_new")).alias("fetch_from"),
        F.when(F.col("action") == "fetch", F.col("last_new")).alias("fetch_to"),
    )


def append_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both panels; a day present in both is an error raised when the plan runs."""
    both = old.unionByName(new, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("instrument", "date")]
    merged = both.groupBy("instrument", "date").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*names)).alias("_r"))
    checked = F.when(
        F.col("_n") > 1, F.raise_error(F.concat(F.lit("day present twice: "), "instrument", F.lit(" "), F.col("date").cast("string"))).cast("boolean")
    ).otherwise(F.lit(True))
    return merged.filter(checked).select("instrument", "date", "_r.*")


def drop_problem(ranges: DataFrame, symbol: str) -> DataFrame:
    """One row (problem) when the instrument cannot be dropped; empty when it can."""
    left = ranges.filter(F.col("instrument") != symbol)
    counts = ranges.agg(
        F.count_if(F.col("instrument") == symbol).alias("hit"), F.count_if(F.col("instrument") != symbol).alias("rest")
    ).select(F.when(F.col("hit") == 0, "unknown instrument").when(F.col("rest") == 0, "last instrument").alias("problem"))
    holes = uncovered_days(left).select(F.concat(F.lit("uncovered from "), F.col("first_day").cast("string")).alias("problem"))
    return counts.unionByName(holes).filter(F.col("problem").isNotNull())


def drop_instrument(panel: DataFrame, symbol: str) -> DataFrame:
    """The panel without the instrument; refused (error) when unknown, the last one, or leaving a day uncovered."""
    problem = drop_problem(instrument_ranges(panel), symbol).limit(1).collect()
    if problem:
        raise ValueError(f"cannot drop {symbol}: {problem[0]['problem']}")
    return panel.filter(F.col("instrument") != symbol)


def rename_instrument(panel: DataFrame, old: str, new: str, new_first_day: str | None = None) -> DataFrame:
    """Join the history of ``old`` to ``new``.

    If ``new`` already has rows both histories are stitched; otherwise ``old`` is relabelled and filled with suspension
    rows up to the day before ``new_first_day``.
    """
    if new_first_day is None:
        return stitch_rename(panel, old, new)
    fields = [c for c in panel.columns if c not in ("instrument", "date")]
    moved = panel.withColumn("instrument", F.when(F.col("instrument") == old, F.lit(new)).otherwise(F.col("instrument")))
    tail = instrument_ranges(panel.filter(F.col("instrument") == old)).select(
        F.lit(new).alias("instrument"), F.date_add("to_date", 1).alias("from_date"),
        F.date_sub(F.lit(new_first_day).cast("date"), 1).alias("to_date"),
    )
    return moved.unionByName(suspension_rows(tail, fields))


def available_range(manifest: DataFrame, lo: str, hi: str) -> DataFrame:
    """First and last archive day per symbol inside [lo, hi] from (symbol, date) manifest rows."""
    return manifest.filter(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).groupBy("symbol").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


def capped_history(panel: DataFrame, symbol: str, cap: str, new: str) -> DataFrame:
    """A reused symbol's rows up to the cap date under their own name; later rows keep the symbol."""
    early = (F.col("instrument") == symbol) & (F.col("date") <= F.lit(cap).cast("date"))
    return panel.withColumn("instrument", F.when(early, F.lit(new)).otherwise(F.col("instrument")))


def retrofit_field(panel: DataFrame, series: DataFrame, field: str) -> DataFrame:
    """Fill a field only for instruments that lack full coverage; running it again changes nothing."""
    if field not in panel.columns:
        panel = panel.withColumn(field, F.lit(None).cast("double"))
    needs = panel.groupBy("instrument").agg((F.count(field) < F.count(F.lit(1))).alias("_needs"))
    incoming = series.select("instrument", "date", F.col(field).alias("_new"))
    joined = panel.join(needs, "instrument").join(incoming, ["instrument", "date"], "left")
    return joined.withColumn(field, F.when(F.col("_needs"), F.coalesce(field, "_new")).otherwise(F.col(field))).drop("_needs", "_new")
