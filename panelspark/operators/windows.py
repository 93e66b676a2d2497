"""Rolling, lagged and stateful column operators.

The Column builders take a WindowSpec ``w`` ordered by date inside one instrument (or one block of it, see
``layout.trailing``). All rolling statistics are NULL until the frame holds ``n`` non-NULL values.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.scalar import change, col, pearson, ratio, safe_ln
from panelspark.layout import CHUNK_ROWS, value_ranks

DAYS_PER_YEAR = 365.0


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(x: Column, w: WindowSpec, n: int) -> Column:
    return F.count(x).over(frame(w, n)) == n


def ref(x: str | Column, n: int, w: WindowSpec) -> Column:
    return F.lag(col(x), n).over(w) if n >= 0 else F.lead(col(x), -n).over(w)


def roll_mean(x: str | Column, n: int, w: WindowSpec) -> Column:
    x = col(x)
    return F.when(full(x, w, n), F.avg(x).over(frame(w, n)))


def roll_std(x: str | Column, n: int, w: WindowSpec) -> Column:
    x = col(x)
    return F.when(full(x, w, n), F.stddev_samp(x).over(frame(w, n)))


def roll_sum(x: str | Column, n: int, w: WindowSpec) -> Column:
    x = col(x)
    return F.when(full(x, w, n), F.sum(x).over(frame(w, n)))


def zscore(x: str | Column, n: int, w: WindowSpec) -> Column:
    return ratio(col(x) - roll_mean(x, n, w), roll_std(x, n, w))


def momentum(x: str | Column, n: int, w: WindowSpec) -> Column:
    return change(col(x), ref(x, n, w))


def log_return(x: str | Column, w: WindowSpec) -> Column:
    return safe_ln(x) - ref(safe_ln(x), 1, w)


def forward_label(x: str | Column, h: int, w: WindowSpec) -> Column:
    """Return from the next row to ``h`` rows after it, the label a model trained today may use."""
    return change(ref(x, -(h + 1), w), ref(x, -1, w))


def forward_return(x: str | Column, w: WindowSpec) -> Column:
    return change(ref(x, -1, w), col(x))


def forward_sum(x: str | Column, h: int, w: WindowSpec) -> Column:
    x = col(x)
    ahead = w.rowsBetween(1, h)
    return F.when(F.count(x).over(ahead) == h, F.sum(x).over(ahead))


def pct_above_sma(x: str | Column, n: int, w: WindowSpec) -> Column:
    return change(col(x), roll_mean(x, n, w))


def oi_divergence(close: str, oi: str, n: int, w: WindowSpec, directional: bool = False) -> Column:
    price, interest = momentum(close, n, w), momentum(oi, n, w)
    return F.when(price > 0, interest) if directional else F.signum(price) * interest


def roll_beta(ret: str, bench: str, n: int, w: WindowSpec) -> Column:
    """Pairwise covariance with the benchmark over the benchmark's own variance in the frame."""
    both = F.when(F.col(ret).isNotNull() & F.col(bench).isNotNull(), F.lit(1))
    cov = F.when(full(both, w, n), F.covar_samp(ret, bench).over(frame(w, n)))
    var = F.when(full(F.col(bench), w, n), F.var_samp(bench).over(frame(w, n)))
    return ratio(cov, var)


def roll_corr(x: str, y: str, n: int, w: WindowSpec) -> Column:
    """Pearson correlation of a full frame; NULL when either side is constant in it."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1))
    return F.when(full(both, w, n), pearson(x, y, frame(w, n)))


def cs_rank_pct(panel: DataFrame, columns: dict[str, str], by: str = "date", *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out: source`` cross-sectional ranks: average-tie rank over the count of non-NULL values of the date.

    The sources travel as one narrow table of (name, value) through the value histogram and are joined back once, so neither a
    date with very many instruments nor a value shared by most of them lands in a single task.
    """
    key = ["instrument", by]
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("_out"), col(s).cast("double").alias("_x")) for o, s in columns.items()]))
    tall = panel.select(*key, pairs.alias("_p")).select(*key, "_p._out", "_p._x").filter(F.col("_x").isNotNull())
    ranks = value_ranks(tall, [by, "_out"], "_x", chunk_rows=chunk_rows).select(
        by, "_out", "_x", ((F.col("below") + (F.col("copies") + 1) / 2) / F.col("total")).alias("_pct")
    )
    wide = (
        tall.join(ranks, [by, "_out", "_x"])
        .groupBy(*key)
        .agg(*[F.max(F.when(F.col("_out") == o, F.col("_pct"))).alias(o) for o in columns])
    )
    return panel.join(wide, key, "left")


def gap_islands(df: DataFrame, keys: Sequence[str] = ("instrument",), pos: str = "date") -> DataFrame:
    """Collapse distinct days to contiguous ranges (first_day, last_day, days).

    Repeated days are skipped and only the first and last day of a range go on, all on one sort: no table of days or ranges is held.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    before, after = F.lag(pos).over(w), F.lead(pos).over(w)
    seen = df.select(*keys, pos).withColumns({"_before": before, "_row": F.row_number().over(w)})
    days = seen.filter((F.col("_row") == 1) | ~F.col("_before").eqNullSafe(F.col(pos))).select(*keys, pos)
    apart = lambda a, b: F.coalesce(F.datediff(a, b) > 1, F.lit(True))
    edges = days.withColumns({"_starts": apart(F.col(pos), before), "_ends": apart(after, F.col(pos))}).filter("_starts or _ends")
    spans = edges.withColumn("last_day", F.when(F.col("_ends"), F.col(pos)).otherwise(after)).filter("_starts")
    length = F.coalesce(F.datediff("last_day", pos) + 1, F.lit(1)).cast("long")
    return spans.select(*keys, F.col(pos).alias("first_day"), "last_day", length.alias("days"))


def debounce(df: DataFrame, raw: str, n: int, keys: Sequence[str], out: str, pos: str = "date") -> DataFrame:
    """Hold a 0/1 state that flips only on the n-th consecutive opposite day; NULL rows are warm-up and stay NULL.

    Closed form of the state machine: the held state is the latest value whose run had reached length n, else the
    first non-NULL value. Every run of n equal values confirms its own side, so no per-row state is needed.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    # Warm-up rows do not break a run: compare with the latest non-NULL value before.
    before = F.last(raw, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn(
        "_turn", F.when(F.col(raw).isNotNull() & (before.isNull() | (before != F.col(raw))), 1).otherwise(0)
    ).withColumn("_run", F.sum("_turn").over(past))
    step = Window.partitionBy(*keys, "_run").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_pos", F.count(raw).over(step))
    confirmed = F.last(F.when(F.col("_pos") >= n, F.col(raw)), ignorenulls=True).over(past)
    seed = F.first(raw, ignorenulls=True).over(past)
    return placed.withColumn(out, F.when(F.col(raw).isNotNull(), F.coalesce(confirmed, seed))).drop("_turn", "_run", "_pos")


def regime_exposure(
    close: DataFrame,
    *,
    mode: str = "binary",
    ma_window: int = 200,
    ma_fast: int | None = None,
    band: float = 0.0,
    chop: float = 0.5,
    vol_target: float | None = None,
    vol_lookback: int = 30,
    confirm: int = 0,
    keys: Sequence[str] = ("instrument",),
) -> DataFrame:
    """Exposure in [0, 1] of a dense daily close series: gate, debounce, warm-up 1, volatility scale, clip."""
    w = Window.partitionBy(*keys).orderBy("date")
    c = F.col("close")
    df = close.select(*keys, "date", "close").withColumn("_sma", roll_mean("close", ma_window, w))
    if mode == "cross":
        if ma_fast is None:
            raise ValueError("mode 'cross' needs ma_fast")
        df = df.withColumn("_fast", roll_mean("close", ma_fast, w))
        warm = F.col("_sma").isNull() | F.col("_fast").isNull()
        gate = (F.col("_fast") > F.col("_sma")).cast("double")
    elif mode == "binary":
        warm = F.col("_sma").isNull()
        gate = (c > F.col("_sma")).cast("double")
    elif mode == "graded":
        warm = F.col("_sma").isNull()
        gate = F.when(c > F.col("_sma") * (1 + band), 1.0).when(c < F.col("_sma") * (1 - band), 0.0).otherwise(float(chop))
    else:
        raise ValueError(f"unknown regime mode {mode!r}")
    df = df.withColumn("_gate", F.when(~warm, F.coalesce(gate, F.lit(0.0))))
    if confirm > 0 and mode == "binary":
        df = debounce(df, "_gate", confirm, keys, "_gate_held").drop("_gate").withColumnRenamed("_gate_held", "_gate")
    exposure = F.coalesce("_gate", F.lit(1.0))
    if vol_target is not None:
        df = df.withColumn("_ret", momentum("close", 1, w)).withColumn("_vol", roll_std("_ret", vol_lookback, w))
        scale = F.least(F.try_divide(F.lit(vol_target), F.col("_vol") * F.sqrt(F.lit(DAYS_PER_YEAR))), F.lit(1.0))
        exposure = exposure * F.coalesce(scale, F.lit(1.0))
    return df.select(*keys, "date", F.greatest(F.least(exposure, F.lit(1.0)), F.lit(0.0)).alias("exposure"))


def equity_curve(
    df: DataFrame, ret: str = "ret", keys: Sequence[str] = (), account: float = 1.0, out: str = "equity",
    cost: str | None = None,
) -> DataFrame:
    """Compounded account value of one-row-per-date series; ``cost`` makes the curve net of a cost column."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    step = 1 + F.coalesce(F.col(ret), F.lit(0.0)) - (F.coalesce(F.col(cost), F.lit(0.0)) if cost else F.lit(0.0))
    return df.withColumn(out, F.lit(account) * F.product(step).over(w))


def drawdown(df: DataFrame, curve: str = "equity", keys: Sequence[str] = (), compounded: bool = True, out: str = "drawdown") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(curve).over(w)
    return df.withColumn(out, F.try_divide(F.col(curve), peak) - 1 if compounded else F.col(curve) - peak)


def rebase(df: DataFrame, price: str = "close", base: float = 100.0, keys: Sequence[str] = ("instrument",), out: str = "rebased") -> DataFrame:
    first = F.first(price, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return df.withColumn(out, F.try_divide(F.col(price), first) * base)
