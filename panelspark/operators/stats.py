"""Sharpe-based statistics as aggregates. Moments are centred first, then combined on the map side."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import expected_max_normal, norm_cdf, pearson, ratio
from panelspark.layout import group_quantiles, group_stats, with_ranks
from panelspark.operators.joins import union_trial_sharpes
from panelspark.operators.ranking import dedupe_trials
from panelspark.operators.windows import drawdown, equity_curve


def sharpe_of(mean: Column, sd: Column) -> Column:
    """mean / sd, 0 for a degenerate series."""
    return F.coalesce(F.when(sd > 0, F.try_divide(mean, sd)), F.lit(0.0))


def sharpe(ret: str = "ret") -> Column:
    """Aggregate expression: per-period Sharpe with sample deviation."""
    return sharpe_of(F.avg(ret), F.stddev_samp(ret))


def moment_table(returns: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    return returns.filter(F.col(ret).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"),
        F.skewness(ret).alias("g3"), (F.kurtosis(ret) + 3).alias("g4"),
    )


def psr_from_moments(benchmark: Column) -> Column:
    """Probability that the true Sharpe exceeds the benchmark, from the columns of ``moment_table``."""
    sr = F.try_divide(F.col("mean"), F.col("sd"))
    spread = F.greatest(1 - F.col("g3") * sr + (F.col("g4") - 1) / 4 * sr * sr, F.lit(1e-12))
    z = (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(spread)
    return F.when((F.col("n") >= 2) & (F.col("sd") > 0), norm_cdf(z))


def psr(returns: DataFrame, keys: Sequence[str], benchmark: float = 0.0, ret: str = "ret") -> DataFrame:
    m = moment_table(returns, keys, ret)
    return m.select(*keys, "n", sharpe_of(F.col("mean"), F.col("sd")).alias("sharpe"), psr_from_moments(F.lit(benchmark)).alias("psr"))


def expected_max_sharpe(trials: DataFrame, sharpe_col: str = "sharpe") -> DataFrame:
    """Expected best Sharpe of as many skill-less trials: NULL below two trials, 0 without dispersion."""
    s = trials.agg(F.count(sharpe_col).alias("n_trials"), F.stddev_samp(sharpe_col).alias("_sd"))
    value = F.when(F.col("n_trials") < 2, None).when(F.col("_sd") > 0, F.col("_sd") * expected_max_normal("n_trials")).otherwise(0.0)
    return s.select("n_trials", value.alias("expected_max"))


def deflated_sharpe(returns: DataFrame, trial: str = "trial", register: DataFrame | None = None) -> DataFrame:
    """PSR of the best trial (first name on ties) against the expected maximum over all trial Sharpes.

    Of a register the last value of each configuration counts, and only if the returns have no trial of that exact Sharpe.
    """
    m = moment_table(returns, [trial]).withColumn("sharpe", sharpe_of(F.col("mean"), F.col("sd")))
    population = m.select("sharpe")
    if register is not None:
        last = dedupe_trials(register) if {"config_hash", "seq"} <= set(register.columns) else register
        own = m.select(F.col(trial).cast("string").alias("config_hash"), "sharpe")
        population = union_trial_sharpes(own, last.select(F.lit("register").alias("config_hash"), "sharpe"))
    best = m.agg(F.min_by(F.struct(*m.columns), F.struct(-F.col("sharpe"), F.col(trial))).alias("_b")).select("_b.*")
    return best.join(F.broadcast(expected_max_sharpe(population))).select(
        F.col(trial).alias("best_trial"), "sharpe", "n_trials", "expected_max",
        F.when(F.col("n_trials") >= 2, psr_from_moments(F.col("expected_max"))).alias("dsr"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie ranks inside each group."""
    ranked = with_ranks(df, keys, value)
    return ranked.withColumn(out, F.col("below") + (F.col("copies") + 1) / 2).drop("below", "copies", "total")


def rank_ic(scored: DataFrame, pred: str = "pred", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of prediction and label per date; dates with one pair are skipped."""
    by = [*keys, "date"]
    pairs = scored.filter(F.col(pred).isNotNull() & F.col(label).isNotNull()).select(*by, "instrument", F.col(pred).cast("double").alias("_p"), F.col(label).cast("double").alias("_l"))
    # both ranks in one tall pass: which of the two a value is belongs to the group
    tall = pairs.select(*by, "instrument", F.explode(F.array(F.struct(F.lit(0).alias("_w"), F.col("_p").alias("_x")), F.struct(F.lit(1).alias("_w"), F.col("_l").alias("_x")))).alias("_e")).select(*by, "instrument", "_e.*")
    ranked = average_ranks(tall, [*by, "_w"], "_x", "_r").groupBy(*by, "instrument").agg(
        F.max(F.when(F.col("_w") == 0, F.col("_r"))).alias("_rp"), F.max(F.when(F.col("_w") == 1, F.col("_r"))).alias("_rl")
    )
    daily = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson("_rp", "_rl").alias("ic")
    )
    return daily.filter(F.col("n") > 1)


def rank_ic_summary(daily: DataFrame, keys: Sequence[str] = (), split: str = "split_id") -> DataFrame:
    """Mean, deviation and ratio of the rank IC; with a ``split`` column over the splits' means of their days."""
    if split in daily.columns:
        daily = daily.groupBy(*keys, split).agg(F.avg("ic").alias("ic"))
    return daily.groupBy(*keys).agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std")).withColumn(
        "icir", ratio("mean", "std")
    )


def path_distribution(paths: DataFrame, value: str = "sharpe", keys: Sequence[str] = ()) -> DataFrame:
    keyed = paths if keys else paths.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    spread = keyed.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("worst"),
        F.count(value).alias("n"),
    )
    out = spread.join(group_quantiles(keyed, by, value, {"median": 0.5}), by)
    return out if keys else out.drop("_all")


def risk_summary(returns: DataFrame, periods: float, keys: Sequence[str] = (), ret: str = "ret", compounded: bool = False) -> DataFrame:
    """Annualised return, information ratio and maximum drawdown of one-row-per-date series.

    ``periods`` per year is an argument because the convention is the caller's. The drawdown is that of the summed
    returns, or of the compounded curve.
    """
    by = list(keys)
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    clean = returns.filter(F.col(ret).isNotNull())
    if compounded:
        curve = drawdown(equity_curve(clean, ret, by), keys=by)
    else:
        curve = drawdown(clean.withColumn("equity", F.sum(ret).over(w)), keys=by, compounded=False)
    return curve.groupBy(*by).agg(
        (F.avg(ret) * periods).alias("annual_return"),
        (sharpe(ret) * F.sqrt(F.lit(float(periods)))).alias("information_ratio"),
        F.min("drawdown").alias("max_drawdown"),
    )


def excess_metrics(report: DataFrame, periods: float, keys: Sequence[str] = ()) -> DataFrame:
    """Risk summaries of return minus bench, minus bench and cost, and minus cost, in one pass over (ret, bench, cost)."""
    kinds = F.array(
        F.struct(F.lit("excess_without_cost").alias("kind"), (F.col("ret") - F.col("bench")).alias("x")),
        F.struct(F.lit("excess_with_cost").alias("kind"), (F.col("ret") - F.col("bench") - F.col("cost")).alias("x")),
        F.struct(F.lit("absolute").alias("kind"), (F.col("ret") - F.col("cost")).alias("x")),
    )
    tall = report.select(*keys, "date", F.explode(kinds).alias("_k")).select(*keys, "date", "_k.kind", F.col("_k.x").alias("ret"))
    return risk_summary(tall, periods, [*keys, "kind"])


def zscore_by(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Cross-sectional z-score with sample deviation through a joined-back aggregate."""
    stats = group_stats(df, keys, F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return stats.withColumn(out, ratio(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s")
