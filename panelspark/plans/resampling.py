"""Stationary bootstrap and combinatorially symmetric cross-validation without driver loops."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import hash_uniform
from panelspark.layout import group_quantiles, settle, spread_over
from panelspark.operators.stats import sharpe, sharpe_of


def indexed(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number one-row-per-date series from 0."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    return series.withColumn("pos", F.row_number().over(w) - 1)


def series_lengths(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def bootstrap_runs(lengths: DataFrame, block: int | Column, resamples: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, b, t, start, size) for one row (keys, n) per series: the stationary bootstrap as runs.

    A position restarts with probability 1/block (always at t = 0); between restarts the index walks forward modulo n. Only restarts
    become rows, n / block per resample; all other positions are passed over where they are drawn. Draws hash (seed, b, t), so
    retried or moved tasks reproduce them. Each (series, resample) is its own window partition.
    """
    keys = list(keys)
    b = lengths.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    t = spread_over(b, *keys, "b").select(*keys, "n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("t"))
    size = block if isinstance(block, Column) else F.lit(float(block))
    restarts = t.filter((F.col("t") == 0) | (hash_uniform(F.lit(f"u{seed}"), "b", "t") < 1.0 / size))
    start = F.floor(hash_uniform(F.lit(f"s{seed}"), "b", "t") * F.col("n"))
    following = F.lead("t").over(Window.partitionBy(*keys, "b").orderBy("t"))
    return restarts.select(*keys, "n", "b", "t", start.alias("start"), (F.coalesce(following, F.col("n")) - F.col("t")).cast("long").alias("size"))


def bootstrap_indices(lengths: DataFrame, block: int | Column, resamples: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, t, idx): the runs written out, one row per series, resample and position."""
    runs = bootstrap_runs(lengths, block, resamples, seed, keys)
    steps = F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    return runs.select(*keys, "n", "b", F.col("t").alias("_t"), steps.alias("_i", "_at")).select(
        *keys, "b", (F.col("_t") + F.col("_i")).alias("t"), F.pmod("_at", F.col("n")).alias("idx")
    )


def bootstrap_draws(series: DataFrame, values: Sequence[str], block: int | Column, resamples: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Resampled rows (keys, b, values): each index once per resample, joined on the series position."""
    pos = indexed(series, keys)
    idx = bootstrap_indices(series_lengths(series, keys), block, resamples, seed, keys)
    return idx.join(pos.select(*keys, F.col("pos").alias("idx"), *values), [*keys, "idx"])


def _mean_of(n: Column, s1: Column, s2: Column, centre: Column, floor: Column) -> Column:
    return centre + F.try_divide(s1, n)


def _sharpe_of(n: Column, s1: Column, s2: Column, centre: Column, floor: Column) -> Column:
    mean = F.try_divide(s1, n)
    var = F.try_divide(s2 - s1 * mean, n - 1)
    # a constant resample has a variance of rounding only
    return sharpe_of(centre + mean, F.when((n >= 2) & (var > floor), F.sqrt(var)))


# Statistics that need no more of a resample than its number of values, their sum and their sum of squares.
MOMENT_FORMS = {F.avg: _mean_of, sharpe: _sharpe_of}


def moment_resamples(series: DataFrame, values: Sequence[str], block: int | Column, resamples: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b) with ``<value>_n``, ``_s1``, ``_s2`` of every resample about ``<value>_c``, and ``<value>_floor`` for its variance.

    A run's sums are the difference of two prefix sums of the series, with a third where it wraps at n; a run of one position is
    that position's own value. So a resample costs two rows per run, not one per position.
    """
    keys = list(keys)
    by = keys or ["_all"]
    rows = indexed(series if keys else series.withColumn("_all", F.lit(1)), by)
    centre = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"{v}_c") for v in values], *[(F.var_pop(v) * F.lit(1e-14)).alias(f"{v}_floor") for v in values])
    powers = lambda v: {"n": F.col(v).isNotNull().cast("double"), "s1": F.coalesce(F.col(v) - F.col(f"{v}_c"), F.lit(0.0)), "s2": F.coalesce((F.col(v) - F.col(f"{v}_c")) ** 2, F.lit(0.0))}
    own = {f"{v}_{k}": c for v in values for k, c in powers(v).items()}
    named = rows.join(centre, by).select(*by, "pos", *[c.alias(k) for k, c in own.items()])
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # one row per date and series, which the calendar bounds; position n closes the series with its total
    prefix = named.select(*by, "pos", *[F.col(k).alias(f"{k}_own") for k in own], *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(k) for k in own])
    total = named.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("pos"), *[F.lit(0.0).alias(f"{k}_own") for k in own], *[F.sum(k).alias(k) for k in own])
    table = prefix.unionByName(total)

    runs = bootstrap_runs(centre.select(*by, "n"), block, resamples, seed, by)
    end = F.col("start") + F.col("size")
    look = lambda at, own, sum_: F.struct(at.cast("int").alias("pos"), F.lit(own).alias("wo"), F.lit(sum_).alias("ws"))
    lookups = (
        F.when(F.col("size") == 1, F.array(look(F.col("start"), 1.0, 0.0)))
        .when(end <= F.col("n"), F.array(look(end, 0.0, 1.0), look(F.col("start"), 0.0, -1.0)))
        .otherwise(F.array(look(F.col("n"), 0.0, 1.0), look(F.col("start"), 0.0, -1.0), look(end - F.col("n"), 0.0, 1.0)))
    )
    needed = runs.select(*by, "b", F.explode(lookups).alias("_l")).select(*by, "b", "_l.*")
    met = needed.join(table, [*by, "pos"])
    sums = met.groupBy(*by, "b").agg(*[F.sum(F.col("wo") * F.col(f"{k}_own") + F.col("ws") * F.col(k)).alias(k) for k in own])
    out = sums.join(centre.drop("n"), by)
    return out if keys else out.drop("_all")


def _resampled(
    series: DataFrame, values: Sequence[str], combine: Callable[..., Column], statistic: Callable[[str], Column], block: int | Column, resamples: int, seed: int, keys: Sequence[str]
) -> DataFrame:
    """(keys, b, stat): from moments where the statistic has a form for them, else from all resampled rows."""
    form = MOMENT_FORMS.get(statistic)
    if form is None:
        draws = bootstrap_draws(series, values, block, resamples, seed, keys)
        return settle(draws.groupBy(*keys, "b").agg(combine(*[statistic(v) for v in values]).alias("stat")), "resamples")
    moments = moment_resamples(series, values, block, resamples, seed, keys)
    each = [form(*[F.col(f"{v}_{k}") for k in ("n", "s1", "s2", "c", "floor")]) for v in values]
    return settle(moments.select(*keys, "b", combine(*each).alias("stat")), "resamples")


def _interval(stats: DataFrame, point: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    by = list(keys) or ["_all"]
    if not keys:
        stats, point = stats.withColumn("_all", F.lit(1)), point.withColumn("_all", F.lit(1))
    ends = group_quantiles(stats, by, "stat", {"lo": alpha / 2, "hi": 1 - alpha / 2})
    spread = stats.groupBy(*by).agg(F.stddev_samp("stat").alias("se"))
    out = point.filter(F.col("_n") >= 2).join(ends, by).join(spread, by).drop("_n")
    return out if keys else out.drop("_all")


def bootstrap_ci(
    series: DataFrame, *, block: int | Column, resamples: int, seed: int = 0, alpha: float = 0.05,
    statistic: Callable[[str], Column] = sharpe, keys: Sequence[str] = (), ret: str = "ret",
) -> DataFrame:
    """point, lo, hi, se of an aggregate expression; series below two rows give no row."""
    stats = _resampled(series, [ret], lambda x: x, statistic, block, resamples, seed, keys)
    point = series.groupBy(*keys).agg(statistic(ret).alias("point"), F.count(F.lit(1)).alias("_n"))
    return _interval(stats, point, keys, alpha)


def paired_bootstrap_delta_ci(
    pairs: DataFrame, *, block: int | Column, resamples: int, seed: int = 0, alpha: float = 0.05,
    statistic: Callable[[str], Column] = sharpe, keys: Sequence[str] = (), cand: str = "cand", null: str = "null_ret",
) -> DataFrame:
    """Interval of statistic(cand) - statistic(null) with one index matrix for both series."""
    delta = statistic(cand) - statistic(null)
    stats = _resampled(pairs, [cand, null], lambda x, y: x - y, statistic, block, resamples, seed, keys)
    point = pairs.groupBy(*keys).agg(delta.alias("point"), F.count(F.lit(1)).alias("_n"))
    return _interval(stats, point, keys, alpha)


def group_moments(returns: DataFrame, groups: DataFrame, trial: str = "trial") -> DataFrame:
    """Sufficient statistics (n, sum, sum of squares) per trial and group, centred by the trial mean for precision."""
    centre = returns.groupBy(trial).agg(F.avg("ret").alias("_c"))
    d = F.col("ret") - F.col("_c")
    return (
        returns.join(groups.select("date", "grp"), "date").join(centre, trial)
        .groupBy(trial, "grp")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.first("_c").alias("c"))
    )


def cscv_sharpes(returns: DataFrame, splits: int, trial: str = "trial") -> DataFrame:
    """(combo, trial, is_sr, oos_sr) for every half-of-the-groups combination.

    A trial shrinks to one row holding the sufficient statistics of its groups; that row is exploded into the
    combinations and both Sharpes are arithmetic on it. No join, no shuffle, and no dependence on the series length.
    """
    if splits % 2:
        raise ValueError("the number of splits must be even")
    if returns.select("date").distinct().limit(splits).count() < splits:
        raise ValueError(f"{splits} splits need as many days")
    groups = range(splits)
    days = returns.select("date").distinct().select("date", (F.ntile(splits).over(Window.orderBy("date")) - 1).alias("grp"))
    stats = group_moments(returns, days, trial)
    wide = stats.groupBy(trial).agg(
        F.first("c").alias("c"),
        *[F.sum(name).alias(f"t_{name}") for name in ("n", "s1", "s2")],
        *[
            F.coalesce(F.sum(F.when(F.col("grp") == g, F.col(name))), F.lit(0)).alias(f"{name}_{g}")
            for g in groups for name in ("n", "s1", "s2")
        ],
    )
    # Few trials still fill the cluster: each trial's row is copied once per slice of the combinations.
    slices = 4 * int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = spread_over(wide.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), trial, "_slice")
    masks = F.sequence(F.col("_slice").cast("long"), F.lit(2**splits - 1).cast("long"), F.lit(slices).cast("long"))
    each = sliced.filter(F.col("_slice") < 2**splits).withColumn("combo", F.explode(masks)).filter(F.bit_count("combo") == splits // 2)
    inside = lambda name: sum(
        (F.getbit("combo", F.lit(g)) * F.col(f"{name}_{g}") for g in groups[1:]), F.getbit("combo", F.lit(0)) * F.col(f"{name}_0")
    )
    each = each.select(trial, "combo", "c", "t_n", "t_s1", "t_s2", *[inside(x).alias(f"i_{x}") for x in ("n", "s1", "s2")])

    def sr(n: Column, s1: Column, s2: Column) -> Column:
        mean = F.try_divide(s1, n)
        var = F.try_divide(s2 - s1 * mean, n - 1)
        # Rounding must not turn a constant half into a huge Sharpe, hence the guard relative to the whole series.
        sd = F.when((n >= 2) & (var > F.lit(1e-14) * F.try_divide(F.col("t_s2"), F.col("t_n"))), F.sqrt(var))
        return sharpe_of(F.col("c") + mean, sd)

    i = [F.col(f"i_{x}") for x in ("n", "s1", "s2")]
    o = [F.col(f"t_{x}") - F.col(f"i_{x}") for x in ("n", "s1", "s2")]
    return each.select("combo", trial, sr(*i).alias("is_sr"), sr(*o).alias("oos_sr"))


def cscv_logits(returns: DataFrame, splits: int, trial: str = "trial") -> DataFrame:
    """Per combination the in-sample best trial (first name on ties), its out-of-sample rank and logit."""
    srs = cscv_sharpes(returns, splits, trial)
    best = srs.groupBy("combo").agg(
        F.min_by(F.struct(F.col(trial).alias("best"), F.col("oos_sr").alias("best_oos")), F.struct(-F.col("is_sr"), F.col(trial))).alias("_b")
    ).select("combo", "_b.*")
    ranked = srs.join(best, "combo").groupBy("combo", "best").agg(
        F.count_if(F.col("oos_sr") <= F.col("best_oos")).alias("rank"), F.count(F.lit(1)).alias("trials")
    )
    omega = F.greatest(F.least(F.col("rank") / (F.col("trials") + 1), F.lit(1 - 1e-6)), F.lit(1e-6))
    return ranked.withColumn("logit", F.ln(omega / (1 - omega)))


def pbo_cscv(returns: DataFrame, splits: int = 16, trial: str = "trial") -> DataFrame:
    """Probability of backtest overfitting: share of combinations with a logit at or below 0; NULL below two trials."""
    return cscv_logits(returns, splits, trial).agg(
        F.when(F.max("trials") >= 2, F.avg((F.col("logit") <= 0).cast("double"))).alias("pbo"),
        F.count(F.lit(1)).alias("n_combinations"),
    )
