"""Evaluation reports: ranking, stress, cross-validation, walk-forward, multi-seed and holdout, each one keyed plan."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.operators.aggregates import seed_mean_series, seed_summary, stress_aggregate
from panelspark.operators.joins import align_common_dates, trades
from panelspark.operators.models import fit_predict, seeded_plan
from panelspark.operators.portfolio import long_short_spread, portfolio_returns, topk_members
from panelspark.operators.ranking import dedupe_dates, rank_table
from panelspark.operators.stats import (
    deflated_sharpe, excess_metrics, path_distribution, psr, rank_ic, rank_ic_summary, risk_summary, sharpe,
)
from panelspark.operators.windows import equity_curve, rebase
from panelspark.plans.resampling import paired_bootstrap_delta_ci, pbo_cscv
from panelspark.plans.validation import assemble_paths, cpcv_splits, starved_splits, window_roles
from panelspark.sources.tables import append_trial, read_trials

DAYS = 365.0


def rank_trials(trials: DataFrame, register: DataFrame | None = None, splits: int = 16) -> DataFrame:
    """Full ranking of (trial, date, ret) on the common dates, with the deflated Sharpe of the best and the PBO."""
    common = settle(align_common_dates(trials), "common")
    table = rank_table(psr(common, ["trial"]))
    best = deflated_sharpe(common, "trial", register)
    return table.withColumns(
        {"dsr_best": best.select("dsr").scalar(), "pbo": pbo_cscv(common, splits).select("pbo").scalar()}
    )


def book(scored: DataFrame, fwd: DataFrame, k: int, cost: float, keys: Sequence[str]) -> DataFrame:
    """Daily returns of an equal-weight top-k book per key from (keys, date, instrument, score) rows."""
    scored = scored.select(*keys, "date", "instrument", "score")
    return portfolio_returns(topk_members(scored, k, keys), fwd, scored.select(*keys, "date").distinct(), cost, keys)


def cpcv_predictions(panel: DataFrame, features: Sequence[str], label: str, *, groups: int, tests: int, purge: int, embargo: int,
                     model: str = "ridge", **options) -> DataFrame:
    plan = settle(cpcv_splits(panel.select("date").distinct(), groups, tests, purge, embargo), "splits")
    starved = starved_splits(plan)
    if not starved.isEmpty():
        raise ValueError(f"{starved.count()} splits without a training day: fewer groups, or a smaller purge or embargo")
    return fit_predict(panel, plan, features, label, model, **options)


def cpcv_report(
    panel: DataFrame, features: Sequence[str], label: str, *, groups: int = 6, tests: int = 2, purge: int = 2, embargo: int = 60,
    k: int = 2, cost: float = 0.0, periods: float = DAYS, model: str = "ridge", **options,
) -> tuple[DataFrame, DataFrame]:
    """(per-path risk, one-row summary) of purged combinatorial cross-validation; ``panel`` carries ``fwd``."""
    preds = settle(
        cpcv_predictions(panel, features, label, groups=groups, tests=tests, purge=purge, embargo=embargo, model=model, **options)
        .select("split_id", "grp", "date", "instrument", "pred", "fwd", label), "preds",
    )
    ic = rank_ic_summary(rank_ic(preds, "pred", label, ["split_id"]))
    paths = assemble_paths(preds, groups, tests)
    daily = book(paths.withColumn("score", F.col("pred")), panel.select("instrument", "date", "fwd"), k, cost, ["path_id"])
    risk = risk_summary(daily, periods, ["path_id"])
    spread = path_distribution(risk.withColumnRenamed("information_ratio", "sharpe"))
    one = lambda df, c: df.select(c).scalar()
    summary = spread.withColumns({f"ic_{c}": one(ic, c) for c in ("mean", "std", "icir")})
    return risk, summary


def walkforward_daily(
    panel: DataFrame, periods_table: DataFrame, features: Sequence[str], label: str, *, k: int = 2, cost: float = 0.0,
    model: str = "ridge", **options,
) -> DataFrame:
    """Daily (gross, turnover, cost, ret, period_id) of periodically refitted scores, first period winning a shared date.

    Positions carry over between periods: the book is built on the stitched scores, not restarted from cash.
    """
    spans = periods_table.withColumn("label", F.col("period_id"))
    plan = window_roles(spans).withColumnRenamed("label", "split_id")
    preds = fit_predict(panel, plan, features, label, model, **options)
    stitched = preds.groupBy("date", "instrument").agg(
        F.min_by("pred", "split_id").alias("score"), F.min("split_id").alias("period_id")
    )
    daily = book(stitched, panel.select("instrument", "date", "fwd"), k, cost, [])
    return daily.join(stitched.groupBy("date").agg(F.min("period_id").alias("period_id")), "date")


def walkforward_report(
    panel: DataFrame, periods_table: DataFrame, features: Sequence[str], label: str, benchmark: DataFrame, *, k: int = 2, cost: float = 0.0,
    model: str = "ridge", periods: float = DAYS, account: float = 1.0, **options,
) -> tuple[DataFrame, DataFrame]:
    """(daily, metrics) of periodically refitted scores, every period with a book of its own that starts from cash.

    ``daily``: the periods' reports stitched, the first period of a shared date counting: (date, period_id, gross, turnover, cost, bench,
    account, benchmark), the last two the values of ``account`` invested gross in the book and in the benchmark (date, bench).
    ``metrics``: risk of the stitched report in excess of the benchmark without and with cost, and absolute with cost.
    """
    spans = periods_table.withColumn("label", F.col("period_id"))
    plan = window_roles(spans).withColumnRenamed("label", "split_id")
    preds = fit_predict(panel, plan, features, label, model, **options).select(F.col("split_id").alias("period_id"), "date", "instrument", F.col("pred").alias("score"))
    books = book(settle(preds, "periods"), panel.select("instrument", "date", "fwd"), k, cost, ["period_id"])
    stitched = dedupe_dates(books.select("period_id", "date", "gross", "turnover", "cost"), "period_id")
    report = settle(
        stitched.join(benchmark, "date", "left").select("date", "period_id", "gross", "turnover", "cost", F.coalesce("bench", F.lit(0.0)).alias("bench")), "walkforward"
    )
    daily = equity_curve(equity_curve(report, "gross", account=account, out="account"), "bench", account=account, out="benchmark")
    return daily, excess_metrics(report.withColumnRenamed("gross", "ret"), periods)


def book_positions(scored: DataFrame, prices: DataFrame, daily: DataFrame, k: int, account: float = 1.0) -> DataFrame:
    """(date, symbol, amount, price) of an equal-weight top-k book: the account's value at each date's start, spread over its members.

    ``prices``: (instrument, date, close); members without a price are not held. ``daily``: the book's (date, gross) rows.
    """
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    worth = daily.select("date", (F.lit(account) * F.coalesce(F.product(1 + F.col("gross")).over(before), F.lit(1.0))).alias("_worth"))
    held = topk_members(scored.select("date", "instrument", "score"), k, []).join(worth, "date").join(prices.filter("close > 0").select("instrument", "date", "close"), ["instrument", "date"])
    return held.select("date", F.col("instrument").alias("symbol"), (F.col("weight") * F.col("_worth") / F.col("close")).alias("amount"), F.col("close").alias("price"))


def context_prices(panel: DataFrame, symbols: Sequence[str], start, end, base: float = 100.0) -> DataFrame:
    """(instrument, date, close, rebased) of some instruments between two dates, each rebased to its first price there."""
    some = panel.filter(F.col("instrument").isin(*symbols) & F.col("date").between(start, end)).select("instrument", "date", "close")
    return rebase(some, "close", base)


def benchmark_report(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, ret, bench, cost) from a book's daily rows and a (date, bench) series."""
    return daily.join(benchmark, "date", "left").select(
        "date", F.col("gross").alias("ret"), F.coalesce("bench", F.lit(0.0)).alias("bench"), "cost"
    )


def multiseed_report(
    panel: DataFrame, plan: DataFrame, features: Sequence[str], label: str, *, seeds: int = 5, k: int = 2, cost: float = 0.0,
    periods: float = DAYS, reg: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """(per-seed metrics, summary per metric): net and gross ending, Sharpe, PSR, drawdown, long/short Sharpe and ending."""
    keys = ["split_id", "seed"]
    preds = settle(fit_predict(panel, seeded_plan(plan, seeds), features, label, "ridge", keys=keys, reg=reg), "seeds")
    scored = preds.select("seed", "date", "instrument", F.col("pred").alias("score"), "fwd")
    daily = settle(book(scored, panel.select("instrument", "date", "fwd"), k, cost, ["seed"]), "daily")
    spread = long_short_spread(scored, k, cost, ["seed"])
    risk = risk_summary(daily, periods, ["seed"])
    ending = daily.groupBy("seed").agg(F.product(1 + F.col("gross")).alias("ending_gross"), F.product(1 + F.col("ret")).alias("ending_net"))
    legs = spread.groupBy("seed").agg(
        (sharpe("ret") * F.sqrt(F.lit(periods))).alias("ls_sharpe"), F.product(1 + F.col("ret")).alias("ls_ending")
    )
    per_seed = (
        risk.withColumnRenamed("information_ratio", "sharpe").join(ending, "seed")
        .join(psr(daily, ["seed"]).select("seed", "psr"), "seed").join(legs, "seed")
    )
    metrics = ("ending_gross", "ending_net", "sharpe", "psr", "max_drawdown", "ls_sharpe", "ls_ending")
    return per_seed, seed_summary(per_seed, metrics)


def holdout_report(daily: DataFrame, benchmark: DataFrame, periods: float = DAYS) -> DataFrame:
    """Risk of a single-fit holdout with and without benchmark and cost, plus PSR and gross and net ending values."""
    report = benchmark_report(daily, benchmark)
    ends = daily.agg(F.product(1 + F.col("gross")).alias("g"), F.product(1 + F.col("ret")).alias("n"))
    one = psr(daily.withColumn("_all", F.lit(1)), ["_all"])
    return excess_metrics(report, periods).withColumns(
        {"psr": one.select("psr").scalar(), "ending_gross": ends.select("g").scalar(), "ending_net": ends.select("n").scalar()}
    )


def holdout_bundle(
    panel: DataFrame, scored: DataFrame, benchmark: str, *, references: Sequence[str] = (), k: int = 2, cost: float = 0.0, periods: float = DAYS,
    account: float = 1.0,
) -> dict[str, DataFrame]:
    """Everything a single-fit holdout returns: ``metrics``, ``curves``, ``trades`` and ``prices``.

    ``panel`` (instrument, date, close, fwd), ``scored`` (date, instrument, score). Curves are the account invested in the book and in the
    benchmark; trades are the changes of the book's positions; prices are the benchmark's and the references' over the whole panel.
    """
    daily = settle(book(scored, panel.select("instrument", "date", "fwd"), k, cost, []), "holdout")
    bench = panel.filter(F.col("instrument") == benchmark).select("date", F.coalesce("fwd", F.lit(0.0)).alias("bench"))
    report = benchmark_report(daily, bench)
    curves = equity_curve(equity_curve(report, "ret", account=account, out="account"), "bench", account=account, out="benchmark")
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return {
        "metrics": holdout_report(daily, bench, periods), "curves": curves.select("date", "account", "benchmark"),
        "trades": trades(settle(book_positions(scored, panel, daily, k, account), "positions")),
        "prices": context_prices(panel, [benchmark, *references], span.a, span.b),
    }


def stress_report(
    panel: DataFrame, windows: DataFrame, features: Sequence[str], label: str, *, seeds: int = 3, k: int = 2, cost: float = 0.0,
    periods: float = DAYS, resamples: int = 200, reg: float = 1e-3, register: str | None = None, recipe: str = "", config: str = "",
    created: str = "", batch: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(per-window rows, aggregate): candidate against a constant-score null over windows x seeds, in keyed plans.

    With a ``register`` (path) the Sharpe per period of the candidate's daily series, pooled over all windows, is appended to it under
    ``recipe`` and the configuration hash ``config``, and the aggregate has ``pooled_sharpe``, ``n_trials`` and ``deflated_sharpe`` against the
    whole register. ``batch`` names the append, so that a replayed report registers once.
    """
    plan = window_roles(windows).withColumnRenamed("label", "window")
    keys = ["window", "seed"]
    seeded = seeded_plan(plan, seeds)
    fwd = panel.select("instrument", "date", "fwd")
    run = lambda model, **o: fit_predict(panel, seeded, features, label, model, keys=keys, **o).select(
        *keys, "date", "instrument", F.col("pred").alias("score"), "fwd"
    )
    scored = settle(
        run("ridge", reg=reg).withColumn("arm", F.lit("cand")).unionByName(run("constant").withColumn("arm", F.lit("null"))), "arms"
    )
    by = ["arm", *keys]
    daily = settle(book(scored, fwd, k, cost, by), "stress")
    sharpes = daily.groupBy(*by).agg((sharpe("ret") * F.sqrt(F.lit(periods))).alias("sr"))
    ls = long_short_spread(scored.filter(F.col("arm") == "cand"), k, cost, keys).groupBy(*keys).agg(
        (sharpe("ret") * F.sqrt(F.lit(periods))).alias("ls")
    )
    mean = seed_mean_series(daily, ["arm", "window"])
    pairs = mean.filter(F.col("arm") == "cand").select("window", "date", F.col("ret").alias("cand")).join(
        mean.filter(F.col("arm") == "null").select("window", "date", F.col("ret").alias("null_ret")), ["window", "date"]
    )
    ci = paired_bootstrap_delta_ci(pairs, block=10, resamples=resamples, seed=0, keys=["window"]).select(
        "window", F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi"), F.col("se").alias("delta_se")
    )
    rows = (
        sharpes.groupBy("window").agg(
            F.avg(F.when(F.col("arm") == "cand", F.col("sr"))).alias("sharpe_mean"),
            F.avg(F.when(F.col("arm") == "null", F.col("sr"))).alias("null_sharpe_mean"),
        )
        .withColumn("delta_sharpe", F.col("sharpe_mean") - F.col("null_sharpe_mean"))
        .join(ls.groupBy("window").agg(F.avg("ls").alias("ls_sharpe_mean"), F.min("ls").alias("ls_sharpe_min")), "window")
        .join(ci, "window", "left")
        .withColumnRenamed("window", "label")
    )
    total = stress_aggregate(rows)
    if register is None:
        return rows, total
    pooled = settle(mean.filter(F.col("arm") == "cand").select(F.lit(config).alias("trial"), "date", "ret"), "pooled")
    own = pooled.groupBy("trial").agg(sharpe("ret").alias("sharpe")).select(
        F.md5(F.concat_ws("-", F.lit(batch or config), F.lit(created))).alias("id"), F.lit(recipe).alias("recipe"), F.col("trial").alias("config_hash"), "sharpe", F.lit(created).alias("created")
    )
    append_trial(own, register, batch=batch)
    deflated = deflated_sharpe(pooled, "trial", read_trials(rows.sparkSession, register)).select(
        F.col("sharpe").alias("pooled_sharpe"), "n_trials", F.col("dsr").alias("deflated_sharpe")
    )
    return rows, total.withColumn("_one", F.lit(1)).join(deflated.withColumn("_one", F.lit(1)), "_one").drop("_one")
