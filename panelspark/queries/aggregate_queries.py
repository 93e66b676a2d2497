"""Queries of the aggregates and the Sharpe-based statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.layout import trailing
from panelspark.operators import aggregates as ag, joins, stats, windows as wo
from panelspark.queries import inputs as i
from panelspark.queries.registry import csrank, emax, over, pct, psr_sql, query, sql
from panelspark.queries.table_queries import POSITIONS, literal, mapping, positions


def settlements(spark, sf):
    return i.events(spark, sf).select(F.col("event_type").alias("perp_symbol"), "ts", F.col("value").alias("rate"))


@query("A1_daily_funding", "SELECT event_type AS perp_symbol, CAST(ts AS DATE) AS date, round(sum(value), 4) AS funding FROM events GROUP BY ALL")
def _(spark, sf):
    return i.rounded(ag.daily_funding(settlements(spark, sf)), 4)


LAST = "SELECT event_type AS perp_symbol, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS value, arg_max(user_id, row(ts, event_id)) AS user_id FROM events GROUP BY ALL"


def last_metrics(spark, sf):
    m = i.events(spark, sf).select(F.col("event_type").alias("perp_symbol"), F.col("ts").alias("create_time"), "value", "user_id", "event_id")
    return ag.last_of_day(m, ["value", "user_id"], "perp_symbol")


@query("A2_last_of_day", LAST)
def _(spark, sf):
    return last_metrics(spark, sf)


PERPS = [("view", "purchase", None, None), ("click", "error", None, "2024-01-10"), ("click", "click", "2024-01-13", None)]
CELLS = {"cells": """SELECT instrument, date, CASE WHEN instrument = 'view' THEN 'purchase' WHEN instrument <> 'click' THEN instrument
 WHEN date <= DATE '2024-01-10' THEN 'error' WHEN date >= DATE '2024-01-13' THEN 'click' END AS perp_symbol FROM (SELECT DISTINCT event_type AS instrument, CAST(ts AS DATE) AS date FROM events)"""}


def cells(spark, sf):
    days = i.events(spark, sf).select(F.col("event_type").alias("instrument"), F.to_date("ts").alias("date")).distinct()
    return joins.perp_symbols(days, mapping(spark, PERPS))


@query("A3_funding_for_instrument", sql("SELECT c.instrument, c.date, funding FROM cells c LEFT JOIN (SELECT event_type AS perp_symbol, CAST(ts AS DATE) AS date, round(sum(value), 4) AS funding FROM events GROUP BY ALL) f USING (perp_symbol, date)", **CELLS))
def _(spark, sf):
    return i.rounded(ag.mapped_fields(cells(spark, sf), ag.daily_funding(settlements(spark, sf)), ["funding"]), 4)


@query("A4_derivatives_for_instrument", sql("SELECT c.instrument, c.date, value, user_id FROM cells c LEFT JOIN last USING (perp_symbol, date)", **CELLS, last=LAST))
def _(spark, sf):
    return ag.mapped_fields(cells(spark, sf), last_metrics(spark, sf), ["value", "user_id"])


@query("A5_trade_summary", sql("SELECT count(*) AS total, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells, round(sum(value), 2) AS turnover FROM tr", "bars", **POSITIONS))
def _(spark, sf):
    return i.rounded(ag.trade_summary(joins.position_diff(positions(spark, sf))), 2)


@query("A5_trades_per_symbol", sql("SELECT symbol, count(*) AS trades FROM tr GROUP BY symbol", "bars", **POSITIONS))
def _(spark, sf):
    return ag.trades_per_symbol(joins.position_diff(positions(spark, sf)))


RUNS = {"runs": """SELECT trial, avg(ret) AS mean_ret, CASE WHEN trial = 'L3' THEN NULL ELSE stddev_samp(ret) END AS vol, max(ret) AS best FROM trials GROUP BY trial"""}


def runs(spark, sf):
    """One run per trial; L3's deviation is infinite and so counts as 0."""
    return i.trials(spark, sf).groupBy("trial").agg(F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("vol"), F.max("ret").alias("best")).withColumn(
        "vol", F.when(F.col("trial") == "L3", float("inf")).otherwise(F.col("vol")))


def summary_sql(where=""):
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max, count(*) AS n FROM (SELECT coalesce({m}, 0) AS v FROM runs {where})"
        for m in ("mean_ret", "vol", "best"))


@query("A6_seed_summary", sql(f"SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, n FROM ({summary_sql()})", "trials", **RUNS))
def _(spark, sf):
    return i.rounded(ag.seed_summary(runs(spark, sf), ["mean_ret", "vol", "best"]))


@query("A7_separation", sql("""SELECT metric, round(gap, 6) AS mean_gap, round(pooled, 6) AS pooled_std, CASE WHEN pooled > 0 THEN round(gap / pooled, 6) WHEN gap <> 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS z
 FROM (SELECT a.metric, a.mean - b.mean AS gap, sqrt((a.std * a.std + b.std * b.std) / 2) AS pooled FROM sa a JOIN sb b USING (metric))""", "trials", **RUNS,
    sa=summary_sql("WHERE trial IN ('L1', 'L2', 'L3', 'L4')"), sb=summary_sql("WHERE trial IN ('L5', 'L6', 'L7')")))
def _(spark, sf):
    half = lambda names: ag.seed_summary(runs(spark, sf).filter(F.col("trial").isin(*names)), ["mean_ret", "vol", "best"])
    return i.rounded(ag.separation(half(["L1", "L2", "L3", "L4"]), half(["L5", "L6", "L7"])))


@query("A8_sharpe", sql("SELECT trial, round(mean / sd, 6) AS sharpe FROM moments", "moments"))
def _(spark, sf):
    return i.rounded(i.trials(spark, sf).groupBy("trial").agg(stats.sharpe("ret").alias("sharpe")))


@query("A9_psr", sql(f"SELECT trial, n, round(mean / sd, 6) AS sharpe, round(psr, 6) AS psr FROM {psr_sql('moments', '0.45', 'psr')}", "moments"))
def _(spark, sf):
    return i.rounded(stats.psr(i.trials(spark, sf), ["trial"], 0.45))


SR = {"sr": "SELECT trial, mean / sd AS sharpe FROM moments"}


@query("A10_expected_max_sharpe", sql(f"SELECT n_trials, round(s * e, 6) AS expected_max FROM {emax('(SELECT count(*) AS n_trials, stddev_samp(sharpe) AS s FROM sr)', 'n_trials', 'e')}", "moments", **SR))
def _(spark, sf):
    sr = i.trials(spark, sf).groupBy("trial").agg(stats.sharpe("ret").alias("sharpe"))
    return i.rounded(stats.expected_max_sharpe(sr))


DSR = SR | {
    "em": f"SELECT n_trials, s * e AS expected_max FROM {emax('(SELECT count(*) AS n_trials, stddev_samp(sharpe) AS s FROM sr)', 'n_trials', 'e')}",
    "best": "SELECT * FROM moments, em ORDER BY mean / sd DESC, trial LIMIT 1"}


@query("A11_deflated_sharpe", sql(f"SELECT trial AS best_trial, round(mean / sd, 6) AS sharpe, n_trials, round(expected_max, 6) AS expected_max, round(dsr, 6) AS dsr FROM {psr_sql('best', 'expected_max', 'dsr')}", "moments", **DSR))
def _(spark, sf):
    return i.rounded(stats.deflated_sharpe(i.trials(spark, sf)))


IC = {"scored": f"SELECT instrument, date, fwd AS label, {pct('close', 5)} AS pred FROM returns",
      "pairs": "SELECT * FROM scored WHERE pred IS NOT NULL AND label IS NOT NULL",
      "rk": """SELECT date, rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2.0 AS rp,
 rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS rl FROM pairs""",
      "daily": "SELECT date, count(*) AS n, corr(rp, rl) AS ic FROM rk GROUP BY date HAVING count(*) > 1"}


def scored(spark, sf):
    body = lambda df, w: df.withColumn("pred", wo.momentum("close", 5, w))
    return trailing(i.returns(spark, sf), 5, body).select("instrument", "date", F.col("fwd").alias("label"), "pred")


@query("A12_rank_ic", sql("SELECT date, n, round(ic, 6) AS ic FROM daily", "returns", **IC))
def _(spark, sf):
    return i.rounded(stats.rank_ic(scored(spark, sf)))


@query("A13_rank_ic_summary", sql("SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS icir FROM (SELECT year(date) AS split_id, avg(ic) AS ic FROM daily GROUP BY ALL)", "returns", **IC))
def _(spark, sf):
    return i.rounded(stats.rank_ic_summary(stats.rank_ic(scored(spark, sf)).withColumn("split_id", F.year("date"))))


YEARS = {"paths": "SELECT trial || '-' || year(date) AS path, avg(ret) / stddev_samp(ret) AS sharpe FROM trials GROUP BY trial, year(date)"}


def paths(spark, sf):
    return i.trials(spark, sf).groupBy(F.concat_ws("-", "trial", F.year("date")).alias("path")).agg(stats.sharpe("ret").alias("sharpe"))


@query("A14_path_distribution", sql("SELECT round(avg(sharpe), 6) AS mean, round(stddev_samp(sharpe), 6) AS std, round(min(sharpe), 6) AS worst, count(*) AS n, round(quantile_cont(sharpe, 0.5), 6) AS median FROM paths", "trials", **YEARS))
def _(spark, sf):
    return i.rounded(stats.path_distribution(paths(spark, sf)))


@query("A15_cross_sectional_median", sql("SELECT date, round(quantile_cont(close, 0.5), 6) AS median FROM names GROUP BY date", "names"))
def _(spark, sf):
    return i.rounded(ag.cross_sectional_median(i.names(spark, sf), "close"))


STRESS = {"w": """SELECT y, max(CASE WHEN trial = 'L1' THEN s END) AS ls, max(CASE WHEN trial = 'L1' THEN s END) - max(CASE WHEN trial = 'L2' THEN s END) AS d
 FROM (SELECT trial, year(date) AS y, avg(ret) / stddev_samp(ret) - 0.47 AS s FROM trials GROUP BY ALL) GROUP BY y"""}


@query("A16_stress_aggregate", sql("SELECT count(*) AS n_windows, count(*) FILTER (ls > 0) AS windows_positive, round(min(ls), 6) AS ls_sharpe_worst, round(avg(ls), 6) AS ls_sharpe_mean, round(avg(d), 6) AS delta_mean FROM w", "trials", **STRESS))
def _(spark, sf):
    s = i.trials(spark, sf).groupBy("trial", F.year("date").alias("y")).agg((stats.sharpe("ret") - 0.47).alias("s"))
    one = lambda t: F.max(F.when(F.col("trial") == t, F.col("s")))
    return i.rounded(ag.stress_aggregate(s.groupBy("y").agg(one("L1").alias("ls_sharpe_mean"), (one("L1") - one("L2")).alias("delta_sharpe"))))


@query("A17_seed_mean_series", sql("SELECT date, round(avg(ret), 6) AS ret FROM trials GROUP BY date", "trials"))
def _(spark, sf):
    return i.rounded(ag.seed_mean_series(i.trials(spark, sf)))


def risk_sql(src, keys, compounded):
    k = ", ".join(keys)
    curve = f"product(1 + ret) OVER (PARTITION BY {k} ORDER BY date)" if compounded else f"sum(ret) OVER (PARTITION BY {k} ORDER BY date)"
    dd = f"eq / max(eq) OVER (PARTITION BY {k} ORDER BY date) - 1" if compounded else f"eq - max(eq) OVER (PARTITION BY {k} ORDER BY date)"
    return f"""SELECT {k}, round(avg(ret) * 365, 6) AS annual_return, CASE WHEN stddev_samp(ret) > 0 THEN round(avg(ret) / stddev_samp(ret) * sqrt(365), 6) ELSE 0 END AS information_ratio, round(min(dd), 6) AS max_drawdown
 FROM (SELECT *, {dd} AS dd FROM (SELECT *, {curve} AS eq FROM {src})) GROUP BY {k}"""


SMALL = {"small": "SELECT trial, date, ret / 50 AS ret FROM trials"}


def small(spark, sf):
    return i.trials(spark, sf).withColumn("ret", F.col("ret") / 50)


@query("A18_risk_summary", sql(risk_sql("small", ["trial"], False), "trials", **SMALL))
def _(spark, sf):
    return i.rounded(stats.risk_summary(small(spark, sf), 365, ["trial"]))


@query("A18_risk_summary_compounded", sql(risk_sql("small", ["trial"], True), "trials", **SMALL))
def _(spark, sf):
    return i.rounded(stats.risk_summary(small(spark, sf), 365, ["trial"], compounded=True))


@query("A19_excess_metrics", sql(risk_sql("kinds", ["trial", "kind"], False), "trials", **SMALL,
    rep="SELECT s.trial, s.date, s.ret, coalesce(b.ret, 0) AS bench, 0.0005::DOUBLE AS cost FROM small s LEFT JOIN small b ON b.date = s.date AND b.trial = 'L1'",
    kinds="""SELECT trial, date, 'excess_without_cost' AS kind, ret - bench AS ret FROM rep UNION ALL SELECT trial, date, 'excess_with_cost', ret - bench - cost FROM rep
 UNION ALL SELECT trial, date, 'absolute', ret - cost FROM rep"""))
def _(spark, sf):
    s = small(spark, sf)
    bench = s.filter("trial = 'L1'").select("date", F.col("ret").alias("bench"))
    rep = s.join(bench, "date", "left").withColumns({"bench": F.coalesce("bench", F.lit(0.0)), "cost": F.lit(0.0005)})
    return i.rounded(stats.excess_metrics(rep, 365, ["trial"]))


COVERED = ("close", "volume", "funding", "taker_ratio", "basis")


@query("A20_field_coverage", sql(" UNION ALL ".join(
    f"SELECT instrument, '{f}' AS field, min(CASE WHEN {f} IS NOT NULL THEN date END) AS first_date, max(CASE WHEN {f} IS NOT NULL THEN date END) AS last_date, count({f}) AS non_null, count(*) AS rows FROM dense GROUP BY instrument" for f in COVERED), "dense"))
def _(spark, sf):
    return ag.field_coverage(i.dense(spark, sf), COVERED)


FILL = {"fill": """SELECT instrument, date, sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) / sum(quantity) AS fill_rate,
 coalesce(greatest((avg(CASE WHEN NOT is_buyer_maker THEN price END) - avg(CASE WHEN is_buyer_maker THEN price END)) / avg(price), 0), 0) AS spread FROM ticks GROUP BY instrument, date"""}


@query("A21_estimate_fill", sql("SELECT instrument, date, round(fill_rate, 6) AS fill_rate, round(CASE WHEN isfinite(spread) THEN spread ELSE 0 END, 6) AS spread FROM fill", "ticks", **FILL))
def _(spark, sf):
    return i.rounded(ag.estimate_fill(i.ticks(spark, sf), ["instrument", "date"]))


IMPACT = {
    "walk": """SELECT instrument, date, price, price * quantity AS v, sum(price * quantity) OVER (PARTITION BY instrument, date) AS bar,
 coalesce(sum(price * quantity) OVER (PARTITION BY instrument, date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 first_value(price) OVER (PARTITION BY instrument, date ORDER BY seq) AS p0 FROM ticks""",
    "impact": """SELECT instrument, date, abs(sum(take) / sum(take / price) - min(p0)) / min(p0) / (0.4 * 0.4) AS impact
 FROM (SELECT *, least(v, bar * 0.4 - before) AS take FROM walk WHERE before < bar * 0.4) GROUP BY instrument, date"""}


def order_slice():
    """A thousand order numbers."""
    return F.floor(F.col("seq") / (4096 * 1000))


@query("W21_book_walk_impact", sql("SELECT instrument, date, round(impact, 6) AS impact FROM impact", "ticks", **IMPACT))
def _(spark, sf):
    return i.rounded(ag.book_walk_impact(i.ticks(spark, sf), ["instrument", "date"], i.TICK_ORDER, 0.4, order_slice()))


TIERS = [("L1", "deep"), ("L2", "deep"), ("L3", "mid"), ("L7", "thin")]


@query("A22_calibrate_costs", sql("""SELECT tier, round(impact, 6) AS impact, round(f, 6) AS fill_rate, round(s, 6) AS spread, round((1 - f) * (s / 2 + 0.0002), 6) AS haircut FROM tiers
 UNION ALL SELECT 'overall', round(avg(impact), 6), NULL, NULL, round(avg((1 - f) * (s / 2 + 0.0002)), 6) FROM tiers""", "ticks", **FILL, **IMPACT,
    tiers="""SELECT coalesce(t.tier, 'mid') AS tier, avg(impact) AS impact, avg(fill_rate) AS f, avg(spread) AS s FROM impact JOIN fill USING (instrument, date)
 LEFT JOIN (VALUES ('L1', 'deep'), ('L2', 'deep'), ('L3', 'mid'), ('L7', 'thin')) t(instrument, tier) USING (instrument) GROUP BY ALL"""))
def _(spark, sf):
    keys = ["instrument", "date"]
    t = i.ticks(spark, sf)
    per_bar = ag.book_walk_impact(t, keys, i.TICK_ORDER, 0.4, order_slice()).join(ag.estimate_fill(t, keys), keys).withColumnRenamed("instrument", "symbol")
    return i.rounded(ag.calibrate_costs(per_bar, literal(spark, TIERS, "symbol string, tier string")))


@query("A37_path_histogram", sql("SELECT CAST(CASE WHEN sharpe < 0.3 THEN 0 WHEN sharpe >= 0.7 THEN 9 ELSE floor((sharpe - 0.3) / 0.4 * 8) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM paths GROUP BY 1", "trials", **YEARS))
def _(spark, sf):
    return ag.path_histogram(paths(spark, sf), "sharpe", 0.3, 0.7, 8)
