"""Queries of the lead-lag study."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.operators.ranking import best_cell
from panelspark.plans import leadlag as ll
from panelspark.plans.resampling import bootstrap_ci
from panelspark.queries import inputs as i
from panelspark.queries.registry import cdf, emax, lagged, query, sql
from panelspark.queries.window_queries import HOURLY_R, sums_sql

PREDS, KS, HS = ("view", "purchase"), (1, 2), (1, 2, 3)
CELL = "predictor, k, h"
BLOCK = 64  # steps in a block of lag products, far fewer than a series has
NTRIALS = len(PREDS) * len(KS) * len(HS)


def panel(spark, sf):
    """Hourly returns of the event types, scaled to hourly size and written once for the many passes of the study."""
    return settle(ll.hourly_returns(i.hourly(spark, sf)).withColumn("r", F.col("r") / 100), "hours")


def obs(spark, sf):
    return ll.observations(panel(spark, sf), PREDS, KS, HS)


BASE = dict(HOURLY_R)
BASE["hr"] = BASE["hr"].replace(" AS r FROM", " AS r0 FROM")
BASE["hr"] = "SELECT symbol, ts, step, r0 / 100 AS r FROM (" + BASE["hr"] + ")"
OBS = BASE | {
    "sums": sums_sql(KS, HS),
    "obs": " UNION ALL ".join(
        f"SELECT p.symbol AS predictor, {k} AS k, {h} AS h, a.symbol, a.ts, a.step, p.past_{k} AS pred, a.past_{k} AS own, a.fwd_{h} AS fwd FROM sums a JOIN sums p USING (step) WHERE p.symbol IN {PREDS} AND a.symbol <> p.symbol"
        for k in KS for h in HS)}
DM = OBS | {"dm": f"""SELECT {CELL}, symbol, ts, step, pred, pred - avg(pred) OVER w AS x1, own - avg(own) OVER w AS x2, fwd - avg(fwd) OVER w AS y FROM obs
 WHERE pred IS NOT NULL AND own IS NOT NULL AND fwd IS NOT NULL WINDOW w AS (PARTITION BY {CELL}, symbol)"""}


def fit_sql(keys, src="dm"):
    return f"""SELECT {keys}, n_obs, CASE WHEN n_obs >= 10 AND det > 0 THEN (a22 * b1 - a12 * b2) / det END AS beta, CASE WHEN n_obs >= 10 AND det > 0 THEN (a11 * b2 - a12 * b1) / det END AS gamma,
 a22 / det AS i11, -a12 / det AS i12 FROM (SELECT *, a11 * a22 - a12 * a12 AS det FROM (SELECT {keys}, count(*) AS n_obs, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
 sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM {src} GROUP BY {keys}))"""


FIT = DM | {"fit": fit_sql(CELL)}
SCORED = FIT | {"sc": f"SELECT *, x1 * e AS s1, x2 * e AS s2 FROM (SELECT d.*, y - beta * x1 - gamma * x2 AS e FROM dm d JOIN fit USING ({CELL}) WHERE beta IS NOT NULL)"}
CLUSTER = {"cl": f"""SELECT {CELL}, count(*) AS g, sum(g1 * g1) AS m11, sum(g1 * g2) AS m12, sum(g2 * g2) AS m22 FROM (SELECT {CELL}, ts, sum(s1) AS g1, sum(s2) AS g2 FROM sc GROUP BY {CELL}, ts) GROUP BY {CELL}""",
    "vcl": f"SELECT {CELL}, g * 1.0 / (g - 1) * (n_obs - 1) / (n_obs - 2) * (i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22) AS var_cluster FROM cl JOIN fit USING ({CELL})"}


def hac_ctes(stacked):
    w = f"(PARTITION BY {CELL} ORDER BY symbol, step)" if stacked else f"(PARTITION BY {CELL}, symbol ORDER BY step)"
    lag = lambda s, l: f"coalesce(lag({s}, {l}) OVER {w}, 0)"
    weight = lambda l: f"greatest(1 - {l}.0 / h, 0)"
    m11 = "s1 * s1" + "".join(f" + {weight(l)} * 2 * s1 * {lag('s1', l)}" for l in (1, 2))
    m12 = "s1 * s2" + "".join(f" + {weight(l)} * (s1 * {lag('s2', l)} + s2 * {lag('s1', l)})" for l in (1, 2))
    m22 = "s2 * s2" + "".join(f" + {weight(l)} * 2 * s2 * {lag('s2', l)}" for l in (1, 2))
    return {"meat": f"SELECT {CELL}, {m11} AS q11, {m12} AS q12, {m22} AS q22, e FROM sc",
        "vh": f"""SELECT {CELL}, CASE WHEN h = 1 THEN sum(e * e) / greatest(min(n_obs) - 2, 1) * min(i11)
 ELSE min(i11) * min(i11) * sum(q11) + 2 * min(i11) * min(i12) * sum(q12) + min(i12) * min(i12) * sum(q22) END AS var_hac FROM meat JOIN fit USING ({CELL}) GROUP BY {CELL}"""}


TESTS = SCORED | CLUSTER | hac_ctes(False) | {
    "tested": f"SELECT *, beta / se AS t_stat FROM (SELECT {CELL}, n_obs, beta, gamma, sqrt(greatest(var_hac, var_cluster)) AS se FROM fit JOIN vh USING ({CELL}) JOIN vcl USING ({CELL}))",
    "pv": f"SELECT *, 2 * {cdf('nt')} AS p_value FROM (SELECT *, -abs(t_stat) AS nt FROM tested)"}
IC = {"ic": f"SELECT {CELL}, avg(sign(p) * s) AS rank_ic FROM (SELECT {CELL}, ts, avg(sign(y)) AS s, min(pred) AS p FROM dm GROUP BY {CELL}, ts HAVING count(*) >= 2) GROUP BY {CELL}"}
FDR = {"fdr": f"SELECT * EXCLUDE (raw, rk), min(raw) OVER (ORDER BY rk DESC) AS bh_q FROM (SELECT *, least(1, p_value * count(*) OVER () / rk) AS raw FROM (SELECT *, row_number() OVER (ORDER BY p_value, {CELL}) AS rk FROM pv))"}
CELLS = TESTS | IC | FDR | {"cells": f"SELECT fdr.* EXCLUDE (nt), rank_ic FROM fdr LEFT JOIN ic USING ({CELL})"}


def fit(spark, sf):
    rows = settle(ll.demeaned(obs(spark, sf)), "demeaned")
    return rows, ll.pooled_ols(rows)


def scored(spark, sf):
    rows, f = fit(spark, sf)
    f = settle(f, "fit")
    return ll.scores(rows, f), f


@query("A23_pooled_ols", sql(f"SELECT {CELL}, n_obs, round(beta, 6) AS beta, round(gamma, 6) AS gamma FROM fit", "hourly", **FIT))
def _(spark, sf):
    return i.rounded(fit(spark, sf)[1].select("predictor", "k", "h", "n_obs", "beta", "gamma"))


@query("A24_clustered_cov", sql(f"SELECT {CELL}, round(sqrt(var_cluster), 6) AS se_cluster FROM vcl", "hourly", **SCORED, **CLUSTER))
def _(spark, sf):
    s, f = scored(spark, sf)
    return i.rounded(ll.clustered_variance(s, f).select("predictor", "k", "h", F.sqrt("var_cluster").alias("se_cluster")))


@query("A25_newey_west_cov", sql(f"SELECT {CELL}, round(sqrt(var_hac), 6) AS se_hac FROM vh", "hourly", **SCORED, **hac_ctes(False)))
def _(spark, sf):
    s, f = scored(spark, sf)
    return i.rounded(ll.newey_west_variance(s, f, HS, block=BLOCK).select("predictor", "k", "h", F.sqrt("var_hac").alias("se_hac")))


@query("A25_newey_west_stacked", sql(f"SELECT {CELL}, round(sqrt(var_hac) * 1000, 6) AS se_hac FROM vh", "hourly", **SCORED, **hac_ctes(True)))
def _(spark, sf):
    s, f = scored(spark, sf)
    return i.rounded(ll.newey_west_variance(s, f, HS, stacked=True, block=BLOCK).select("predictor", "k", "h", (F.sqrt("var_hac") * 1000).alias("se_hac")))


@query("A26_combine_cov_t_p", sql(f"SELECT {CELL}, n_obs, round(se, 6) AS se, round(t_stat, 5) AS t_stat, round(p_value, 5) AS p_value FROM pv", "hourly", **TESTS))
def _(spark, sf):
    s, f = scored(spark, sf)
    out = ll.combined_test(f, ll.newey_west_variance(s, f, HS), ll.clustered_variance(s, f))
    return i.rounded(out.select("predictor", "k", "h", "n_obs", "se", "t_stat", "p_value"), 6, t_stat=5, p_value=5)


@query("A27_sign_ic", sql(f"SELECT {CELL}, round(rank_ic, 6) AS rank_ic FROM ic", "hourly", **DM, **IC))
def _(spark, sf):
    return i.rounded(ll.sign_ic(ll.demeaned(obs(spark, sf))))


@query("A28_bh_fdr", sql(f"SELECT {CELL}, round(p_value, 5) AS p_value, round(bh_q, 5) AS bh_q FROM fdr", "hourly", **TESTS, **FDR))
def _(spark, sf):
    cells = ll.run_cells(panel(spark, sf), PREDS, KS, HS)
    return i.rounded(cells.select("predictor", "k", "h", "p_value", "bh_q"), 5)


@query("A29_deflated_ic", sql(f"SELECT {CELL}, round(rank_ic - e / sqrt(greatest(n_obs, 400)), 6) AS deflated_ic FROM {emax(f'(SELECT *, {NTRIALS} AS nt FROM ic JOIN fit USING ({CELL}))', 'nt', 'e')}", "hourly", **FIT, **IC))
def _(spark, sf):
    rows, f = fit(spark, sf)
    both = f.select("predictor", "k", "h", "n_obs").join(ll.sign_ic(rows), ["predictor", "k", "h"])
    return i.rounded(both.select("predictor", "k", "h", ll.deflated_ic(F.col("rank_ic"), F.lit(NTRIALS), F.col("n_obs")).alias("deflated_ic")))


SPREAD = {
    "pr": f"SELECT *, count(*) OVER (PARTITION BY {CELL}, symbol) AS n FROM obs WHERE pred IS NOT NULL AND fwd IS NOT NULL",
    "qs": f"SELECT {CELL}, quantile_cont(pred, 0.1) AS q10, quantile_cont(pred, 0.9) AS q90 FROM pr WHERE n >= 20 GROUP BY {CELL}",
    "sp": f"SELECT {CELL}, (avg(fwd) FILTER (pred >= q90) - avg(fwd) FILTER (pred <= q10)) * 10000 AS spread_bps FROM pr JOIN qs USING ({CELL}) WHERE n >= 20 GROUP BY {CELL}"}


@query("A30_decile_spread", sql(f"SELECT {CELL}, round(spread_bps, 4) AS spread_bps FROM sp", "hourly", **OBS, **SPREAD))
def _(spark, sf):
    return i.rounded(ll.decile_spread(obs(spark, sf)), 4)


YEAR = {"dy": DM["dm"].replace(CELL, CELL + ", year(ts)").replace("SELECT predictor, k, h, year(ts),", "SELECT predictor, k, h, CAST(year(ts) AS INTEGER) AS year,"),
        "fy": fit_sql(CELL + ", year", "dy")}


@query("A31_per_year_beta", sql(f"SELECT {CELL}, year, n_obs, round(beta, 6) AS beta FROM fy", "hourly", **OBS, **YEAR))
def _(spark, sf):
    return i.rounded(ll.per_year_beta(panel(spark, sf), PREDS, KS, HS))


@query("A31_same_sign", sql(f"SELECT {CELL}, count(beta) >= 2 AND min(sign(beta)) = max(sign(beta)) AS same_sign_all_years FROM fy GROUP BY {CELL}", "hourly", **OBS, **YEAR))
def _(spark, sf):
    return ll.same_sign(ll.per_year_beta(panel(spark, sf), PREDS, KS, HS))


THIN = {
    "hthin": f"SELECT symbol, ts, (step - 1) // 3 + 1 AS step, r FROM hr WHERE (step - 1) % 3 = 0",
    "sums": sums_sql([2], [1]).replace("FROM hr", "FROM hthin"),
    "obs": "SELECT p.symbol AS predictor, 2 AS k, 1 AS h, a.symbol, a.ts, a.step, p.past_2 AS pred, a.past_2 AS own, a.fwd_1 AS fwd FROM sums a JOIN sums p USING (step) WHERE p.symbol = 'view' AND a.symbol <> 'view'"}


def thin_ctes(source: dict) -> dict:
    """The chain from observations to p values under names of their own."""
    own = re.compile(r"\b(obs|dm|fit|sc|cl|vcl|meat|vh|tested|pv)\b")
    chain = {"obs": source["obs"], "dm": DM["dm"], "fit": fit_sql(CELL), "sc": SCORED["sc"]} | CLUSTER | hac_ctes(False) | {n: TESTS[n] for n in ("tested", "pv")}
    return {n: q for n, q in source.items() if n != "obs"} | {own.sub(r"\1_t", n): q if n == "obs" else own.sub(r"\1_t", q) for n, q in chain.items()}


@query("A33_nonoverlap_beta", sql("SELECT predictor, k, 3 AS h, n_obs, round(beta, 6) AS beta, round(p_value, 5) AS p_value FROM fit_t JOIN (SELECT predictor, k, h, p_value FROM pv_t) USING (predictor, k, h)", "hourly", **BASE, **thin_ctes(THIN)))
def _(spark, sf):
    return i.rounded(ll.nonoverlap_beta(panel(spark, sf), "view", 2, 3), 6, p_value=5)


CC = {"al": "SELECT a.symbol, a.ts, p.r AS p, a.r FROM hr a JOIN hr p ON p.ts = a.ts AND p.symbol = 'view' WHERE a.symbol <> 'view' AND a.r IS NOT NULL AND p.r IS NOT NULL",
      "sh": " UNION ALL ".join(f"SELECT symbol, {l} AS lag, p, {lagged('r', -l, part='symbol', order='ts')} AS r FROM al" for l in range(-6, 7))}


@query("A35_cross_correlation", sql("SELECT symbol, lag, round(CASE WHEN count(*) >= 20 AND count(r) >= 10 THEN corr(p, r) END, 6) AS corr FROM sh GROUP BY symbol, lag", "hourly", **BASE, **CC))
def _(spark, sf):
    return i.rounded(ll.cross_correlation(panel(spark, sf), "view"))


@query("A36_beta_grid", sql("SELECT k, " + ", ".join(f"round(max(beta) FILTER (h = {h}), 6) AS h{h}" for h in HS) + " FROM fit WHERE predictor = 'view' GROUP BY k", "hourly", **FIT))
def _(spark, sf):
    return i.rounded(ll.beta_grid(fit(spark, sf)[1], "view", HS))


@query("A36_ic_decay", sql(f"SELECT {CELL}, round(rank_ic, 6) AS rank_ic, row_number() OVER (PARTITION BY predictor, k ORDER BY rank_ic DESC, h) = 1 AS is_peak FROM ic", "hourly", **DM, **IC))
def _(spark, sf):
    ic = settle(ll.sign_ic(ll.demeaned(obs(spark, sf))), "ic")
    peak = ic.groupBy("predictor", "k").agg(F.min_by("h", F.struct(-F.col("rank_ic"), F.col("h"))).alias("_p"))
    return i.rounded(ic.join(peak, ["predictor", "k"]).withColumn("is_peak", F.col("h") == F.col("_p")).drop("_p"))


BEST = {"bestcell": f"SELECT * FROM cells ORDER BY CASE WHEN beta > 0 THEN 0 ELSE 1 END, bh_q, CASE WHEN beta > 0 THEN -abs(rank_ic) END, {CELL} LIMIT 1"}


@query("T4_best_cell", sql(f"SELECT {CELL}, round(beta, 6) AS beta, round(bh_q, 5) AS bh_q, round(rank_ic, 6) AS rank_ic FROM bestcell", "hourly", **CELLS, **BEST))
def _(spark, sf):
    cells = ll.run_cells(panel(spark, sf), PREDS, KS, HS)
    return i.rounded(best_cell(cells).select("predictor", "k", "h", "beta", "bh_q", "rank_ic"), 6, bh_q=5)


BOOT = {
    "ics": f"SELECT {CELL}, ts, avg(sign(pred) * fwd) AS v FROM (SELECT *, count(*) OVER (PARTITION BY {CELL}, symbol) AS nn FROM obs WHERE pred IS NOT NULL AND fwd IS NOT NULL) WHERE nn >= 10 GROUP BY {CELL}, ts",
    "pos": f"SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY ts) - 1 AS pos FROM ics",
    "len": f"SELECT {CELL}, count(*) AS n FROM ics GROUP BY {CELL}",
    "draw": f"""SELECT {CELL}, n, b, t, ('0x' || substr(md5('u42-' || b || '-' || t), 1, 8))::BIGINT / 4294967296.0 AS u, floor(('0x' || substr(md5('s42-' || b || '-' || t), 1, 8))::BIGINT / 4294967296.0 * n) AS s
 FROM len, range(40) rb(b), range(800) rt(t) WHERE t < n""",
    "last": f"SELECT *, last_value(CASE WHEN t = 0 OR u < 1.0 / greatest(h, 1) THEN t END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN t = 0 OR u < 1.0 / greatest(h, 1) THEN s END IGNORE NULLS) OVER w AS s0 FROM draw WINDOW w AS (PARTITION BY {CELL}, b ORDER BY t)",
    "bs": f"SELECT l.predictor, l.k, l.h, b, avg(p.v) AS stat FROM last l JOIN pos p ON p.predictor = l.predictor AND p.k = l.k AND p.h = l.h AND p.pos = (CAST(s0 AS BIGINT) + t - t0) % n GROUP BY ALL",
    "ci": f"SELECT {CELL}, quantile_cont(stat, 0.025) AS ic_ci_lo, quantile_cont(stat, 0.975) AS ic_ci_hi FROM bs GROUP BY {CELL}"}
ALL = CELLS | SPREAD | BOOT | YEAR | {
    "same": f"SELECT {CELL}, count(beta) >= 2 AND min(sign(beta)) = max(sign(beta)) AS same_sign_all_years FROM fy GROUP BY {CELL}",
    "defl": f"SELECT {CELL}, rank_ic - e / sqrt(greatest(n_obs, 400)) AS deflated_ic FROM {emax(f'(SELECT {CELL}, rank_ic, n_obs, {NTRIALS} AS nt FROM cells)', 'nt', 'e')}",
}
_PAST = lambda side: "CASE b.k " + " ".join(f"WHEN {k} THEN {side}.past_{k}" for k in KS) + " END"
ALL |= BEST | thin_ctes({
    "hthin": "SELECT r.symbol, r.ts, (r.step - 1) // b.h + 1 AS step, r.r FROM hr r, bestcell b WHERE (r.step - 1) % b.h = 0", "sums_n": sums_sql(KS, [1]).replace("FROM hr", "FROM hthin"),
    "obs": f"SELECT p.symbol AS predictor, b.k, 1 AS h, a.symbol, a.ts, a.step, {_PAST('p')} AS pred, {_PAST('a')} AS own, a.fwd_1 AS fwd FROM sums_n a JOIN sums_n p USING (step), bestcell b WHERE p.symbol = b.predictor AND a.symbol <> p.symbol"})
ALL |= {
    "nonover": "SELECT b.predictor, b.k, b.h, t.beta AS nonoverlap_beta, t.p_value AS nonoverlap_p FROM bestcell b, pv_t t",
    "allcells": f"SELECT * FROM cells JOIN defl USING ({CELL}) JOIN ci USING ({CELL}) JOIN same USING ({CELL}) JOIN sp USING ({CELL}) LEFT JOIN nonover USING ({CELL})"}


def study(spark, sf):
    return ll.analyze(panel(spark, sf), PREDS, KS, HS, resamples=40, seed=42)


@query("V13_lead_lag_study", sql(f"""SELECT {CELL}, n_obs, round(beta, 6) AS beta, round(t_stat, 5) AS t_stat, round(p_value, 5) AS p_value, round(bh_q, 5) AS bh_q, round(rank_ic, 6) AS rank_ic,
 round(deflated_ic, 6) AS deflated_ic, round(ic_ci_lo, 6) AS ic_ci_lo, round(ic_ci_hi, 6) AS ic_ci_hi, same_sign_all_years, round(spread_bps, 4) AS spread_bps, round(nonoverlap_beta, 6) AS nonoverlap_beta, round(nonoverlap_p, 5) AS nonoverlap_p FROM allcells""", "hourly", **ALL))
def _(spark, sf):
    out = study(spark, sf).drop("gamma", "se")
    return i.rounded(out, 6, t_stat=5, p_value=5, bh_q=5, spread_bps=4, nonoverlap_p=5)


@query("A34_verdict", sql(f"""SELECT predictor, k, h, round(spread_bps - 4.33, 4) AS net_edge_bps, bh_q < 0.05 AND deflated_ic > 0 AND ic_ci_lo > 0 AS statistical, same_sign_all_years AS regime_stable,
 spread_bps > 3 * 4.33 AND rank_ic >= 0.03 AS economic, pk > 1 AND pk < 3 AS coherent_decay,
 bh_q < 0.05 AND deflated_ic > 0 AND ic_ci_lo > 0 AND same_sign_all_years AND spread_bps > 3 * 4.33 AND rank_ic >= 0.03 AND pk > 1 AND pk < 3 AS go
 FROM allcells JOIN (SELECT predictor, k, h FROM bestcell) USING (predictor, k, h) JOIN (SELECT predictor, k, arg_max(h, row(rank_ic, -h)) AS pk FROM cells GROUP BY predictor, k) USING (predictor, k)""", "hourly", **ALL))
def _(spark, sf):
    v = ll.verdict(settle(study(spark, sf), "study"), 4.33)
    return i.rounded(v.select("predictor", "k", "h", "net_edge_bps", "statistical", "regime_stable", "economic", "coherent_decay", "go"), 4)
