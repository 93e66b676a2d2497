"""Queries of split designs, resampling, overfitting, models and reports."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelspark.layout import fresh_path, settle, trailing
from panelspark.operators import features, joins, models, stats, windows as wo
from panelspark.operators.portfolio import topk_members
from panelspark.plans import recipes, reports, resampling as rs, validation as va
from panelspark.queries import inputs as i
from panelspark.queries.aggregate_queries import DSR, SR
from panelspark.queries.portfolio_queries import VOL, book_ctes, inverse_sql, schedule_ctes, tilt_sql
from panelspark.queries.registry import csrank, emax, lagged, over, pct, psr_sql, query, rmean, rstd, sql
from panelspark.queries.table_queries import D, literal
from panelspark.sources.tables import append_trial

DAYS = {"cal": "SELECT DISTINCT date FROM dense"}
GROUPS = DAYS | {"g": "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, CAST(ntile(6) OVER (ORDER BY date) - 1 AS INTEGER) AS grp FROM cal"}
SPLITS = GROUPS | {
    "sets": """SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split_id, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b""",
    "plan0": "SELECT split_id, date, pos, grp, grp IN (a, b) AS is_test FROM sets, g",
    "plan": """SELECT split_id, date, grp, CASE WHEN is_test THEN 'test' ELSE 'train' END AS role FROM plan0 p WHERE is_test OR NOT EXISTS (
 SELECT 1 FROM plan0 t WHERE t.split_id = p.split_id AND t.is_test AND ((t.pos > p.pos AND t.pos - p.pos <= 6) OR (t.pos < p.pos AND p.pos - t.pos <= 60)))"""}


def cal(spark, sf):
    return i.dense(spark, sf).select("date").distinct()


@query("V1_cv_groups", sql("SELECT date, pos, grp FROM g", "dense", **GROUPS))
def _(spark, sf):
    return va.cv_groups(cal(spark, sf), 6)


@query("V2_cpcv_splits", sql("SELECT split_id, date, grp, role FROM plan", "dense", **SPLITS))
def _(spark, sf):
    return va.cpcv_splits(cal(spark, sf), 6, 2, 6, 60)


PATHS = {"pth": "SELECT split_id, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY split_id) - 1 AS INTEGER) AS path_id FROM (SELECT DISTINCT split_id, grp FROM plan0 WHERE is_test)"}


@query("V3_assemble_paths", sql("SELECT path_id, split_id, grp, date FROM plan JOIN pth USING (split_id, grp) WHERE role = 'test'", "dense", **SPLITS, **PATHS))
def _(spark, sf):
    test = va.cpcv_splits(cal(spark, sf), 6, 2, 6, 60).filter("role = 'test'")
    return va.assemble_paths(test, 6, 2).select("path_id", "split_id", "grp", "date")


def periods_sql(unit, months, train):
    return f"""SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS period_id, CAST({train} AS DATE) AS train_start, CAST(b - 7 AS DATE) AS train_end, b AS test_start,
 CAST(least(p + INTERVAL {months} MONTH - INTERVAL 1 DAY, hi) AS DATE) AS test_end FROM (SELECT *, CAST(greatest(p, DATE '1999-05-15') AS DATE) AS b FROM (
 SELECT unnest(generate_series(date_trunc('{unit}', DATE '1999-05-15'), max(date), INTERVAL {months} MONTH)) AS p, min(date) AS lo, max(date) AS hi FROM dense))"""


PERIODS = {"per": periods_sql("quarter", 3, "lo")}


def bounds(spark, sf):
    return i.dense(spark, sf).agg(F.min("date").alias("train_start"), F.max("date").alias("test_end")).withColumn("test_start", D("1999-05-15"))


@query("V4_wf_periods", sql("SELECT 'quarter' AS kind, * FROM (" + periods_sql("quarter", 3, "lo") + ") UNION ALL SELECT 'year', * FROM (" + periods_sql("year", 12, "b - INTERVAL 3 YEAR") + ")", "dense"))
def _(spark, sf):
    b = bounds(spark, sf)
    q = va.wf_periods(b, purge=6).withColumn("kind", F.lit("quarter"))
    return q.unionByName(va.wf_periods(b, freq="year", window="rolling", purge=6).withColumn("kind", F.lit("year")))


STARTS = ("1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01")
OOS = {"win": """SELECT 'oos_' || year(s) AS label, lo AS train_start, s - 8 AS train_end, s - 7 AS valid_start, s - 1 AS valid_end, s AS test_start, coalesce(lead(s) OVER (ORDER BY s) - 1, hi) AS test_end
 FROM (VALUES """ + ", ".join(f"(DATE '{s}')" for s in STARTS) + ") t(s), (SELECT min(date) AS lo, max(date) AS hi FROM dense)"}


def oos(spark, sf):
    starts = literal(spark, [(s,) for s in STARTS], "s string").select(F.col("s").cast("date").alias("test_start"))
    data = i.dense(spark, sf).agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"))
    return va.oos_windows(starts, data)


@query("V5_oos_windows", sql("SELECT * FROM win", "dense", **OOS))
def _(spark, sf):
    return oos(spark, sf)


def cscv_ctes(s):
    return {
        "grp": f"SELECT date, ntile({s}) OVER (ORDER BY date) - 1 AS grp FROM (SELECT DISTINCT date FROM common)",
        "ctr": "SELECT trial, avg(ret) AS c FROM common GROUP BY trial",
        "st": "SELECT trial, grp, count(*) AS n, sum(ret - c) AS s1, sum((ret - c) * (ret - c)) AS s2, min(c) AS c FROM common JOIN grp USING (date) JOIN ctr USING (trial) GROUP BY trial, grp",
        "cmb": f"SELECT range AS combo FROM range({2**s}) WHERE bit_count(range) = {s // 2}",
        "sides": "SELECT combo, trial, (combo >> grp) & 1 AS side, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, min(c) AS c FROM cmb, st GROUP BY ALL",
        "srs": "SELECT combo, trial, side, (c + s1 / n) / sqrt((s2 - s1 * s1 / n) / (n - 1)) AS sr FROM sides",
        "two": "SELECT a.combo, a.trial, a.sr AS is_sr, b.sr AS oos_sr FROM srs a JOIN srs b ON a.combo = b.combo AND a.trial = b.trial AND a.side = 1 AND b.side = 0",
        "bst": "SELECT combo, arg_max(oos_sr, is_sr) AS bo FROM two GROUP BY combo",
        "lg": "SELECT combo, ln(om / (1 - om)) AS logit FROM (SELECT combo, least(greatest(count(*) FILTER (oos_sr <= bo) * 1.0 / (count(*) + 1), 1e-6), 1 - 1e-6) AS om FROM two JOIN bst USING (combo) GROUP BY combo)"}


def common(spark, sf):
    return joins.align_common_dates(i.trials(spark, sf))


@query("V6_cscv_logits", sql("SELECT combo, round(logit, 6) AS logit FROM lg", "common", **cscv_ctes(8)))
def _(spark, sf):
    return i.rounded(rs.cscv_logits(settle(common(spark, sf), "common"), 8).select("combo", "logit"))


PBO_SQL = sql("SELECT round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_combinations FROM lg", "common", **cscv_ctes(16))


@query("V6_pbo_cscv", PBO_SQL)
def _(spark, sf):
    return i.rounded(rs.pbo_cscv(settle(common(spark, sf), "common"), 16))


@query("A32_pbo_cscv", sql("SELECT round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, count(*) AS n_combinations FROM lg", "common", **cscv_ctes(10)))
def _(spark, sf):
    return i.rounded(rs.pbo_cscv(settle(common(spark, sf), "common"), 10))


def boot_ctes(src, key, n_b, block, seed, order="date"):
    """Index walk of the stationary bootstrap for series ``src`` keyed by ``key``."""
    k = f"{key}, " if key else ""
    p = f"PARTITION BY {key}" if key else ""
    return {
        "pos": f"SELECT *, row_number() OVER ({p} ORDER BY {order}) - 1 AS pos FROM {src}",
        "len": f"SELECT {k}count(*) AS n FROM {src} GROUP BY ALL" if key else f"SELECT count(*) AS n FROM {src}",
        "draw": f"""SELECT {k}n, b, t, ('0x' || substr(md5('u{seed}-' || b || '-' || t), 1, 8))::BIGINT / 4294967296.0 AS u, floor(('0x' || substr(md5('s{seed}-' || b || '-' || t), 1, 8))::BIGINT / 4294967296.0 * n) AS s
 FROM len, range({n_b}) rb(b), range((SELECT max(n) FROM len)) rt(t) WHERE t < n""",
        "last": f"SELECT *, last_value(CASE WHEN t = 0 OR u < 1.0 / {block} THEN t END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN t = 0 OR u < 1.0 / {block} THEN s END IGNORE NULLS) OVER w AS s0 FROM draw WINDOW w AS (PARTITION BY {k}b ORDER BY t)",
        "idx": f"SELECT {k}b, t, (CAST(s0 AS BIGINT) + t - t0) % n AS idx FROM last"}


@query("V7_bootstrap_indices", sql("SELECT trial, CAST(b AS INTEGER) AS b, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total, max(idx) AS top, count(DISTINCT idx) AS used FROM idx GROUP BY trial, b", "trials", **boot_ctes("trials", "trial", 20, "10.0", 7)))
def _(spark, sf):
    idx = rs.bootstrap_indices(rs.series_lengths(i.trials(spark, sf), ["trial"]), 10, 20, 7, ["trial"])
    return idx.groupBy("trial", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total"), F.max("idx").alias("top"), F.countDistinct("idx").alias("used"))


SHARPE = "CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) ELSE 0 END"
CI = "quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, stddev_samp(stat) AS se"


@query("V8_bootstrap_ci", sql(f"""SELECT trial, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, round(se, 6) AS se FROM (SELECT trial, {SHARPE.format(x='ret')} AS point FROM trials GROUP BY trial)
 JOIN (SELECT trial, {CI} FROM (SELECT idx.trial, b, {SHARPE.format(x='ret')} AS stat FROM idx JOIN pos ON pos.trial = idx.trial AND pos.pos = idx.idx GROUP BY ALL) GROUP BY trial) USING (trial)""", "trials", **boot_ctes("trials", "trial", 60, "10.0", 3)))
def _(spark, sf):
    return i.rounded(rs.bootstrap_ci(settle(i.trials(spark, sf), "trials"), block=10, resamples=60, seed=3, keys=["trial"]))


PAIR = {"pair": "SELECT a.date, a.ret AS cand, b.ret AS null_ret FROM trials a JOIN trials b USING (date) WHERE a.trial = 'L3' AND b.trial = 'L5'"}


@query("V9_paired_bootstrap_delta_ci", sql(f"""SELECT round((SELECT {SHARPE.format(x='cand')} - {SHARPE.format(x='null_ret')} FROM pair), 6) AS point, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi, round(stddev_samp(stat), 6) AS se
 FROM (SELECT b, {SHARPE.format(x='cand')} - {SHARPE.format(x='null_ret')} AS stat FROM idx JOIN pos ON pos.pos = idx.idx GROUP BY b)""", "trials", **PAIR, **boot_ctes("pair", "", 60, "10.0", 0)))
def _(spark, sf):
    t = i.trials(spark, sf)
    pair = settle(joins.pair_returns(t.filter("trial = 'L3'"), t.filter("trial = 'L5'")), "pair")
    return i.rounded(rs.paired_bootstrap_delta_ci(pair, block=10, resamples=60, seed=0))


SEGMENTS = [("train", "1995-01-01", "1998-12-31"), ("valid", "1999-01-01", "1999-12-31"), ("test", "2000-01-01", "2001-12-31")]


@query("V10_segment_roles", sql("SELECT instrument, date, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS role FROM names", "names"))
def _(spark, sf):
    s = literal(spark, SEGMENTS, "role string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    return va.segment_roles(i.names(spark, sf).select("instrument", "date"), s)


CM = {
    "cmom": """SELECT trial, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(m * m * m) / pow(avg(m * m), 1.5) AS g3, avg(m * m * m * m) / pow(avg(m * m), 2) AS g4
 FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY trial) AS m FROM common) GROUP BY trial""",
    "reg": "SELECT arg_max(c_acctbal / 20000, c_custkey) AS sharpe FROM customer GROUP BY c_custkey % 5003",
    "pop": "SELECT mean / sd AS sharpe FROM cmom UNION ALL SELECT sharpe FROM reg",
    "cem": f"SELECT n_trials, s * e AS expected_max FROM {emax('(SELECT count(*) AS n_trials, stddev_samp(sharpe) AS s FROM pop)', 'n_trials', 'e')}",
    "cbest": "SELECT * FROM cmom, cem ORDER BY mean / sd DESC, trial LIMIT 1"}


@query("V11_rank_trials", sql(f"""SELECT trial, n, round(mean / sd, 6) AS sharpe, round(psr, 6) AS psr, CAST(row_number() OVER (ORDER BY mean / sd DESC, trial) AS INTEGER) AS rank,
 round((SELECT dsr FROM {psr_sql('cbest', 'expected_max', 'dsr')}), 6) AS dsr_best, round((SELECT avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END) FROM lg), 6) AS pbo FROM {psr_sql('cmom', '0.0', 'psr')}""", "common", **CM, **cscv_ctes(8)))
def _(spark, sf):
    """A register of all customers with repeated configurations, and of the run's own trials, which count once."""
    reg = i.table(spark, sf, "customer").select(F.pmod("c_custkey", F.lit(5003)).cast("string").alias("config_hash"), (F.col("c_acctbal") / 20000).alias("sharpe"), F.col("c_custkey").alias("seq"))
    own = stats.psr(joins.align_common_dates(i.trials(spark, sf)), ["trial"]).select(F.col("trial").alias("config_hash"), "sharpe", F.lit(0).cast("long").alias("seq"))
    return i.rounded(reports.rank_trials(i.trials(spark, sf), settle(reg.unionByName(own), "register"), 8))


# ---- models ----------------------------------------------------------------------------------------------------------

M7_COLS = {"RET5": pct("close", 5), "RET20": pct("close", 20), "MA5": f"{rmean('close', 5)} / close - 1", "MA20": f"{rmean('close', 20)} / close - 1", "VOL10": rstd("ret", 10),
           "VRATIO": f"volume / {rmean('volume', 5)} - 1", "LABEL": f"{lagged('close', -2)} / {lagged('close', -1)} - 1"}


@query("M7_basic_features", sql("SELECT instrument, date, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in M7_COLS.items()) + " FROM returns", "returns"))
def _(spark, sf):
    return i.rounded(features.basic_features(i.dense(spark, sf)))


@query("M5_cs_zscore", sql("SELECT instrument, date, round((fwd - avg(fwd) OVER (PARTITION BY date)) / nullif(stddev_samp(fwd) OVER (PARTITION BY date), 0), 6) AS z FROM returns", "returns"))
def _(spark, sf):
    return i.rounded(stats.zscore_by(i.returns(spark, sf).select("instrument", "date", "fwd"), ["date"], "fwd", "z").select("instrument", "date", "z"))


ROBUST = {"medians": "SELECT quantile_cont(close, 0.5) AS mc, quantile_cont(volume, 0.5) AS mv FROM dense WHERE date <= DATE '1998-12-31'",
          "mads": "SELECT quantile_cont(abs(close - mc), 0.5) AS dc, quantile_cont(abs(volume - mv), 0.5) AS dv FROM dense, medians WHERE date <= DATE '1998-12-31'"}
CLIP = "CASE WHEN {x} IS NOT NULL THEN greatest(least(({x} - {m}) / ({d} * 1.4826), 3), -3) END"


@query("M6_robust_zscore", sql(f"SELECT instrument, date, round({CLIP.format(x='close', m='mc', d='dc')}, 6) AS close, round({CLIP.format(x='volume', m='mv', d='dv')}, 6) AS volume FROM dense, medians, mads", "dense", **ROBUST))
def _(spark, sf):
    p = settle(i.dense(spark, sf).select("instrument", "date", "close", "volume"), "dense")
    return i.rounded(features.robust_zscore(p, ["close", "volume"], F.col("date") <= D("1998-12-31")))


def m8_sql():
    fr = lambda n: over(n)
    full = lambda x, n, e: f"CASE WHEN count({x}) {fr(n)} = {n} THEN {e} END"
    pair = lambda x, y, n: f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {fr(n)} = {n} AND var_samp({x}) {fr(n)} > 0 AND var_samp({y}) {fr(n)} > 0 THEN corr({x}, {y}) {fr(n)} END"
    cols = {
        "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / nullif(high - low, 0)", "KUP": "(high - greatest(open, close)) / open",
        "KLOW": "(least(open, close) - low) / open", "KSFT": "(2 * close - high - low) / open"}
    for n in (5, 20):
        cols |= {
            f"ROC{n}": f"{lagged('close', n)} / close", f"MA{n}": f"{rmean('close', n)} / close", f"STD{n}": f"{rstd('close', n)} / close",
            f"MAX{n}": full("close", n, f"max(high) {fr(n)} / close"), f"MIN{n}": full("close", n, f"min(low) {fr(n)} / close"),
            f"QTLU{n}": full("close", n, f"quantile_cont(close, 0.8) {fr(n)} / close"), f"QTLD{n}": full("close", n, f"quantile_cont(close, 0.2) {fr(n)} / close"),
            f"BETA{n}": full("close", n, f"regr_slope(close, t) {fr(n)} / close"), f"RSQR{n}": full("close", n, f"regr_r2(close, t) {fr(n)}"),
            f"IMAX{n}": full("close", n, f"(arg_max(t, high) {fr(n)} - t + {n}) / {n}"), f"IMIN{n}": full("close", n, f"(arg_min(t, low) {fr(n)} - t + {n}) / {n}"),
            f"CORR{n}": pair("close", "lnv", n), f"CORD{n}": pair("ret", "vchg", n), f"CNTP{n}": full("ret", n, f"avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) {fr(n)}"),
            f"SUMP{n}": full("ret", n, f"sum(greatest(ret, 0)) {fr(n)} / nullif(sum(abs(ret)) {fr(n)}, 0)"), f"VMA{n}": f"{rmean('volume', n)} / volume", f"VSTD{n}": f"{rstd('volume', n)} / volume"}
    cols |= {f"{x.upper()}_L1": f"{lagged(x, 1)} / {'volume' if x == 'volume' else 'close'}" for x in ("open", "high", "low", "close", "volume")}
    return sql("SELECT instrument, date, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in cols.items()) + " FROM base", "returns",
        base=f"SELECT instrument, date, open, high, low, close, amount AS volume, ret, {pct('amount', 1)} AS vchg, CAST(date - DATE '1970-01-01' AS DOUBLE) AS t, ln(amount + 1) AS lnv FROM returns")


@query("M8_ohlcv_factors", m8_sql())
def _(spark, sf):
    return i.rounded(features.ohlcv_factors(i.dense(spark, sf).withColumn("volume", F.col("amount")), windows=(5, 20), lags=1))


X = ("RET5", "VOL10")
REG = 0.001
MODEL = {"mp": f"""SELECT instrument, date, coalesce({M7_COLS['RET5']}, 0) / 100 AS x1, coalesce({M7_COLS['VOL10']}, 0) / 100 AS x2, ({M7_COLS['LABEL']}) / 100 AS y, fwd / 1000 AS fwd FROM returns""",
         "prods": "SELECT date, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM mp WHERE y IS NOT NULL GROUP BY date"}


def model_panel(spark, sf):
    f = features.basic_features(i.dense(spark, sf)).select("instrument", "date", *[(F.coalesce(F.col(x), F.lit(0.0)) / 100).alias(x) for x in X], (F.col("LABEL") / 100).alias("LABEL"))
    fwd = i.returns(spark, sf).select("instrument", "date", (F.col("fwd") / 1000).alias("fwd"))
    return settle(f.join(fwd, ["instrument", "date"]), "model")


def ridge_sql(plan, keys, reg=REG, weight="1"):
    """Closed-form two-feature ridge per key over the train days of ``plan``."""
    sums = ", ".join(f"sum({c} * {weight}) AS {c}" for c in ("n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y"))
    return f"""SELECT {keys}, b1, b2, sy / n - b1 * s1 / n - b2 * s2 / n AS a FROM (SELECT *, (c22 * d1 - c12 * d2) / (c11 * c22 - c12 * c12) AS b1, (c11 * d2 - c12 * d1) / (c11 * c22 - c12 * c12) AS b2 FROM (
 SELECT *, s11 / n - s1 / n * s1 / n + {reg} AS c11, s12 / n - s1 / n * s2 / n AS c12, s22 / n - s2 / n * s2 / n + {reg} AS c22, s1y / n - s1 / n * sy / n AS d1, s2y / n - s2 / n * sy / n AS d2
 FROM (SELECT {keys}, {sums} FROM {plan} JOIN prods USING (date) WHERE role = 'train' GROUP BY {keys})))"""


HOLD = {"hplan": "SELECT 1 AS split_id, date, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date > DATE '1999-12-31' THEN 'test' END AS role FROM (SELECT DISTINCT date FROM mp) WHERE date <= DATE '1998-12-31' OR date > DATE '1999-12-31'"}


def hold_plan(p):
    d = F.col("date")
    role = F.when(d <= D("1998-12-31"), "train").when(d > D("1999-12-31"), "test")
    return p.select("date").distinct().select(F.lit(1).alias("split_id"), "date", role.alias("role")).filter("role IS NOT NULL")


@query("M1_fit_predict", sql("SELECT 1 AS split_id, instrument, date, round(a + b1 * x1 + b2 * x2, 6) AS pred FROM mp, f WHERE date > DATE '1999-12-31'", "returns", **MODEL, **HOLD, f=ridge_sql("hplan", "split_id", 0.0)))
def _(spark, sf):
    p = model_panel(spark, sf)
    return i.rounded(models.fit_predict(p, hold_plan(p), X, "LABEL", "linear").select("split_id", "instrument", "date", "pred"))


@query("M2_ridge_coefficients", sql("SELECT split_id, round(a, 6) AS intercept, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM f", "returns", **MODEL, **SPLITS, f=ridge_sql("plan", "split_id")))
def _(spark, sf):
    p = model_panel(spark, sf)
    plan = va.cpcv_splits(p.select("date").distinct(), 6, 2, 6, 60).filter("role = 'train'")
    fits = models.fit_ridge(models.daily_products(p.na.drop(subset=["LABEL"]), X, "LABEL"), plan, X, REG, ["split_id"])
    return i.rounded(fits.select("split_id", "intercept", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2")))


ROUND9 = "round(x1, 9) AS x1, round(x2, 9) AS x2, round(y, 9) AS y"


def boosted_sql(plan, trees, depth, subsample, seed=1, rate=0.1, reg=1.0, bins=32):
    """Boosted trees spelt out, level by level; ``plan`` is (split_id, date, role). The last table is (split_id, instrument, date, pred)."""
    exact = lambda e: f"CAST(sum(CAST(floor(({e}) * 4294967296) AS HUGEINT)) AS DOUBLE) / 4294967296"
    out = {
        "bt_all": f"SELECT split_id, instrument, m.date, role, x1, x2, y FROM (SELECT instrument, date, {ROUND9} FROM mp) m JOIN {plan} USING (date) WHERE role = 'test' OR y IS NOT NULL",
        "bt_edges": " UNION ALL ".join(
            f"SELECT split_id, {k} AS feature, min(v) AS edge FROM (SELECT split_id, {x} AS v, (rank() OVER (PARTITION BY split_id ORDER BY {x}) - 1) * {bins} // count(*) OVER (PARTITION BY split_id) AS b FROM bt_all WHERE role = 'train') WHERE b > 0 GROUP BY split_id, b"
            for k, x in enumerate(("x1", "x2"))),
        "bt_f0": f"""SELECT split_id, instrument, date, role, y, base AS pred, (SELECT count(*) FROM bt_edges e WHERE e.split_id = a.split_id AND feature = 0 AND edge <= x1) AS b0,
 (SELECT count(*) FROM bt_edges e WHERE e.split_id = a.split_id AND feature = 1 AND edge <= x2) AS b1 FROM bt_all a JOIN (SELECT split_id, {exact('y')} / count(*) AS base FROM bt_all WHERE role = 'train' GROUP BY split_id) USING (split_id)""",
    }
    for t in range(trees):
        draw = "true" if subsample >= 1 else f"('0x' || substr(md5('{seed}.{t}-' || split_id || '-' || instrument || '-' || date), 1, 8))::BIGINT / 4294967296.0 < {subsample}"
        out[f"bt_n{t}_0"] = f"SELECT *, y - pred AS r, role = 'train' AND {draw} AS used, 0 AS node FROM bt_f{t}"
        for k in range(depth):
            tall = " UNION ALL ".join(f"SELECT split_id, node, {f} AS feature, b{f} AS bin, r FROM bt_n{t}_{k} WHERE used" for f in (0, 1))
            out[f"bt_h{t}_{k}"] = f"SELECT split_id, node, feature, bin, sum(CAST(floor(r * 4294967296) AS HUGEINT)) AS g, count(*) AS n FROM ({tall}) GROUP BY ALL"
            out[f"bt_c{t}_{k}"] = f"""SELECT split_id, node, feature, bin FROM (SELECT *, gl * gl / (nl + {reg}) + (ga - gl) * (ga - gl) / (na - nl + {reg}) - ga * ga / (na + {reg}) AS gain FROM (
 SELECT split_id, node, feature, bin, CAST(sum(g) OVER p AS DOUBLE) / 4294967296 AS ga, CAST(sum(n) OVER p AS DOUBLE) AS na, CAST(sum(g) OVER q AS DOUBLE) / 4294967296 AS gl, CAST(sum(n) OVER q AS DOUBLE) AS nl
 FROM bt_h{t}_{k} WINDOW p AS (PARTITION BY split_id, node, feature), q AS (PARTITION BY split_id, node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE nl >= 1)
 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY split_id, node ORDER BY gain DESC, feature, bin) = 1"""
            out[f"bt_n{t}_{k + 1}"] = f"""SELECT a.* EXCLUDE (node), a.node * 2 + 1 + coalesce(CAST(CASE feature WHEN 0 THEN b0 ELSE b1 END >= bin AS INTEGER), 0) AS node
 FROM bt_n{t}_{k} a LEFT JOIN bt_c{t}_{k} c ON a.split_id = c.split_id AND a.node = c.node"""
        out[f"bt_f{t + 1}"] = f"""SELECT a.split_id, instrument, date, role, y, pred + coalesce(v, 0) AS pred, b0, b1 FROM bt_n{t}_{depth} a
 LEFT JOIN (SELECT split_id, node, {exact('r')} / (count(*) + {reg}) * {rate} AS v FROM bt_n{t}_{depth} WHERE used GROUP BY split_id, node) l ON a.split_id = l.split_id AND a.node = l.node"""
    return out


def boosted_query(on, trees, depth, subsample, **extra):
    text = sql(f"SELECT split_id, instrument, date, round(pred, 6) AS pred FROM bt_f{trees} WHERE role = 'test'", "returns", **MODEL, **extra, **boosted_sql(on, trees, depth, subsample))
    return re.sub(r"\b(bt_\w+|mp) AS \(", r"\1 AS MATERIALIZED (", text)


def nine_digits(p):
    """Features and label as the SQL of boosted trees takes them: equal values have to be equal on both sides to share a bin."""
    return p.select("instrument", "date", *[F.round(c, 9).alias(c) for c in (*X, "LABEL")])


@query("M3_boosted_trees", boosted_query("hplan", 5, 3, 0.8, **HOLD))
def _(spark, sf):
    p = model_panel(spark, sf)
    return i.rounded(models.fit_predict(nine_digits(p), hold_plan(p), X, "LABEL", "boosted", seed=1, trees=5, depth=3).select("split_id", "instrument", "date", "pred"))


@query("M3_boosted_stumps", boosted_query("plan", 2, 1, 1, **SPLITS))
def _(spark, sf):
    p = model_panel(spark, sf)
    plan = va.cpcv_splits(p.select("date").distinct(), 6, 2, 6, 60)
    return i.rounded(models.fit_predict(nine_digits(p), plan, X, "LABEL", "boosted", trees=2, depth=1, subsample=1).select("split_id", "instrument", "date", "pred"))


@query("M4_constant", sql("SELECT split_id, instrument, date, round(sy / n, 6) AS pred FROM (SELECT split_id, sum(sy) AS sy, sum(n) AS n FROM plan JOIN prods USING (date) WHERE role = 'train' GROUP BY split_id) JOIN plan USING (split_id) JOIN mp USING (date) WHERE role = 'test'", "returns", **MODEL, **SPLITS))
def _(spark, sf):
    p = model_panel(spark, sf)
    plan = va.cpcv_splits(p.select("date").distinct(), 6, 2, 6, 60)
    return i.rounded(models.fit_predict(p, plan, X, "LABEL", "constant").select("split_id", "instrument", "date", "pred"))


# ---- reports -----------------------------------------------------------------------------------------------------------

def keyed_book(scored, keys, cost, k=2):
    """Daily returns of an equal-weight top-k book per key; ``scored`` has (keys, date, instrument, score, fwd)."""
    kk = f"{keys}, " if keys else ""
    on = " AND ".join(f"{{0}}.{c.strip()} = d.{c.strip()}" for c in keys.split(",")) + " AND " if keys else ""
    return {
        "tk": f"SELECT {kk}date, instrument, fwd, 1.0 / count(*) OVER (PARTITION BY {kk}date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY {kk}date ORDER BY score DESC, instrument) AS rk FROM {scored}) WHERE rk <= {k}",
        "dd": f"SELECT *, lag(date) OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY date) AS prev FROM (SELECT DISTINCT {kk}date FROM {scored})",
        "bk": f"""SELECT {', '.join('d.' + c.strip() for c in keys.split(',')) + ',' if keys else ''} d.date, coalesce(g.gross, 0) AS gross, coalesce(c.turnover, 0) AS turnover, coalesce(c.turnover, 0) * {cost} AS cost,
 coalesce(g.gross, 0) - coalesce(c.turnover, 0) * {cost} AS ret FROM dd d LEFT JOIN (SELECT {kk}date, sum(weight * coalesce(fwd, 0)) AS gross FROM tk GROUP BY ALL) g ON {on.format('g')} g.date = d.date
 LEFT JOIN (SELECT {kk}date, sum(abs(x)) AS turnover FROM (SELECT {kk}date, instrument, sum(w) AS x FROM (SELECT {kk}date, instrument, weight AS w FROM tk
 UNION ALL SELECT {', '.join('d.' + c.strip() for c in keys.split(',')) + ',' if keys else ''} d.date, t.instrument, -t.weight FROM dd d JOIN tk t ON {on.format('t')} t.date = d.prev) GROUP BY ALL) GROUP BY ALL) c ON {on.format('c')} c.date = d.date"""}


RISK = "round(avg(ret) * 365, 6) AS annual_return, CASE WHEN stddev_samp(ret) > 0 THEN round(avg(ret) / stddev_samp(ret) * sqrt(365), 6) ELSE 0 END AS information_ratio, round(min(dd), 6) AS max_drawdown"


def risk_over(src, keys):
    p = f"PARTITION BY {keys} " if keys else ""
    return f"(SELECT *, eq - max(eq) OVER ({p}ORDER BY date) AS dd FROM (SELECT *, sum(ret) OVER ({p}ORDER BY date) AS eq FROM {src}))"


CPCV = MODEL | SPLITS | PATHS | {"f": ridge_sql("plan", "split_id"), "pr": "SELECT split_id, grp, date, instrument, a + b1 * x1 + b2 * x2 AS score, y, fwd FROM plan JOIN mp USING (date) JOIN f USING (split_id) WHERE role = 'test'",
    "ps": "SELECT path_id, date, instrument, score, fwd FROM pr JOIN pth USING (split_id, grp)", **keyed_book("ps", "path_id", 0.001)}


def cpcv(spark, sf):
    return reports.cpcv_report(model_panel(spark, sf), X, "LABEL", groups=6, tests=2, purge=6, embargo=60, k=2, cost=0.001, reg=REG)


@query("V14_cpcv_report", sql(f"SELECT path_id, {RISK} FROM {risk_over('bk', 'path_id')} GROUP BY path_id", "returns", **CPCV))
def _(spark, sf):
    return i.rounded(cpcv(spark, sf)[0])


@query("V14_cpcv_summary", sql(f"""SELECT round(avg(ir), 5) AS mean, round(stddev_samp(ir), 5) AS std, round(min(ir), 5) AS worst, count(*) AS n, round(quantile_cont(ir, 0.5), 5) AS median,
 (SELECT round(avg(ic), 5) FROM dic) AS ic_mean, (SELECT round(stddev_samp(ic), 5) FROM dic) AS ic_std, (SELECT round(avg(ic) / stddev_samp(ic), 5) FROM dic) AS ic_icir
 FROM (SELECT path_id, avg(ret) / stddev_samp(ret) * sqrt(365) AS ir FROM bk GROUP BY path_id)""", "returns", **CPCV,
    dic=f"SELECT split_id, avg(ic) AS ic FROM (SELECT split_id, date, corr(rp, rl) AS ic FROM (SELECT split_id, date, {csrank('score', 'split_id, date')} AS rp, {csrank('y', 'split_id, date')} AS rl FROM pr WHERE y IS NOT NULL) GROUP BY ALL HAVING count(*) > 1 AND var_samp(rp) > 0 AND var_samp(rl) > 0) GROUP BY split_id"))
def _(spark, sf):
    return i.rounded(cpcv(spark, sf)[1], 5)


WF = MODEL | {"per": PERIODS["per"], "wplan": """SELECT period_id AS split_id, date, CASE WHEN date <= train_end THEN 'train' ELSE 'test' END AS role FROM per JOIN (SELECT DISTINCT date FROM mp) d
 ON (date BETWEEN train_start AND train_end) OR (date BETWEEN test_start AND test_end)""", "f": ridge_sql("wplan", "split_id"),
    "ps": "SELECT date, instrument, a + b1 * x1 + b2 * x2 AS score, fwd, split_id AS period_id FROM wplan JOIN mp USING (date) JOIN f USING (split_id) WHERE role = 'test'", **keyed_book("ps", "", 0.001)}


@query("V15_walkforward_report", sql("SELECT b.date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(ret, 6) AS ret, p.period_id FROM bk b JOIN (SELECT date, min(period_id) AS period_id FROM ps GROUP BY date) p USING (date)", "returns", "dense", **WF))
def _(spark, sf):
    p = model_panel(spark, sf)
    d = reports.walkforward_daily(p, settle(va.wf_periods(bounds(spark, sf), purge=6), "periods"), X, "LABEL", k=2, cost=0.001, reg=REG)
    return i.rounded(d.select("date", "gross", "turnover", "ret", "period_id"))


WR = WF | keyed_book("ps", "period_id", 0.001) | {
    "rep": """SELECT b.date, period_id, gross, turnover, cost, coalesce(m.fwd, 0) AS bench FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY period_id) AS rn FROM bk) b
 LEFT JOIN (SELECT date, fwd FROM mp WHERE instrument = 'L1') m USING (date) WHERE rn = 1""",
    "kinds": "SELECT date, 'excess_without_cost' AS kind, gross - bench AS ret FROM rep UNION ALL SELECT date, 'excess_with_cost', gross - bench - cost FROM rep UNION ALL SELECT date, 'absolute', gross - cost FROM rep"}


def walkforward(spark, sf):
    p = model_panel(spark, sf)
    bench = p.filter("instrument = 'L1'").select("date", F.coalesce("fwd", F.lit(0.0)).alias("bench"))
    return reports.walkforward_report(p, settle(va.wf_periods(bounds(spark, sf), purge=6), "periods"), X, "LABEL", bench, k=2, cost=0.001, reg=REG)


@query("V15_walkforward_curves", sql("""SELECT date, period_id, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(bench, 6) AS bench,
 round(sum(ln(1 + gross)) OVER (ORDER BY date), 6) AS log_account, round(sum(ln(1 + bench)) OVER (ORDER BY date), 6) AS log_benchmark FROM rep""", "returns", "dense", **WR))
def _(spark, sf):
    """Every period's own book, stitched; curves as logarithms, for they span many orders of size."""
    daily = walkforward(spark, sf)[0].withColumns({f"log_{c}": F.ln(c) for c in ("account", "benchmark")}).drop("account", "benchmark")
    return i.rounded(daily)


@query("V15_walkforward_metrics", sql(f"SELECT kind, {RISK} FROM {risk_over('kinds', 'kind')} GROUP BY kind", "returns", "dense", **WR))
def _(spark, sf):
    return i.rounded(walkforward(spark, sf)[1])


def ls_ctes(rows: str, key: str) -> dict[str, str]:
    """Daily long/short returns ``lsx`` of (key, date, instrument, score, fwd) rows: two names a leg, 10 bp an entry."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in key.split(", "))
    return {
        "lsu": rows,
        "lsr": f"""SELECT *, least(2, count(*) OVER (PARTITION BY {key}, date) // 2) AS kk, row_number() OVER (PARTITION BY {key}, date ORDER BY score DESC, instrument DESC) AS rd,
 row_number() OVER (PARTITION BY {key}, date ORDER BY score, instrument) AS ra FROM lsu""",
        "lsl": f"SELECT {key}, date, instrument, fwd, kk, 'long' AS leg FROM lsr WHERE rd <= kk UNION ALL SELECT {key}, date, instrument, fwd, kk, 'short' FROM lsr WHERE ra <= kk",
        "lsd": f"SELECT *, lag(date) OVER (PARTITION BY {key} ORDER BY date) AS prev FROM (SELECT DISTINCT {key}, date FROM lsu)",
        "lse": f"""SELECT {of('d')}, d.date, count(l.instrument) AS entries FROM lsd d LEFT JOIN (SELECT l.*, p.instrument AS was FROM lsl l JOIN lsd d ON {on('d', 'l')} AND d.date = l.date
 LEFT JOIN lsl p ON {on('p', 'l')} AND p.date = d.prev AND p.leg = l.leg AND p.instrument = l.instrument) l ON {on('l', 'd')} AND l.date = d.date AND l.was IS NULL GROUP BY ALL""",
        "lsx": f"""SELECT {of('e')}, e.date, coalesce(x.sp - 0.001 * entries / x.kk, 0) AS ret FROM lse e LEFT JOIN (SELECT {key}, date, max(kk) AS kk, avg(fwd) FILTER (leg = 'long') - avg(fwd) FILTER (leg = 'short') AS sp
 FROM lsl GROUP BY ALL) x ON {on('x', 'e')} AND x.date = e.date"""}


SEEDS = {"seeded": "SELECT split_id, s AS seed, date, role, CASE WHEN ('0x' || substr(md5(s || '-' || date), 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 1.0 ELSE 0.0 END AS w FROM hplan, range(1, 4) t(s)"}
MS = MODEL | HOLD | SEEDS | {"f": ridge_sql("seeded", "split_id, seed", REG, "w"),
    "ps": "SELECT seed, date, instrument, a + b1 * x1 + b2 * x2 AS score, fwd FROM seeded JOIN mp USING (date) JOIN f USING (split_id, seed) WHERE role = 'test'", **keyed_book("ps", "seed", 0.001)}


def multiseed(spark, sf):
    p = model_panel(spark, sf)
    return reports.multiseed_report(p, hold_plan(p), X, "LABEL", seeds=3, k=2, cost=0.001, reg=REG)


SEED_METRICS = MS | ls_ctes("SELECT * FROM ps WHERE fwd IS NOT NULL", "seed") | {
    "smom": """SELECT seed, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(m * m * m) / pow(avg(m * m), 1.5) AS g3, avg(m * m * m * m) / pow(avg(m * m), 2) AS g4
 FROM (SELECT seed, ret, ret - avg(ret) OVER (PARTITION BY seed) AS m FROM bk) GROUP BY seed""",
    "one": f"""SELECT seed, sharpe, max_drawdown, leg, len, psr, lss, lsl2 FROM
 (SELECT seed, avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe, min(dd) AS max_drawdown, sum(ln(1 + gross)) AS leg, sum(ln(1 + ret)) AS len FROM {risk_over('bk', 'seed')} GROUP BY seed)
 JOIN (SELECT seed, psr FROM {psr_sql('smom', '0.0', 'psr')}) USING (seed) JOIN (SELECT seed, avg(ret) / stddev_samp(ret) * sqrt(365) AS lss, sum(ln(1 + ret)) AS lsl2 FROM lsx GROUP BY seed) USING (seed)"""}


@query("V16_multiseed_report", sql("""SELECT CAST(seed AS INTEGER) AS seed, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(leg, 6) AS log_ending_gross, round(len, 6) AS log_ending_net,
 round(psr, 6) AS psr, round(lss, 6) AS ls_sharpe, round(lsl2, 6) AS log_ls_ending FROM one""", "returns", **SEED_METRICS))
def _(spark, sf):
    per_seed, _ = multiseed(spark, sf)
    logs = {f"log_{c}": F.ln(c) for c in ("ending_gross", "ending_net", "ls_ending")}
    return i.rounded(per_seed.withColumns(logs).select("seed", "sharpe", "max_drawdown", "log_ending_gross", "log_ending_net", "psr", "ls_sharpe", "log_ls_ending"))


@query("V16_multiseed_summary", sql("""SELECT metric, CAST(format('{:.4e}', avg(v)) AS DOUBLE) AS mean, CAST(format('{:.4e}', stddev_samp(v)) AS DOUBLE) AS std, CAST(format('{:.4e}', min(v)) AS DOUBLE) AS min, CAST(format('{:.4e}', max(v)) AS DOUBLE) AS max, count(*) AS n FROM (
 SELECT seed, unnest(['sharpe', 'max_drawdown', 'psr', 'ls_sharpe', 'ending_gross', 'ending_net', 'ls_ending']) AS metric, unnest([sharpe, max_drawdown, psr, lss, exp(leg), exp(len), exp(lsl2)]) AS v FROM one) GROUP BY metric""", "returns", **SEED_METRICS))
def _(spark, sf):
    """All seven metrics, to five digits: ending values span many orders of size."""
    _, summary = multiseed(spark, sf)
    digits = lambda c: F.format_string("%.4e", F.col(c)).cast("double").alias(c)
    return summary.select("metric", *[digits(c) for c in ("mean", "std", "min", "max")], "n")


HR = MODEL | HOLD | {"f": ridge_sql("hplan", "split_id"), "ps": "SELECT date, instrument, a + b1 * x1 + b2 * x2 AS score, fwd FROM hplan JOIN mp USING (date) JOIN f USING (split_id) WHERE role = 'test'", **keyed_book("ps", "", 0.001),
    "rep": "SELECT date, gross AS r, coalesce(b.fwd, 0) AS bench, cost FROM bk LEFT JOIN (SELECT date, fwd FROM mp WHERE instrument = 'L1') b USING (date)",
    "kinds": "SELECT date, 'excess_without_cost' AS kind, r - bench AS ret FROM rep UNION ALL SELECT date, 'excess_with_cost', r - bench - cost FROM rep UNION ALL SELECT date, 'absolute', r - cost FROM rep",
    "hm": """SELECT count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(m * m * m) / pow(avg(m * m), 1.5) AS g3, avg(m * m * m * m) / pow(avg(m * m), 2) AS g4 FROM (SELECT ret, ret - avg(ret) OVER () AS m FROM bk)"""}


@query("V17_holdout_report", sql(f"""SELECT kind, {RISK}, (SELECT round(p, 6) FROM {psr_sql('hm', '0.0', 'p')}) AS psr, (SELECT round(sum(ln(1 + gross)), 6) FROM bk) AS log_gross, (SELECT round(sum(ln(1 + ret)), 6) FROM bk) AS log_net
 FROM {risk_over('kinds', 'kind')} GROUP BY kind""", "returns", **HR))
def _(spark, sf):
    p = model_panel(spark, sf)
    preds = settle(models.fit_predict(p, hold_plan(p), X, "LABEL", "ridge", reg=REG).select("date", "instrument", F.col("pred").alias("score")), "preds")
    daily = settle(reports.book(preds, p.select("instrument", "date", "fwd"), 2, 0.001, []), "book")
    bench = p.filter("instrument = 'L1'").select("date", F.coalesce("fwd", F.lit(0.0)).alias("bench"))
    out = reports.holdout_report(daily, bench)
    return i.rounded(out.select("*", F.ln("ending_gross").alias("log_gross"), F.ln("ending_net").alias("log_net")).drop("ending_gross", "ending_net"))


HB = HR | {
    "worth": "SELECT date, 1000000 * coalesce(exp(sum(ln(1 + gross)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS worth FROM bk",
    "hold": "SELECT t.date, t.instrument AS symbol, weight * worth / close AS amount, close AS price FROM tk t JOIN worth USING (date) JOIN dense d ON d.date = t.date AND d.instrument = t.instrument WHERE close > 0",
    "steps": "SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM hold)",
    "was": "SELECT nxt AS date, symbol, amount AS was, price AS old FROM hold JOIN steps USING (date) WHERE nxt IS NOT NULL",
    "moves": "SELECT coalesce(h.date, w.date) AS date, coalesce(h.symbol, w.symbol) AS symbol, coalesce(amount, 0) - coalesce(was, 0) AS d, coalesce(price, old) AS price FROM hold h FULL JOIN was w ON h.date = w.date AND h.symbol = w.symbol"}


def bundle(spark, sf):
    p = model_panel(spark, sf).join(i.dense(spark, sf).select("instrument", "date", "close"), ["instrument", "date"], "left")
    preds = settle(models.fit_predict(p, hold_plan(p), X, "LABEL", "ridge", reg=REG).select("date", "instrument", F.col("pred").alias("score")), "preds")
    return reports.holdout_bundle(p, preds, "L1", references=("L2", "L4"), k=2, cost=0.001, account=1e6)


@query("V17_holdout_trades", sql("""SELECT row_number() OVER (ORDER BY date, symbol) AS line, date, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, symbol, round(abs(d), 4) AS qty, round(price, 6) AS price,
 round(abs(d) * price, 2) AS value FROM moves WHERE abs(d) > 1e-12""", "returns", "dense", **HB))
def _(spark, sf):
    return i.rounded(bundle(spark, sf)["trades"], 6, qty=4, value=2)


@query("V17_holdout_curves", sql("SELECT date, round(sum(ln(1 + r)) OVER (ORDER BY date), 6) AS log_account, round(sum(ln(1 + bench)) OVER (ORDER BY date), 6) AS log_benchmark FROM rep", "returns", "dense", **HB))
def _(spark, sf):
    curves = bundle(spark, sf)["curves"]
    return i.rounded(curves.select("date", F.ln(F.col("account") / 1e6).alias("log_account"), F.ln(F.col("benchmark") / 1e6).alias("log_benchmark")))


@query("V17_context_prices", sql("""SELECT instrument, date, round(close, 6) AS close, round(close / first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, 6) AS rebased
 FROM dense WHERE instrument IN ('L1', 'L2', 'L4')""", "dense"))
def _(spark, sf):
    return i.rounded(bundle(spark, sf)["prices"])


ST = MODEL | OOS | {
    "wr": "SELECT label, date, CASE WHEN date <= train_end THEN 'train' ELSE 'test' END AS role FROM win JOIN (SELECT DISTINCT date FROM mp) d ON (date BETWEEN train_start AND train_end) OR (date BETWEEN test_start AND test_end)",
    "seeded": "SELECT label, s AS seed, date, role, CASE WHEN ('0x' || substr(md5(s || '-' || date), 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 1.0 ELSE 0.0 END AS w FROM wr, range(1, 3) t(s)",
    "f": ridge_sql("seeded", "label, seed", REG, "w"),
    "ps": """SELECT 'cand' AS arm, label, seed, date, instrument, a + b1 * x1 + b2 * x2 AS score, fwd FROM seeded JOIN mp USING (date) JOIN f USING (label, seed) WHERE role = 'test'
 UNION ALL SELECT 'null', label, seed, date, instrument, 0.0, fwd FROM seeded JOIN mp USING (date) WHERE role = 'test'""",
    **keyed_book("ps", "arm, label, seed", 0.001),
    "shp": "SELECT arm, label, seed, avg(ret) / stddev_samp(ret) * sqrt(365) AS sr FROM bk GROUP BY ALL"}


def stress(spark, sf, **register):
    return reports.stress_report(model_panel(spark, sf), settle(oos(spark, sf), "oos"), X, "LABEL", seeds=2, k=2, cost=0.001, resamples=40, reg=REG, **register)


MEANS = ST | {"mean": "SELECT arm, label, date, avg(ret) AS ret FROM bk GROUP BY ALL", "pair": "SELECT c.label, c.date, c.ret AS cand, n.ret AS null_ret FROM mean c JOIN mean n ON c.label = n.label AND c.date = n.date AND c.arm = 'cand' AND n.arm = 'null'",
    **boot_ctes("pair", "label", 40, "10.0", 0)}


LSW = MEANS | ls_ctes("SELECT * FROM ps WHERE arm = 'cand' AND fwd IS NOT NULL", "label, seed") | {
    "lsw": "SELECT label, avg(s) AS ls, min(s) AS lo FROM (SELECT label, seed, avg(ret) / stddev_samp(ret) * sqrt(365) AS s FROM lsx GROUP BY ALL) GROUP BY label",
    "dlt": "SELECT label, avg(sr) FILTER (arm = 'cand') - avg(sr) FILTER (arm = 'null') AS d FROM shp GROUP BY label"}


@query("V12_stress_report", sql(f"""SELECT label, round(c, 5) AS sharpe_mean, round(n, 5) AS null_sharpe_mean, round(c - n, 5) AS delta_sharpe, round(q.lo, 5) AS delta_lo, round(hi, 5) AS delta_hi, round(se, 5) AS delta_se, round(ls, 5) AS ls_sharpe_mean, round(w.lo, 5) AS ls_sharpe_min
 FROM (SELECT label, avg(sr) FILTER (arm = 'cand') AS c, avg(sr) FILTER (arm = 'null') AS n FROM shp GROUP BY label)
 JOIN (SELECT label, {CI} FROM (SELECT idx.label, b, {SHARPE.format(x='cand')} - {SHARPE.format(x='null_ret')} AS stat FROM idx JOIN pos ON pos.label = idx.label AND pos.pos = idx.idx GROUP BY ALL) GROUP BY label) q USING (label) JOIN lsw w USING (label)""", "returns", **LSW))
def _(spark, sf):
    rows, _ = stress(spark, sf)
    return i.rounded(rows, 5)


DEFLATED = LSW | {
    "lastreg": "SELECT arg_max((o_totalprice % 1000) / 10000, o_orderkey) AS sharpe FROM orders GROUP BY o_custkey",
    "pm": """SELECT count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(m * m * m) / pow(avg(m * m), 1.5) AS g3, avg(m * m * m * m) / pow(avg(m * m), 2) AS g4
 FROM (SELECT ret, ret - avg(ret) OVER () AS m FROM mean WHERE arm = 'cand')""",
    "pop": "SELECT mean / sd AS sharpe FROM pm UNION ALL SELECT sharpe FROM lastreg WHERE sharpe NOT IN (SELECT mean / sd FROM pm)",
    "em": f"SELECT n_trials, s * e AS expected_max FROM {emax('(SELECT count(*) AS n_trials, stddev_samp(sharpe) AS s FROM pop)', 'n_trials', 'e')}",
    "dfl": f"SELECT mean / sd AS pooled_sharpe, n_trials, dsr FROM {psr_sql('(SELECT * FROM pm, em)', 'expected_max', 'dsr')}"}


@query("V12_stress_aggregate", sql("""SELECT n_windows, windows_positive, ls_sharpe_worst, ls_sharpe_mean, delta_mean, round(pooled_sharpe, 5) AS pooled_sharpe, n_trials, round(dsr, 5) AS deflated_sharpe
 FROM (SELECT count(*) AS n_windows, count(*) FILTER (ls > 0) AS windows_positive, round(min(ls), 5) AS ls_sharpe_worst, round(avg(ls), 5) AS ls_sharpe_mean, round(avg(d), 5) AS delta_mean FROM lsw JOIN dlt USING (label)), dfl""", "returns", **DEFLATED))
def _(spark, sf):
    """The run's pooled Sharpe goes into a register that holds one trial per order; the last of every customer counts."""
    path = fresh_path(spark, "register")
    one = i.table(spark, sf, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("id"), F.lit("orders").alias("recipe"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("config_hash"),
        ((F.col("o_totalprice") % 1000) / 10000).alias("sharpe"), F.lit("").alias("created"), "o_orderkey")
    append_trial(one, path, order="o_orderkey")
    return i.rounded(stress(spark, sf, register=path, recipe="ridge", config="stress", batch="stress 1")[1], 5)


def recipe_rows():
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"('{n}', {one(r['model'])}, {r['label_horizon']}, {r['purge_days']}, {one(r.get('topk'))}, CAST({one(r.get('vol_target'))} AS DOUBLE))" for n, r in recipes.RECIPES.items())


@query("R1_recipe_table", sql(f"""SELECT recipe, model, label_horizon, purge_days, topk, vol_target, (SELECT count(close) FROM dense) - (SELECT count(DISTINCT instrument) FROM dense) * (label_horizon + 1) AS usable_rows
 FROM (VALUES {recipe_rows()}) t(recipe, model, label_horizon, purge_days, topk, vol_target)""", "dense"))
def _(spark, sf):
    """Recipes joined to the data they run on: how many panel rows each recipe's label horizon leaves usable."""
    usable = i.dense(spark, sf).groupBy("instrument").agg(F.count("close").alias("rows"))
    table = recipes.recipe_table(spark).select("recipe", "model", "label_horizon", "purge_days", "topk", "vol_target")
    total = usable.agg(F.sum("rows"), F.count(F.lit(1)).alias("c")).toDF("rows", "names")
    return table.join(F.broadcast(total)).withColumn("usable_rows", F.col("rows") - F.col("names") * (F.col("label_horizon") + 1)).drop("rows", "names")


@query("R2_recipe_sweep")
def _(spark, sf):
    from panelspark.queries.portfolio_queries import chain_signal

    return recipes.recipe_sweep(settle(i.dense(spark, sf), "dense"), "L1", settle(chain_signal(spark, sf), "chain"))


# Recipes that differ from the first in one knob each: membership, market window, universe, haircut.
FIRST = {
    "weighting": "inverse_vol", "vol_lookback": 10, "regime_mode": "binary", "ma_window": 20, "member_top_n": 5, "member_lookback": 30, "momentum_lookback": 14,
    "momentum_k": 0.5, "crowding_k": 1.0, "oi_lookback": 7, "oi_k": 0.5, "oi_trend_margin": 0.1,
}
VARIANTS = {
    "first": FIRST, "members": {**FIRST, "member_top_n": 3, "member_lookback": 60}, "window": {**FIRST, "ma_window": 40}, "few": {**FIRST, "universe": "few"},
    "hicost": {**FIRST, "haircut": 0.002},
}


def variant_ctes(name: str, top: int, back: int, window: int, names: str) -> dict[str, str]:
    """One recipe's chain from signals to the daily book under names of its own."""
    sched = {n: q.replace("INTERVAL 30 DAY", f"INTERVAL {back} DAY") for n, q in schedule_ctes("bars", top).items()}
    chain = {
        **sched, "trend": f"SELECT date + 1 AS date, close / nullif({rmean('close', window)}, 0) - 1 AS trend FROM dense WHERE instrument = 'L1'",
        "member": f"""SELECT f.*, t.trend FROM (SELECT f.*, (SELECT max(month) FROM months m WHERE m.month <= date_trunc('month', f.date)) AS sm FROM sig f WHERE {names}) f LEFT JOIN trend t USING (date)
 WHERE f.sm IS NULL OR EXISTS (SELECT 1 FROM sched s WHERE s.month = f.sm AND s.instrument = f.instrument)""",
        "iv": inverse_sql("member"), "t1": tilt_sql("iv", "crowding", 1.0, -1, "w0", "w1"), "t2": tilt_sql("t1", "oi_div", 0.5, 1, "w1", "w2", "trend > 0.1"), "t3": tilt_sql("t2", "mom", 0.5, 1, "w2", "w3"),
        "gate1": f"SELECT date, CASE WHEN {rmean('close', window)} IS NULL OR close > {rmean('close', window)} THEN 1.0::DOUBLE ELSE 0.0 END AS exposure FROM dense WHERE instrument = 'L1'",
        "final": "SELECT instrument, date, fwd, w3 * coalesce(exposure, 1) AS weight FROM t3 LEFT JOIN gate1 USING (date) WHERE w3 > 0", **book_ctes("final")}
    own = re.compile(r"\b(" + "|".join(chain) + r")\b(?! *\()")
    return {f"{n}_{name}": own.sub(rf"\1_{name}", q) for n, q in chain.items()}


VARIANT_CTES = VOL | variant_ctes("first", 5, 30, 20, "true") | variant_ctes("members", 3, 60, 20, "true") | variant_ctes("window", 5, 30, 40, "true") | variant_ctes("few", 5, 30, 20, "instrument IN ('L1', 'L2', 'L6')")
RATES = [("first", "first", "0.0006 + 0.00021654821992135172"), ("members", "members", "0.0006 + 0.00021654821992135172"), ("window", "window", "0.0006 + 0.00021654821992135172"),
         ("few", "few", "0.0006 + 0.00021654821992135172"), ("hicost", "first", "0.0006 + 0.002")]


@query("R2_recipe_variants", sql(" UNION ALL ".join(f"SELECT '{n}' AS recipe, date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(turnover * ({r}), 6) AS cost, round(gross - turnover * ({r}), 6) AS ret FROM gr_{c} JOIN chg_{c} USING (date)" for n, c, r in RATES), "returns", **VARIANT_CTES))
def _(spark, sf):
    p = settle(i.returns(spark, sf), "dense")
    few = literal(spark, [("few", x) for x in ("L1", "L2", "L6")], "universe string, instrument string")
    targets = settle(recipes.recipe_sweep(p, "L1", table=VARIANTS, universes=few), "variants")
    return i.rounded(recipes.sweep_returns(targets, p.select("instrument", "date", "fwd"), recipes.cost_rates(spark, list(VARIANTS), VARIANTS)))
