"""Queries of the window and feature operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.layout import settle, trailing
from panelspark.operators import features, windows as wo
from panelspark.operators.panel import with_benchmark
from panelspark.plans import leadlag
from panelspark.queries import inputs as i
from panelspark.queries.registry import csrank, fsum, lagged, over, pct, query, rmean, rstd, rsum, sql, zsql

B = "L1"  # benchmark instrument


def simple(spark, sf, lookback, ahead=0, **cols):
    """Dense panel with extra window columns, rounded: cols map names to functions of the window."""
    body = lambda df, w: df.withColumns({name: make(w) for name, make in cols.items()})
    out = trailing(i.dense(spark, sf), lookback, body, ahead=ahead)
    return i.rounded(out.select("instrument", "date", *cols))


def simple_sql(**cols: str) -> str:
    return sql("SELECT instrument, date, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in cols.items()) + " FROM dense", "dense")


@query("W1_ref", simple_sql(prev_close=lagged("close", 1), prev5=lagged("close", 5), next_close=lagged("close", -1)))
def _(spark, sf):
    return simple(spark, sf, 5, 1, prev_close=lambda w: wo.ref("close", 1, w), prev5=lambda w: wo.ref("close", 5, w), next_close=lambda w: wo.ref("close", -1, w))


@query("W2_roll_mean", simple_sql(ma5=rmean("close", 5), ma20=rmean("close", 20), vma5=rmean("volume", 5)))
def _(spark, sf):
    return simple(spark, sf, 20, ma5=lambda w: wo.roll_mean("close", 5, w), ma20=lambda w: wo.roll_mean("close", 20, w), vma5=lambda w: wo.roll_mean("volume", 5, w))


@query("W3_roll_std", simple_sql(sd5=rstd("close", 5), sd20=rstd("close", 20)))
def _(spark, sf):
    return simple(spark, sf, 20, sd5=lambda w: wo.roll_std("close", 5, w), sd20=lambda w: wo.roll_std("close", 20, w))


@query("W4_zscore", simple_sql(z10=zsql("close", 10), z30=zsql("close", 30)))
def _(spark, sf):
    return simple(spark, sf, 30, z10=lambda w: wo.zscore("close", 10, w), z30=lambda w: wo.zscore("close", 30, w))


@query("W5_cs_rank_pct", sql(f"SELECT instrument, date, round({csrank('close')}, 6) AS rank_close, round({csrank('trades')}, 6) AS rank_trades FROM names", "names"))
def _(spark, sf):
    out = wo.cs_rank_pct(i.names(spark, sf).select("instrument", "date", "close", "trades"), {"rank_close": "close", "rank_trades": "trades"})
    return i.rounded(out.select("instrument", "date", "rank_close", "rank_trades"))


BENCH = {"bench": f"SELECT d.instrument, d.date, d.close, b.close AS bench FROM dense d LEFT JOIN (SELECT date, close FROM dense WHERE instrument = '{B}') b USING (date)"}
BRET = BENCH | {"bret": f"SELECT *, {pct('close', 1)} AS ret, {pct('bench', 1)} AS br, ln(close) - ln(bench) AS spread FROM bench",
                "blag": "SELECT *, " + ", ".join(f"{lagged('br', n)} AS br{n}" for n in (1, 2, 3)) + " FROM bret"}
own = lambda v, e: f"CASE WHEN instrument = '{B}' THEN {v} ELSE {e} END"


def both(x, y, n):
    return f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {over(n)} = {n}"


def beta_sql(n):
    return f"CASE WHEN {both('ret', 'br', n)} AND count(br) {over(n)} = {n} THEN covar_samp(ret, br) {over(n)} / nullif(var_samp(br) {over(n)}, 0) END"


def corr_sql(x, y, n):
    return f"CASE WHEN {both(x, y, n)} AND var_samp({x}) {over(n)} > 0 AND var_samp({y}) {over(n)} > 0 THEN corr({x}, {y}) {over(n)} END"


def bench_panel(spark, sf, reach, body):
    return trailing(with_benchmark(i.dense(spark, sf).select("instrument", "date", "close"), B), reach, body)


@query("W6_rel_strength", sql(f"SELECT instrument, date, round({own('0.0', pct('close', 5) + ' - ' + pct('bench', 5))}, 6) AS rs_5 FROM bench", "dense", **BENCH))
def _(spark, sf):
    mine = F.col("instrument") == B
    body = lambda df, w: df.withColumn("rs_5", F.when(mine, 0.0).otherwise(wo.momentum("close", 5, w) - wo.momentum("bench", 5, w)))
    return i.rounded(bench_panel(spark, sf, 5, body).select("instrument", "date", "rs_5"))


@query("W7_roll_beta", sql(f"SELECT instrument, date, round({own('1.0', beta_sql(20))}, 6) AS beta_20 FROM bret", "dense", **BRET))
def _(spark, sf):
    mine = F.col("instrument") == B

    def body(df, w):
        df = df.withColumns({"ret": wo.momentum("close", 1, w), "br": wo.momentum("bench", 1, w)})
        return df.withColumn("beta_20", F.when(mine, 1.0).otherwise(wo.roll_beta("ret", "br", 20, w)))

    return i.rounded(bench_panel(spark, sf, 22, body).select("instrument", "date", "beta_20"))


@query("W8_roll_leadlag_corr", sql(f"SELECT instrument, date, round({own('NULL', corr_sql('ret', 'br1', 20))}, 6) AS leadlag_1 FROM blag", "dense", **BRET))
def _(spark, sf):
    def body(df, w):
        df = df.withColumns({"ret": wo.momentum("close", 1, w), "br": wo.momentum("bench", 1, w)}).withColumn("br1", wo.ref("br", 1, w))
        return df.withColumn("leadlag_1", F.when(F.col("instrument") != B, wo.roll_corr("ret", "br1", 20, w)))

    return i.rounded(bench_panel(spark, sf, 23, body).select("instrument", "date", "leadlag_1"))


@query("W9_coint_z", sql(f"SELECT instrument, date, round({own('0.0', zsql('spread', 30))}, 6) AS coint_z FROM bret", "dense", **BRET))
def _(spark, sf):
    def body(df, w):
        df = df.withColumn("spread", F.ln("close") - F.ln("bench"))
        return df.withColumn("coint_z", F.when(F.col("instrument") == B, 0.0).otherwise(wo.zscore("spread", 30, w)))

    return i.rounded(bench_panel(spark, sf, 30, body).select("instrument", "date", "coint_z"))


@query("W10_cs_momentum_vol", sql(
    f"SELECT instrument, date, round({csrank('mom')}, 6) AS csrank_mom, round({csrank('vol')}, 6) AS csrank_vol FROM mv", "dense", **(
        BRET | {"mv": f"SELECT instrument, date, {pct('close', 20)} AS mom, {rstd('ret', 20)} AS vol FROM bret"})))
def _(spark, sf):
    def body(df, w):
        df = df.withColumn("ret", wo.momentum("close", 1, w))
        return df.withColumns({"mom": wo.momentum("close", 20, w), "vol": wo.roll_std("ret", 20, w)})

    mv = trailing(i.dense(spark, sf).select("instrument", "date", "close"), 22, body).select("instrument", "date", "mom", "vol")
    return i.rounded(wo.cs_rank_pct(mv, {"csrank_mom": "mom", "csrank_vol": "vol"}).drop("mom", "vol"))


CROSS_COLS = (
    [f"round({own('0.0', pct('close', n) + ' - ' + pct('bench', n))}, 6) AS rs_{n}" for n in (5, 20)]
    + [f"round({own('1.0', beta_sql(n))}, 6) AS beta_{n}" for n in (20, 60)]
    + [f"round({own('NULL', corr_sql('ret', f'br{n}', 60))}, 6) AS leadlag_{n}" for n in (1, 2, 3)]
    + [f"round({own('0.0', zsql('spread', 60))}, 6) AS coint_z", f"{pct('close', 20)} AS mom", f"{rstd('ret', 20)} AS vol"]
)


@query("W11_cross_asset_features", sql(
    f"SELECT * EXCLUDE (mom, vol), round({csrank('mom')}, 6) AS csrank_mom, round({csrank('vol')}, 6) AS csrank_vol FROM feats", "dense",
    **(BRET | {"feats": "SELECT instrument, date, " + ", ".join(CROSS_COLS) + " FROM blag"})))
def _(spark, sf):
    return i.rounded(features.cross_asset_features(i.dense(spark, sf), B))


@query("W12_funding_features", simple_sql(
    funding_level="funding", funding_z=zsql("funding", 30), funding_ma=rmean("funding", 7), funding_chg=f"funding - {lagged('funding', 7)}", funding_csrank=csrank("funding")))
def _(spark, sf):
    return i.rounded(features.funding_features(i.dense(spark, sf)))


DERIV = {}
for _f in ("oi", "oi_value", "ls_top", "ls_global", "taker_ratio", "basis"):
    DERIV |= {f"{_f}_level": _f, f"{_f}_change": pct(_f, 5), f"{_f}_z": zsql(_f, 30), f"{_f}_csrank": csrank(_f)}
DERIV |= {"oi_confirm": f"sign({pct('close', 5)}) * {pct('oi', 5)}", "smart_div": "ls_top / nullif(ls_global, 0)"}


@query("W13_derivatives_features", simple_sql(**DERIV))
def _(spark, sf):
    return i.rounded(features.derivatives_features(i.dense(spark, sf)))


@query("W14_forward_sum", simple_sql(fwd3=fsum("volume", 3)))
def _(spark, sf):
    return simple(spark, sf, 0, 3, fwd3=lambda w: wo.forward_sum("volume", 3, w))


@query("W15_equity_curve", sql(
    """SELECT trial, date, round(1000 * product(1 + ret) OVER w, 4) AS gross, round(1000 * product(1 + ret - 0.001) OVER w, 4) AS net
 FROM scaled WINDOW w AS (PARTITION BY trial ORDER BY date)""", "trials", scaled="SELECT trial, date, ret / 50 AS ret FROM trials"))
def _(spark, sf):
    t = i.trials(spark, sf).withColumns({"ret": F.col("ret") / 50, "cost": F.lit(0.001)})
    curve = wo.equity_curve(wo.equity_curve(t, "ret", ["trial"], 1000.0, "gross"), "ret", ["trial"], 1000.0, "net", cost="cost")
    return i.rounded(curve.select("trial", "date", "gross", "net"), 4)


@query("W16_drawdown", sql(
    """SELECT trial, date, round(equity / max(equity) OVER w - 1, 6) AS drawdown FROM (SELECT trial, date, product(1 + ret / 50) OVER
 (PARTITION BY trial ORDER BY date) AS equity FROM trials) WINDOW w AS (PARTITION BY trial ORDER BY date)""", "trials"))
def _(spark, sf):
    t = i.trials(spark, sf).withColumn("ret", F.col("ret") / 50)
    curve = wo.drawdown(wo.equity_curve(t, "ret", ["trial"]), keys=["trial"])
    return i.rounded(curve.select("trial", "date", "drawdown"))


@query("W17_rebase", sql(
    """SELECT instrument, date, round(close / first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, 6) AS rebased FROM dense""", "dense"))
def _(spark, sf):
    return i.rounded(wo.rebase(i.dense(spark, sf)).select("instrument", "date", "rebased"))


@query("W18_gap_islands", sql(
    """SELECT instrument, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM (
 SELECT instrument, date, date - CAST(row_number() OVER (PARTITION BY instrument ORDER BY date) AS INTEGER) AS g FROM names) GROUP BY instrument, g""", "names"))
def _(spark, sf):
    return wo.gap_islands(i.names(spark, sf))


GATE = {"gate": f"""SELECT instrument, date, CASE WHEN {rmean('close', 20)} IS NOT NULL THEN
 CASE WHEN close > {rmean('close', 20)} THEN 1.0::DOUBLE ELSE 0.0 END END AS raw FROM dense"""}
# The state machine written differently: a flip candidate is a day whose last 3 warm days agree.
HELD = GATE | {
    "warm": "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS k FROM gate WHERE raw IS NOT NULL",
    "agree": """SELECT *, CASE WHEN k >= 3 AND min(raw) OVER w = max(raw) OVER w THEN raw END AS sure, first_value(raw) OVER (PARTITION BY instrument ORDER BY date) AS seed
 FROM warm WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "held": "SELECT instrument, date, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date), seed) AS held FROM agree",
}


@query("W19_debounce", sql("SELECT instrument, date, raw, held FROM gate LEFT JOIN held USING (instrument, date)", "dense", **HELD))
def _(spark, sf):
    def body(df, w):
        sma = wo.roll_mean("close", 20, w)
        return df.withColumn("raw", F.when(sma.isNotNull(), F.coalesce((F.col("close") > sma).cast("double"), F.lit(0.0))))

    gate = trailing(i.dense(spark, sf), 20, body).select("instrument", "date", "raw")
    return wo.debounce(gate, "raw", 3, ["instrument"], "held")


SCALE = f"least(coalesce(12.0 / nullif({rstd('ret', 10)} * sqrt(365.0), 0), 1.0), 1.0)"


def exposure_sql(body: str, **more):
    return sql(body, "returns", **(HELD | more))


@query("W20_regime_exposure", exposure_sql(
    f"""SELECT 'binary' AS mode, instrument, date, round(coalesce(raw, 1.0), 6) AS exposure FROM gate
 UNION ALL SELECT 'confirmed', instrument, date, round(coalesce(held, 1.0), 6) FROM gate LEFT JOIN held USING (instrument, date)
 UNION ALL SELECT 'graded', instrument, date, CASE WHEN {rmean('close', 20)} IS NULL THEN 1.0 WHEN close > {rmean('close', 20)} * 1.05 THEN 1.0
  WHEN close < {rmean('close', 20)} * 0.95 THEN 0.0 ELSE 0.5 END FROM dense
 UNION ALL SELECT 'cross', instrument, date, CASE WHEN {rmean('close', 20)} IS NULL OR {rmean('close', 5)} IS NULL THEN 1.0
  WHEN {rmean('close', 5)} > {rmean('close', 20)} THEN 1.0 ELSE 0.0 END FROM dense
 UNION ALL SELECT 'vol_target', instrument, date, round(coalesce(raw, 1.0) * scale, 6) FROM gate JOIN scaled USING (instrument, date)""",
    scaled=f"SELECT instrument, date, {SCALE} AS scale FROM returns"))
def _(spark, sf):
    close = settle(i.dense(spark, sf).select("instrument", "date", "close"), "close")
    kinds = {
        "binary": {}, "confirmed": {"confirm": 3}, "graded": {"mode": "graded", "band": 0.05}, "cross": {"mode": "cross", "ma_fast": 5},
        "vol_target": {"vol_target": 12.0, "vol_lookback": 10},
    }
    out = None
    for name, options in kinds.items():
        part = wo.regime_exposure(close, ma_window=20, **options).withColumn("mode", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return i.rounded(out.select("mode", "instrument", "date", "exposure"))


HOURLY_R = {
    "grid": "SELECT s.symbol, t.ts, t.step FROM (SELECT DISTINCT symbol FROM hourly) s, (SELECT ts, row_number() OVER (ORDER BY ts) AS step FROM (SELECT DISTINCT ts FROM hourly)) t",
    "hr": f"SELECT symbol, ts, step, ln(close) - {lagged('ln(close)', 1, part='symbol', order='step')} AS r FROM grid LEFT JOIN hourly USING (symbol, ts)",
}


def sums_sql(ks, hs):
    k = dict(part="symbol", order="step")
    return "SELECT symbol, ts, step, " + ", ".join([f"{rsum('r', n, **k)} AS past_{n}" for n in ks] + [f"{fsum('r', n, **k)} AS fwd_{n}" for n in hs]) + " FROM hr"


@query("W22_rolling_ic", sql(
    f"SELECT ts, round(ic, 6) AS ic, round({rmean('ic', 48, part='', order='ts')}, 6) AS rolling_ic FROM ic", "hourly", **(
        HOURLY_R | {"sums": sums_sql([1], [2]),
        "ic": """SELECT a.ts, sum(sign(p.past_1) * a.fwd_2) / (SELECT count(DISTINCT symbol) FROM hr WHERE symbol <> 'view') AS ic FROM sums a
 JOIN sums p ON a.step = p.step AND p.symbol = 'view' WHERE a.symbol <> 'view' AND p.past_1 IS NOT NULL AND a.fwd_2 IS NOT NULL GROUP BY a.ts"""})))
def _(spark, sf):
    panel = leadlag.hourly_returns(i.hourly(spark, sf))
    return i.rounded(leadlag.rolling_ic(panel, "view", 1, 2, 48)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("W23_pct_above_sma", simple_sql(above=f"close / nullif({rmean('close', 20)}, 0) - 1"))
def _(spark, sf):
    return simple(spark, sf, 20, above=lambda w: wo.pct_above_sma("close", 20, w))


@query("W24_momentum_oi_divergence", simple_sql(
    mom=pct("close", 14), oi_div=f"sign({pct('close', 14)}) * {pct('oi', 14)}", oi_dir=f"CASE WHEN {pct('close', 14)} > 0 THEN {pct('oi', 14)} END"))
def _(spark, sf):
    return simple(
        spark, sf, 14, mom=lambda w: wo.momentum("close", 14, w), oi_div=lambda w: wo.oi_divergence("close", "oi", 14, w),
        oi_dir=lambda w: wo.oi_divergence("close", "oi", 14, w, True),
    )
