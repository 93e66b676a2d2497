"""Queries of the portfolio operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.layout import settle, trailing
from panelspark.operators import joins, portfolio as pf, stats, windows as wo
from panelspark.queries import inputs as i
from panelspark.queries.registry import lagged, over, pct, query, rmean, rstd, sql, zsql
from panelspark.queries.table_queries import POSITIONS, positions
from panelspark.queries.window_queries import GATE, HELD

VOL = {
    "sig0": f"""SELECT instrument, date, close, fwd, {rstd('ret', 10)} AS vol0, basis AS cr0, {pct('close', 14)} AS mom0, sign({pct('close', 7)}) * {pct('oi', 7)} AS oi0,
 ls_top / nullif(ls_global, 0) AS sm0 FROM returns""",
    "sig": "SELECT instrument, date, close, fwd, " + ", ".join(f"{lagged(a, 1)} AS {b}" for a, b in (("vol0", "vol"), ("cr0", "crowding"), ("mom0", "mom"), ("oi0", "oi_div"), ("sm0", "smart"))) + " FROM sig0",
}


def inverse_sql(src):
    good = "CASE WHEN vol > 0 THEN 1 / vol END"
    return f"""SELECT *, CASE WHEN sum({good}) OVER (PARTITION BY date) IS NULL THEN 1.0 / count(*) OVER (PARTITION BY date)
 ELSE coalesce({good}, 0) / sum({good}) OVER (PARTITION BY date) END AS w0 FROM {src}"""


def tilt_sql(src, signal, k, sign, w, out, active="TRUE"):
    m = f"PARTITION BY date"
    use = f"(count({signal}) OVER ({m}) >= 2 AND stddev_pop({signal}) OVER ({m}) > 0 AND coalesce({active}, FALSE))"
    raised = f"""SELECT *, {use} AS use_{out}, {w} * CASE WHEN {use} THEN coalesce(exp({sign} * {k} * ({signal} - avg({signal}) OVER ({m})) / nullif(stddev_pop({signal}) OVER ({m}), 0)), 1) ELSE 1 END AS t_{out} FROM {src}"""
    return f"SELECT *, CASE WHEN use_{out} AND sum(t_{out}) OVER ({m}) > 0 THEN t_{out} / sum(t_{out}) OVER ({m}) ELSE t_{out} END AS {out} FROM ({raised})"


def signals(spark, sf):
    return pf.strategy_signals(i.returns(spark, sf), vol_lookback=10, momentum_lookback=14, oi_lookback=7)


@query("F1_inverse_vol_weights", sql("SELECT instrument, date, round(w0, 6) AS weight FROM iv", "returns", **VOL, iv=inverse_sql("sig")))
def _(spark, sf):
    return i.rounded(pf.inverse_vol_weights(signals(spark, sf)).select("instrument", "date", "weight"))


@query("F2_tilt", sql("SELECT instrument, date, round(w1, 6) AS weight FROM tilted", "returns", **VOL, iv=inverse_sql("sig"), tilted=tilt_sql("iv", "mom", 0.8, 1, "w0", "w1")))
def _(spark, sf):
    w = pf.tilt(pf.inverse_vol_weights(signals(spark, sf)), "mom", 0.8, +1)
    return i.rounded(w.select("instrument", "date", "weight"))


KEEP = f"(date - (SELECT min(date) FROM dense) + 1 < 15 OR coalesce(close > {rmean('close', 15)}, FALSE))"


@query("F3_trend_filter", sql(f"SELECT instrument, date, round(close, 6) AS close FROM (SELECT *, {KEEP} AS keep FROM dense) WHERE keep", "dense"))
def _(spark, sf):
    return i.rounded(pf.trend_filter(i.dense(spark, sf), 15).select("instrument", "date", "close"))


SCHED = {
    "months": "SELECT CAST(month AS DATE) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS month, min(date) AS lo FROM {p}) WHERE month >= lo",
    "sched": """SELECT month, instrument FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, instrument) AS rank
 FROM (SELECT m.month, n.instrument, avg(n.amount) AS score FROM months m JOIN {p} n ON n.date <= m.month AND n.date > m.month - INTERVAL 30 DAY GROUP BY ALL)) WHERE rank <= {k}"""}


def schedule_ctes(panel, k):
    return {n: t.replace("{p}", panel).replace("{k}", str(k)) for n, t in SCHED.items()}


@query("F4_membership_filter", sql("""SELECT l.instrument, l.date FROM (SELECT n.instrument, n.date, max(m.month) AS sm FROM names n LEFT JOIN months m ON m.month <= date_trunc('month', n.date) GROUP BY ALL) l
 WHERE l.sm IS NULL OR EXISTS (SELECT 1 FROM sched s WHERE s.month = l.sm AND s.instrument = l.instrument)""", "names", **schedule_ctes("names", 20)))
def _(spark, sf):
    n = i.names(spark, sf)
    return pf.membership_filter(n.select("instrument", "date"), n, 20, 30)


FROTH = {
    "med": "SELECT date, quantile_cont(basis, 0.5) AS median FROM dense GROUP BY date",
    "froth": f"SELECT date, {zsql('median', 30, part='')} AS z FROM med",
    "chain": f"SELECT date, {zsql('nvm', 40, part='')} AS z FROM (SELECT date, ln(amount / (volume * volume)) AS nvm FROM dense WHERE instrument = 'L2')",
    "expo": "SELECT date, coalesce(raw, 1.0) AS exposure FROM gate WHERE instrument = 'L1'"}


def gate_l1(spark, sf):
    close = i.dense(spark, sf).filter("instrument = 'L1'").select("instrument", "date", "close")
    return wo.regime_exposure(close, ma_window=20).select("date", "exposure")


def chain_signal(spark, sf):
    from panelspark.functions.scalar import nvm

    one = i.dense(spark, sf).filter("instrument = 'L2'").select("instrument", "date", nvm("amount", "volume").alias("nvm"))
    return trailing(one, 40, lambda df, w: df.withColumn("z", wo.zscore("nvm", 40, w))).select("date", "z")


SOME_DAYS = "((date - DATE '1990-01-01') % 7) IN (0, 2)"


def some_days(df):
    return df.filter(F.pmod(F.datediff("date", F.lit("1990-01-01").cast("date")), F.lit(7)).isin(0, 2))


@query("F5_froth_onchain_overlays", sql(
    """SELECT e.date, round(e.exposure * CASE WHEN f.z > 0.8 THEN 0.5 ELSE 1 END * CASE WHEN c.z > 0.5 THEN 0.25 ELSE 1 END, 6) AS exposure FROM expo e
 ASOF LEFT JOIN f ON e.date >= f.date ASOF LEFT JOIN c ON e.date > c.date""", "dense", **GATE, **FROTH,
    f=f"SELECT * FROM froth WHERE {SOME_DAYS}", c=f"SELECT * FROM chain WHERE {SOME_DAYS}"))
def _(spark, sf):
    """Signals that lack most days, so that values are carried over gaps."""
    e = pf.derisk(gate_l1(spark, sf), some_days(pf.froth_signal(i.dense(spark, sf), "basis", 30)), 0.8, 0.5, strict=False)
    return i.rounded(pf.derisk(e, some_days(chain_signal(spark, sf)), 0.5, 0.25, strict=True))


TREND = {"trend": f"SELECT date + 1 AS date, close / nullif({rmean('close', 20)}, 0) - 1 AS trend FROM dense WHERE instrument = 'L1'",
         "sigt": "SELECT s.*, t.trend FROM sig s LEFT JOIN trend t USING (date)"}


@query("F6_tilt_chain", sql("SELECT instrument, date, round(w4, 6) AS weight FROM t4 WHERE w4 > 0", "returns", **VOL, **TREND, iv=inverse_sql("sigt"),
    t1=tilt_sql("iv", "crowding", 1.0, -1, "w0", "w1"), t2=tilt_sql("t1", "oi_div", 0.5, 1, "w1", "w2", "trend > 0.1"),
    t3=tilt_sql("t2", "smart", 0.7, 1, "w2", "w3"), t4=tilt_sql("t3", "mom", 1.0, 1, "w3", "w4")))
def _(spark, sf):
    s = signals(spark, sf).join(pf.strong_trend(i.dense(spark, sf), "L1", 20), "date", "left")
    w = pf.target_weights(s, crowding_k=1.0, oi_k=0.5, smart_k=0.7, momentum_k=1.0, oi_active=F.col("trend") > 0.1)
    return i.rounded(w.select("instrument", "date", "weight"))


FULL = VOL | {
    "filtered": f"SELECT *, (date - (SELECT min(date) FROM dense) + 1 < 15 OR coalesce(close > {rmean('close', 15)}, FALSE)) AS keep FROM sig",
    **schedule_ctes("bars", 5),
    "member": """SELECT f.* FROM (SELECT f.*, (SELECT max(month) FROM months m WHERE m.month <= date_trunc('month', f.date)) AS sm FROM filtered f WHERE keep) f
 WHERE f.sm IS NULL OR EXISTS (SELECT 1 FROM sched s WHERE s.month = f.sm AND s.instrument = f.instrument)""",
    "iv": inverse_sql("member"), "t1": tilt_sql("iv", "crowding", 1.0, -1, "w0", "w1"), "t2": tilt_sql("t1", "mom", 0.5, 1, "w1", "w2"),
    "final": "SELECT instrument, date, fwd, w2 AS weight FROM t2 WHERE w2 > 0"}


def weights(spark, sf):
    s = pf.trend_filter(settle(signals(spark, sf), "signals"), 15)
    s = pf.membership_filter(s, i.bars(spark, sf), 5, 30)
    return pf.target_weights(s, crowding_k=1.0, momentum_k=0.5)


@query("F7_target_weights", sql("SELECT instrument, date, round(weight, 6) AS weight FROM final", "returns", **FULL))
def _(spark, sf):
    return i.rounded(weights(spark, sf).select("instrument", "date", "weight"))


@query("F8_apply_exposure", sql("SELECT instrument, w.date, round(weight * 0.95 * coalesce(e.exposure, 1), 6) AS target FROM (SELECT instrument, date, w0 AS weight FROM iv) w ASOF LEFT JOIN e ON w.date >= e.date", "returns",
    **VOL, iv=inverse_sql("sig"), **GATE, expo=FROTH["expo"], e=f"SELECT date, exposure FROM expo WHERE {SOME_DAYS}"))
def _(spark, sf):
    w = pf.inverse_vol_weights(signals(spark, sf))
    return i.rounded(pf.apply_exposure(w, some_days(gate_l1(spark, sf))).select("instrument", "date", "target"))


@query("F9_cost_model", sql("""SELECT t.date, t.symbol, t.side, round((0.0006 + 0.00021654821992135172 + 85.14243442280177 * (t.value / 1000 / b.amount) * (t.value / 1000 / b.amount)) * t.value / 1000, 6) AS cost
 FROM tr t JOIN bars b ON b.instrument = t.symbol AND b.date = t.date""", "bars", **POSITIONS))
def _(spark, sf):
    t = joins.position_diff(positions(spark, sf)).withColumn("value", F.col("value") / 1000)
    b = i.bars(spark, sf).select(F.col("instrument").alias("symbol"), "date", "amount")
    return i.rounded(pf.cost_model(t.join(b, ["symbol", "date"])).select("date", "symbol", "side", "cost"))


BOOK = {
    "days": "SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM {w})",
    "chg": """SELECT d.date, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS turnover FROM days d CROSS JOIN (SELECT DISTINCT instrument FROM {w}) x
 LEFT JOIN {w} a ON a.date = d.date AND a.instrument = x.instrument LEFT JOIN {w} b ON b.date = d.prev AND b.instrument = x.instrument GROUP BY d.date""",
    "gr": "SELECT date, sum(weight * coalesce(fwd, 0)) AS gross FROM {w} GROUP BY date"}


def book_ctes(w):
    return {n: t.replace("{w}", w) for n, t in BOOK.items()}


@query("F10_portfolio_returns", sql("SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(0.001 * turnover, 6) AS cost, round(gross - 0.001 * turnover, 6) AS ret FROM gr JOIN chg USING (date)", "returns",
    **VOL, iv=inverse_sql("sig"), wts="SELECT instrument, date, fwd, w0 AS weight FROM iv", **book_ctes("wts")))
def _(spark, sf):
    w = pf.inverse_vol_weights(signals(spark, sf)).select("instrument", "date", "weight")
    r = i.returns(spark, sf)
    return i.rounded(pf.portfolio_returns(w, r.select("instrument", "date", "fwd"), r.select("date"), 0.001))


LS = {
    "usable": f"SELECT instrument, date, {pct('close', 5)} AS score, fwd / 1000 AS fwd FROM returns QUALIFY score IS NOT NULL AND fwd IS NOT NULL",
    "ranked": """SELECT *, least(2, count(*) OVER (PARTITION BY date) // 2) AS k, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument DESC) AS rd,
 row_number() OVER (PARTITION BY date ORDER BY score, instrument) AS ra FROM usable""",
    "legs": "SELECT date, instrument, fwd, k, 'long' AS leg FROM ranked WHERE rd <= k UNION ALL SELECT date, instrument, fwd, k, 'short' FROM ranked WHERE ra <= k",
    "steps": "SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM usable)",
    "ent": "SELECT s.date, count(l.instrument) AS entries FROM steps s LEFT JOIN legs l ON l.date = s.date AND NOT EXISTS (SELECT 1 FROM legs p WHERE p.date = s.prev AND p.leg = l.leg AND p.instrument = l.instrument) GROUP BY s.date",
    "ls": """SELECT e.date, coalesce(x.k, 0) AS k, entries, coalesce(x.spread - 0.001 * entries / x.k, 0) AS ret FROM ent e
 LEFT JOIN (SELECT date, max(k) AS k, avg(fwd) FILTER (leg = 'long') - avg(fwd) FILTER (leg = 'short') AS spread FROM legs GROUP BY date) x USING (date)"""}


def ls_rows(spark, sf):
    body = lambda df, w: df.withColumn("score", wo.momentum("close", 5, w))
    return trailing(i.returns(spark, sf), 5, body).select("instrument", "date", "score", (F.col("fwd") / 1000).alias("fwd"))


@query("F11_long_short_spread", sql("SELECT date, k, entries, round(ret, 6) AS ret FROM ls", "returns", **LS))
def _(spark, sf):
    return i.rounded(pf.long_short_spread(ls_rows(spark, sf), 2, 0.001))


@query("F11_long_short_summary", sql("SELECT round(avg(ret) / stddev_samp(ret) * sqrt(365), 6) AS sharpe, round(sum(ln(1 + ret)), 6) AS log_ending FROM ls", "returns", **LS))
def _(spark, sf):
    d = pf.long_short_spread(ls_rows(spark, sf), 2, 0.001)
    return i.rounded(d.agg((stats.sharpe("ret") * F.sqrt(F.lit(365.0))).alias("sharpe"), F.sum(F.ln(1 + F.col("ret"))).alias("log_ending")))


@query("F13_topk_members", sql("SELECT instrument, date, CAST(rank AS INTEGER) AS rank, round(1.0 / least(4, n), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, instrument) AS rank, count(*) OVER (PARTITION BY date) AS n FROM names) WHERE rank <= 4", "names"))
def _(spark, sf):
    scored = i.names(spark, sf).select("instrument", "date", F.col("close").alias("score"))
    return i.rounded(pf.topk_members(scored, 4).select("instrument", "date", "rank", "weight"))
