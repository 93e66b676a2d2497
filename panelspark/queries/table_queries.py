"""Queries of projections, joins, set operations, ordering and dataset maintenance."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as sc
from panelspark.layout import settle, trailing
from panelspark.operators import asof, joins, panel as pn, quality, ranking, windows as wo
from panelspark.plans import leadlag, recipes
from panelspark.queries import inputs as i
from panelspark.queries.registry import cdf, lagged, over, pct, query, rmean, sql, with_ppf, zsql
from panelspark.sources import archives, parameters, tables

D = lambda text: F.lit(text).cast("date")


def literal(spark, rows, schema):
    """A hand-written parameter table."""
    return spark.createDataFrame(rows, schema)


# ---- projections -----------------------------------------------------------------------------------------------

@query("P1_epoch_to_ts", """SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS date FROM events""")
def _(spark, sf):
    """Epochs of mixed units, per row: s, ms, us or ns by event id."""
    e = i.events(spark, sf)
    micros = F.unix_micros("ts")
    unit = F.pmod("event_id", F.lit(4))
    epoch = (
        F.when(unit == 0, F.floor(micros / 1_000_000)).when(unit == 1, F.floor(micros / 1000)).when(unit == 2, micros).otherwise(micros * 1000)
    ).cast("long")
    return e.select("event_id", sc.epoch_to_ts(epoch).cast("timestamp_ntz").alias("ts"), sc.epoch_to_date(epoch).alias("date"))


@query("P2_vwap", sql("SELECT instrument, date, round(coalesce(amount / nullif(volume, 0), close), 6) AS vwap FROM names", "names"))
def _(spark, sf):
    return i.rounded(i.names(spark, sf).select("instrument", "date", sc.vwap("amount", "volume", "close").alias("vwap")))


MAPPING = [("L1", "1000L1", None, None), ("L2", "OLD2", None, "1998-06-30"), ("L2", "L2", "1998-07-03", None)]
MAPPING_SCHEMA = "instrument string, perp string, valid_from string, valid_to string"


def mapping(spark, rows=MAPPING):
    m = literal(spark, rows, MAPPING_SCHEMA)
    return m.withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})


@query("P3_perp_symbol", sql("""SELECT instrument, date, CASE WHEN instrument = 'L1' THEN '1000L1' WHEN instrument <> 'L2' THEN instrument
 WHEN date <= DATE '1998-06-30' THEN 'OLD2' WHEN date >= DATE '1998-07-03' THEN 'L2' END AS perp_symbol FROM dense""", "dense"))
def _(spark, sf):
    return joins.perp_symbols(i.dense(spark, sf).select("instrument", "date"), mapping(spark))


NAMED = {"named": """SELECT CASE instrument WHEN 'L1' THEN 'PEPEUSDT' WHEN 'L2' THEN 'POLUSDT' ELSE instrument || 'USDT' END AS instrument, CAST(date + INTERVAL 27 YEAR AS DATE) AS date
 FROM dense WHERE NOT (month(date) = 2 AND day(date) = 29)"""}


@query("P3_shipped_mapping", sql("""SELECT instrument, date, CASE WHEN instrument = 'PEPEUSDT' THEN '1000PEPEUSDT' WHEN instrument <> 'POLUSDT' THEN instrument
 WHEN date <= DATE '2024-09-10' THEN 'MATICUSDT' WHEN date >= DATE '2024-09-13' THEN 'POLUSDT' END AS perp_symbol FROM named""", "dense", **NAMED))
def _(spark, sf):
    """The shipped mapping on the panel moved to the years of the renaming."""
    name = F.when(F.col("instrument") == "L1", "PEPEUSDT").when(F.col("instrument") == "L2", "POLUSDT").otherwise(F.concat("instrument", F.lit("USDT")))
    moved = i.dense(spark, sf).filter(~((F.month("date") == 2) & (F.dayofmonth("date") == 29))).select(name.alias("instrument"), F.add_months("date", 27 * 12).alias("date"))
    return joins.perp_symbols(moved, parameters.perp_mapping(spark))


@query("P4_with_pit_universe", """SELECT instrument, min(position) AS position FROM (SELECT 'S' || s_suppkey AS instrument, CAST(s_suppkey + 1 AS INTEGER) AS position FROM supplier
 UNION ALL SELECT s, CAST(k + (SELECT max(s_suppkey) + 1 FROM supplier) AS INTEGER) FROM (VALUES """
    + ", ".join(f"('{s}', {k + 1})" for k, s in enumerate(recipes.PIT_ADDITIONS)) + ") t(s, k)) GROUP BY instrument")
def _(spark, sf):
    s = i.table(spark, sf, "supplier")
    return recipes.with_pit_universe(
        s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument"), (F.col("s_suppkey") + 1).cast("int").alias("position")))


@query("P5_slice_dates", sql("SELECT instrument, date, round(close, 6) AS close FROM names WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'", "names"))
def _(spark, sf):
    return i.rounded(pn.slice_dates(i.names(spark, sf), "1997-01-01", "1999-06-30").select("instrument", "date", "close"))


@query("P6_validate_symbols", """SELECT 'Brand ' || p_brand AS symbol, max(p_type) AS base, 'USD' AS quote, CASE WHEN p_brand LIKE '%1' THEN 'HALTED' ELSE 'TRADING' END AS status,
 true AS known FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'Nation ' || n_name, NULL, NULL, NULL, false FROM nation""")
def _(spark, sf):
    brands = i.table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_type").alias("base")).select(
        F.concat(F.lit("Brand "), "p_brand").alias("symbol"), "base", F.lit("USD").alias("quote"), F.when(F.col("p_brand").like("%1"), "HALTED").alias("status")
    )
    others = i.table(spark, sf, "nation").select(F.concat(F.lit("Nation "), "n_name").alias("symbol"))
    return tables.validate_symbols(brands.select("symbol").unionByName(others), brands)


@query("P7_finite_or_null", """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS clean FROM events""")
def _(spark, sf):
    broken = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(float("inf"))).when(F.pmod("event_id", F.lit(7)) == 1, F.lit(float("-inf"))).when(
        F.pmod("event_id", F.lit(7)) == 2, F.lit(float("nan"))).otherwise(F.col("value"))
    return i.table(spark, sf, "events").select("event_id", sc.finite(broken).alias("clean"))


@query("P8_log_and_pct_return", sql(f"SELECT instrument, date, round(ln(close) - {lagged('ln(close)', 1)}, 6) AS log_ret, round({pct('close', 1)}, 6) AS pct_ret FROM dense", "dense"))
def _(spark, sf):
    body = lambda df, w: df.withColumns({"log_ret": wo.log_return("close", w), "pct_ret": wo.momentum("close", 1, w)})
    return i.rounded(trailing(i.dense(spark, sf), 1, body).select("instrument", "date", "log_ret", "pct_ret"))


@query("P9_nvm", """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey <> 0 THEN round(ln(c_acctbal / (c_nationkey * c_nationkey)), 6) END AS nvm FROM customer""")
def _(spark, sf):
    c = i.table(spark, sf, "customer")
    return i.rounded(c.select("c_custkey", sc.nvm("c_acctbal", F.col("c_nationkey").cast("double")).alias("nvm")))


@query("P10_forward_label", sql("SELECT instrument, date, " + ", ".join(
    f"round({lagged('close', -(h + 1))} / {lagged('close', -1)} - 1, 6) AS label_{h}" for h in (1, 5, 10, 20)) + " FROM dense", "dense"))
def _(spark, sf):
    body = lambda df, w: df.withColumns({f"label_{h}": wo.forward_label("close", h, w) for h in (1, 5, 10, 20)})
    return i.rounded(trailing(i.dense(spark, sf), 0, body, ahead=21).select("instrument", "date", *[f"label_{h}" for h in (1, 5, 10, 20)]))


@query("P11_fwd_return_1d", sql("SELECT instrument, date, round(fwd, 6) AS fwd FROM returns", "returns"))
def _(spark, sf):
    return i.rounded(i.returns(spark, sf).select("instrument", "date", "fwd"))


@query("P12_dropna_label_fillna_feature", sql(f"SELECT instrument, date, round(coalesce({pct('close', 5)}, 0), 6) AS feature, round(fwd, 6) AS label FROM returns QUALIFY fwd IS NOT NULL", "returns"))
def _(spark, sf):
    from panelspark.operators.models import prepare

    body = lambda df, w: df.withColumn("feature", wo.momentum("close", 5, w))
    p = trailing(i.returns(spark, sf), 5, body).select("instrument", "date", "feature", F.col("fwd").alias("label"))
    return i.rounded(prepare(p, ["feature"], "label")[0])


@query("P13_smart_div", sql("SELECT instrument, date, round(ls_top / nullif(ls_global, 0), 6) AS smart_div FROM dense", "dense"))
def _(spark, sf):
    return i.rounded(i.dense(spark, sf).select("instrument", "date", sc.ratio("ls_top", "ls_global").alias("smart_div")))


@query("P14_sign_exp_log_sqrt_clip", """SELECT s_suppkey, CAST(sign(s_acctbal) AS DOUBLE) AS sgn, round(exp(s_acctbal / 1000), 4) AS expv,
 CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 6) END AS logv, round(sqrt(abs(s_acctbal)), 6) AS sqrtv,
 CASE WHEN s_nationkey = 3 THEN NULL ELSE least(greatest(s_acctbal / 5000, 0), 1) END AS clipped FROM supplier""")
def _(spark, sf):
    s = i.table(spark, sf, "supplier")
    bal = F.col("s_acctbal")
    return s.select(
        "s_suppkey", sc.sign_of("s_acctbal").alias("sgn"), F.round(F.exp(bal / 1000), 4).alias("expv"), F.round(sc.safe_ln(bal), 6).alias("logv"),
        F.round(F.sqrt(F.abs(bal)), 6).alias("sqrtv"), sc.clip(F.when(F.col("s_nationkey") != 3, bal / 5000), 0.0, 1.0).alias("clipped"),
    )


@query("P15_norm_cdf_ppf", sql(f"""SELECT event_id, round({cdf('z')}, 6) AS cdf, round(q, 6) AS ppf FROM {with_ppf('base', 'p', 'q')}""",
    base="SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z, (event_id + 0.5) / count(*) OVER () AS p FROM events"))
def _(spark, sf):
    e = i.table(spark, sf, "events").select("event_id", "value")
    one_row = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    both = e.join(F.broadcast(one_row))
    return i.rounded(both.select(
        "event_id", sc.norm_cdf((F.col("value") - F.col("m")) / F.col("s")).alias("cdf"), sc.norm_ppf((F.col("event_id") + 0.5) / F.col("n")).alias("ppf")))


@query("P16_config_hash", """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS config_hash FROM supplier""")
def _(spark, sf):
    return i.table(spark, sf, "supplier").select("s_suppkey", sc.config_hash(["s_suppkey", "s_name", "s_nationkey"]).alias("config_hash"))


@query("P17_checksum_check", """SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'unvalidated' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents""")
def _(spark, sf):
    """Whole document texts as file contents; published hashes in mixed case, some wrong, some absent."""
    d = i.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    files = d.select("path", F.encode("text", "utf-8").alias("content"))
    mod = lambda n: F.pmod("doc_id", F.lit(n))
    published = d.filter(mod(5) != 0).select(
        "path", F.when(mod(7) == 0, F.sha2(F.col("path").cast("binary"), 256)).when(mod(2) == 0, F.upper(F.sha2(F.encode("text", "utf-8"), 256)))
        .otherwise(F.sha2(F.encode("text", "utf-8"), 256)).alias("sha256"),
    )
    return archives.checksum_check(files, published)


@query("P18_archive_key", sql("SELECT 'spot/daily/klines/' || instrument || '/1d/' || instrument || '-1d-' || date || '.zip' AS path, instrument AS symbol, '1d' AS kind, date FROM names", "names"))
def _(spark, sf):
    n = i.names(spark, sf)
    day = F.col("date").cast("string")
    path = F.concat(F.lit("spot/daily/klines/"), "instrument", F.lit("/1d/"), "instrument", F.lit("-1d-"), day, F.lit(".zip"))
    symbol, kind, text = archives.archive_key("path")
    return n.select(path.alias("path")).select("path", symbol.alias("symbol"), kind.alias("kind"), text.cast("date").alias("date"))


@query("P19_universe_preset", sql("""SELECT symbol, ts, close, symbol IN ('view', 'purchase') AS is_predictor FROM hourly WHERE symbol IN ('view', 'purchase', 'click', 'error')""", "hourly"))
def _(spark, sf):
    presets = {"events": (("view", "purchase"), ("view", "purchase", "click", "error"))}
    out = leadlag.select_universe(i.hourly(spark, sf), "events", presets)
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "is_predictor")


# ---- joins ------------------------------------------------------------------------------------------------------

@query("J1_attach_field", sql("SELECT d.instrument, d.date, round(d.close, 6) AS close, n.amount AS extra FROM dense d LEFT JOIN (SELECT 'L' || (1 + (s_suppkey % 7)) AS instrument, DATE '1996-01-01' + CAST(s_suppkey AS INTEGER) AS date, s_acctbal AS amount FROM supplier) n USING (instrument, date)", "dense"))
def _(spark, sf):
    s = i.table(spark, sf, "supplier")
    series = s.select(
        F.concat(F.lit("L"), (1 + F.pmod("s_suppkey", F.lit(7))).cast("string")).alias("instrument"),
        F.date_add(D("1996-01-01"), F.col("s_suppkey").cast("int")).alias("date"), F.col("s_acctbal").alias("extra"),
    )
    return pn.attach_field(i.dense(spark, sf).select("instrument", "date", F.round("close", 6).alias("close")), series)


@query("J2_densify", sql("SELECT instrument, date, close, volume FROM orders_dense", "orders_dense"))
def _(spark, sf):
    return pn.densify(i.orders_panel(spark, sf)).select("instrument", "date", "close", "volume")


@query("J3_with_benchmark", sql("SELECT d.instrument, d.date, round(d.close, 6) AS close, round(b.close, 6) AS bench FROM dense d LEFT JOIN (SELECT date, close FROM dense WHERE instrument = 'L1') b USING (date)", "dense"))
def _(spark, sf):
    return i.rounded(pn.with_benchmark(i.dense(spark, sf).select("instrument", "date", "close"), "L1"))


SIGNAL = {"signal": f"SELECT instrument, date, CASE WHEN volume > 3 THEN close END AS v FROM orders_panel WHERE volume >= 2"}


def signal(spark, sf):
    return i.orders_panel(spark, sf).filter(F.col("volume") >= 2).select("instrument", "date", F.when(F.col("volume") > 3, F.col("close")).alias("v"))


@query("J4_asof_inclusive", sql("SELECT l.instrument, l.date, CASE WHEN r.date IS NULL THEN 1.0 ELSE r.v END AS v FROM orders_dense l ASOF LEFT JOIN signal r ON l.instrument = r.instrument AND l.date >= r.date", "orders_dense", **SIGNAL))
def _(spark, sf):
    left = pn.densify(i.orders_panel(spark, sf)).select("instrument", "date")
    return asof.asof(left, signal(spark, sf), ["v"], default=F.lit(1.0), block=512)


@query("J5_asof_strict", sql("SELECT l.instrument, l.date, r.v FROM orders_dense l ASOF LEFT JOIN signal r ON l.instrument = r.instrument AND l.date > r.date", "orders_dense", **SIGNAL))
def _(spark, sf):
    left = pn.densify(i.orders_panel(spark, sf)).select("instrument", "date")
    return asof.asof(left, signal(spark, sf), ["v"], strict=True, block=512)


@query("J6_asof_month", sql("SELECT l.instrument, l.date, r.m AS schedule_month FROM dense l ASOF LEFT JOIN months r ON date_trunc('month', l.date) >= r.m", "dense",
    months="SELECT m FROM (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL) WHERE n % 3 = 0"))
def _(spark, sf):
    """Months of all orders whose number of orders is a multiple of three, so that the schedule has gaps."""
    months = i.table(spark, sf, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).filter("n % 3 = 0")
    return asof.asof_month(i.dense(spark, sf).select("instrument", "date"), months)


@query("J7_align_common_dates", sql("SELECT trial, date, round(ret, 6) AS ret FROM common", "common"))
def _(spark, sf):
    return i.rounded(joins.align_common_dates(i.trials(spark, sf)))


@query("J7_alignment_report", sql("""SELECT count(DISTINCT date) AS common_days, min(date) AS from_date, max(date) AS to_date, (SELECT max(n) FROM (SELECT count(*) AS n FROM trials GROUP BY trial)) AS longest_trial,
 count(DISTINCT date) < 0.95 * (SELECT max(n) FROM (SELECT count(*) AS n FROM trials GROUP BY trial)) AS differs FROM common""", "common"))
def _(spark, sf):
    return joins.alignment_report(i.trials(spark, sf))


@query("J8_union_trial_sharpes", """SELECT CAST(o_custkey AS VARCHAR) AS config_hash, round(avg(o_totalprice), 6) AS sharpe FROM orders GROUP BY o_custkey
 UNION ALL SELECT 'r' || o_orderkey, o_totalprice FROM orders WHERE o_totalprice NOT IN (SELECT round(avg(o_totalprice), 6) FROM orders GROUP BY o_custkey)""")
def _(spark, sf):
    run = i.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("config_hash")).agg(F.round(F.avg("o_totalprice"), 6).alias("sharpe"))
    reg = i.table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("config_hash"), F.col("o_totalprice").alias("sharpe"))
    return joins.union_trial_sharpes(run, reg)


@query("J9_filter_members", sql("SELECT instrument, date, round(close, 6) AS close FROM names n WHERE EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_orderdate AS DATE) = n.date AND 'S' || (o.o_custkey % 100) = n.instrument)", "names"))
def _(spark, sf):
    members = i.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(100)).cast("string")).alias("instrument"), F.col("o_orderdate").cast("date").alias("date"))
    return joins.filter_members(i.names(spark, sf).select("instrument", "date", F.round("close", 6).alias("close")), members)


LEGS = {
    "scored": "SELECT instrument, date, close AS score FROM names",
    "ranked": """SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument DESC) AS rd,
 row_number() OVER (PARTITION BY date ORDER BY score, instrument) AS ra FROM scored""",
    "legs": """SELECT instrument, date, 'long' AS leg, rd AS rank, least(3, n // 2) AS k FROM ranked WHERE rd <= least(3, n // 2)
 UNION ALL SELECT instrument, date, 'short', ra, least(3, n // 2) FROM ranked WHERE ra <= least(3, n // 2)""",
    "steps": "SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM scored)",
}


@query("J10_leg_entries", sql("""SELECT l.instrument, l.date, l.leg FROM legs l JOIN steps s USING (date)
 WHERE NOT EXISTS (SELECT 1 FROM legs p WHERE p.date = s.prev AND p.leg = l.leg AND p.instrument = l.instrument)""", "names", **LEGS))
def _(spark, sf):
    scored = i.names(spark, sf).select("instrument", "date", F.col("close").alias("score"))
    legs = ranking.top_bottom_k(scored, 3)
    return joins.leg_entries(legs, scored.select("date").distinct()).select("instrument", "date", "leg")


SPANS = [("early", "1995-02-01", "1996-01-31"), ("overlap", "1996-01-01", "1996-12-31"), ("late", "2001-01-01", "2001-12-31")]


@query("J11_label_windows", sql("SELECT instrument, date, label FROM names JOIN (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in SPANS)
    + ") w(label, a, b) ON date BETWEEN a AND b", "names"))
def _(spark, sf):
    w = literal(spark, SPANS, "label string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    return joins.label_windows(i.names(spark, sf).select("instrument", "date"), w)


POSITIONS = {"pos": "SELECT date, instrument AS symbol, volume AS amount, close AS price FROM bars",
    "days": "SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM pos)",
    "diff": """SELECT g.date, g.symbol, coalesce(c.amount, 0) - coalesce(p.amount, 0) AS delta, coalesce(c.price, p.price) AS price
 FROM (SELECT d.date, d.prev, s.symbol FROM days d, (SELECT DISTINCT symbol FROM pos) s) g
 LEFT JOIN pos c ON c.date = g.date AND c.symbol = g.symbol LEFT JOIN pos p ON p.date = g.prev AND p.symbol = g.symbol""",
    "tr": "SELECT date, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, symbol, abs(delta) AS qty, price, abs(delta) * price AS value FROM diff WHERE abs(delta) > 1e-12"}


def positions(spark, sf):
    return i.bars(spark, sf).select("date", F.col("instrument").alias("symbol"), F.col("volume").alias("amount"), F.col("close").alias("price"))


@query("J12_position_diff", sql("SELECT date, side, symbol, qty, round(price, 6) AS price, round(value, 4) AS value FROM tr", "bars", **POSITIONS))
def _(spark, sf):
    return i.rounded(joins.position_diff(positions(spark, sf)), 6, value=4)


@query("F12_trades", sql("SELECT row_number() OVER (ORDER BY date, symbol) AS line, date, side, symbol, qty, round(price, 6) AS price, round(value, 4) AS value FROM tr", "bars", **POSITIONS))
def _(spark, sf):
    return i.rounded(joins.trades(positions(spark, sf)), 6, value=4)


GRID = [{"predictor": p, "k": k, "h": h} for p in ("view", "purchase") for k in (1, 2) for h in (1, 3)]


@query("J13_cross_params", sql("SELECT symbol, ts, close, predictor, k, h FROM hourly, (VALUES " + ", ".join(f"('{g['predictor']}', {g['k']}, {g['h']})" for g in GRID) + ") g(predictor, k, h)", "hourly"))
def _(spark, sf):
    return joins.cross_params(i.hourly(spark, sf).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close"), GRID)


@query("J14_pair_returns", sql("SELECT a.date, round(a.ret, 6) AS cand, round(b.ret, 6) AS null_ret FROM trials a JOIN trials b USING (date) WHERE a.trial = 'L1' AND b.trial = 'L2'", "trials"))
def _(spark, sf):
    t = i.trials(spark, sf)
    return i.rounded(joins.pair_returns(t.filter("trial = 'L1'"), t.filter("trial = 'L2'")))


FIELDS = ["open", "close", "volume", "amount", "trades", "factor", "oi"]
SPLIT = {"split": f"""SELECT CASE WHEN instrument = 'L7' AND date <= DATE '1997-12-20' THEN 'OLD' WHEN instrument = 'L7' THEN 'NEW' ELSE instrument END AS instrument, date,
 {', '.join(FIELDS)} FROM bars WHERE instrument <> 'L7' OR date <= DATE '1997-12-20' OR date >= DATE '1998-01-05'"""}
ROUNDS = {"amount": 4}


def split_history(spark, sf):
    """L7 cut into two symbols with a hole between them."""
    b = i.bars(spark, sf).select("instrument", "date", *FIELDS)
    seven = F.col("instrument") == "L7"
    renamed = F.when(seven & (F.col("date") <= D("1997-12-20")), "OLD").when(seven, "NEW").otherwise(F.col("instrument"))
    return b.filter(~seven | (F.col("date") <= D("1997-12-20")) | (F.col("date") >= D("1998-01-05"))).withColumn("instrument", renamed)


def fields_sql(prefix=""):
    return ", ".join(f"round({prefix}{f}, {ROUNDS.get(f, 6)}) AS {f}" for f in FIELDS)


SUSPENDED = "NULL AS open, NULL AS close, 0.0 AS volume, 0.0 AS amount, 0.0 AS trades, 1.0 AS factor, NULL AS oi"
STITCHED = f"""SELECT CASE WHEN instrument = 'OLD' THEN 'NEW' ELSE instrument END AS instrument, date, {fields_sql()} FROM split
 UNION ALL SELECT 'NEW', CAST(unnest(generate_series((SELECT max(date) + 1 FROM split WHERE instrument = 'OLD'), (SELECT min(date) - 1 FROM split WHERE instrument = 'NEW'), INTERVAL 1 DAY)) AS DATE), {SUSPENDED}"""


@query("J15_stitch_rename", sql(STITCHED, "bars", **SPLIT))
def _(spark, sf):
    return i.rounded(joins.stitch_rename(split_history(spark, sf), "OLD", "NEW"), 6, **ROUNDS)


# ---- ordering, top-k, set operations ------------------------------------------------------------------------------

def schedule_sql(strict: bool = False):
    lo, hi = ("INTERVAL 60 DAY", "<") if strict else ("INTERVAL 59 DAY", "<=")
    return sql(f"""SELECT month, instrument, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, instrument) AS rank
 FROM (SELECT m.month, n.instrument, avg(n.amount) AS score FROM months m JOIN names n ON n.date {hi} m.month AND n.date >= m.month - {lo} GROUP BY ALL)) WHERE rank <= 5""", "names",
        months="""SELECT CAST(month AS DATE) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS month, min(date) AS lo FROM names) WHERE month >= lo""")


@query("T1_liquidity_schedule", schedule_sql())
def _(spark, sf):
    return i.rounded(ranking.liquidity_schedule(i.names(spark, sf), 5, 60), 4)


@query("T1_liquidity_schedule_strict", schedule_sql(True))
def _(spark, sf):
    return i.rounded(ranking.liquidity_schedule(i.names(spark, sf), 5, 60, strict=True), 4)


@query("T2_top_bottom_k", sql("SELECT instrument, date, leg, CAST(rank AS INTEGER) AS rank, k FROM legs", "names", **LEGS))
def _(spark, sf):
    scored = i.names(spark, sf).select("instrument", "date", F.col("close").alias("score"))
    return ranking.top_bottom_k(scored, 3).select("instrument", "date", "leg", "rank", "k")


SHARPES = {"sh": "SELECT trial, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0.0 END AS sharpe FROM trials GROUP BY trial"}


@query("T3_rank_table", sql("SELECT trial, round(sharpe, 6) AS sharpe, CAST(row_number() OVER (ORDER BY sharpe DESC, trial) AS INTEGER) AS rank FROM sh", "trials", **SHARPES))
def _(spark, sf):
    from panelspark.operators.stats import sharpe

    return i.rounded(ranking.rank_table(i.trials(spark, sf).groupBy("trial").agg(sharpe("ret").alias("sharpe"))))


@query("T5_dedupe_trials", "SELECT CAST(o_custkey AS VARCHAR) AS config_hash, arg_max(o_totalprice, o_orderkey) AS sharpe, min(o_orderkey) AS first_seen FROM orders GROUP BY o_custkey")
def _(spark, sf):
    reg = i.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("config_hash"), F.col("o_totalprice").alias("sharpe"), F.col("o_orderkey").alias("seq"))
    return ranking.dedupe_trials(reg)


@query("T6_dedupe_dates", sql("SELECT date, arg_min(close, instrument) AS close, min(instrument) AS period FROM (SELECT instrument, date, round(close, 6) AS close FROM bars) GROUP BY date", "bars"))
def _(spark, sf):
    s = i.bars(spark, sf).select("date", F.col("instrument").alias("period"), F.round("close", 6).alias("close"))
    return ranking.dedupe_dates(s, "period")


@query("T7_union_intersect_except", sql("""SELECT 'union' AS op, date FROM (SELECT date FROM bars UNION SELECT date FROM orders_panel)
 UNION ALL SELECT 'intersect', date FROM (SELECT date FROM bars INTERSECT SELECT date FROM orders_panel)
 UNION ALL SELECT 'except', date FROM (SELECT date FROM bars EXCEPT SELECT date FROM orders_panel)""", "bars", "orders_panel"))
def _(spark, sf):
    a, b = i.bars(spark, sf).select("date"), i.orders_panel(spark, sf).select("date")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "date")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.subtract(b), "except"))


@query("T8_ordered_distinct", "SELECT p_name AS name, min(p_partkey) AS first_seen FROM part GROUP BY p_name")
def _(spark, sf):
    return ranking.ordered_distinct(i.table(spark, sf, "part").withColumnRenamed("p_name", "name"), "name", "p_partkey")


@query("T9_head", sql("SELECT instrument, date, round(close, 6) AS close FROM names ORDER BY date, instrument LIMIT 25", "names"))
def _(spark, sf):
    return i.rounded(ranking.head(i.names(spark, sf), 25, ["date", "instrument"]).select("instrument", "date", "close"))


# ---- dataset maintenance -------------------------------------------------------------------------------------------

HOLES = {"miss": """SELECT instrument, date FROM (SELECT instrument, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM names GROUP BY instrument)
 EXCEPT SELECT instrument, date FROM names"""}
ISLANDS = "SELECT instrument, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM (SELECT instrument, date, date - CAST(row_number() OVER (PARTITION BY instrument ORDER BY date) AS INTEGER) AS g FROM {src}) GROUP BY instrument, g"


@query("D1_verify_panel", sql("""SELECT 'duplicate_day' AS check, instrument, NULL AS field, 'error' AS severity, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT instrument, date FROM doubled GROUP BY ALL HAVING count(*) > 1) GROUP BY instrument
 UNION ALL SELECT 'missing_day', instrument, NULL, 'error', first_day || '..' || last_day FROM gone
 UNION ALL SELECT 'synthetic_day', instrument, NULL, 'note', first_day || '..' || last_day FROM synth
 UNION ALL SELECT 'coverage', instrument, field, 'note', CASE WHEN n = 0 THEN 'no coverage' ELSE a || '..' || b || ' (' || n || '/' || r || ')' END FROM cov
 UNION ALL SELECT 'uncovered_day', NULL, NULL, 'error', first_day || '..' || last_day FROM (SELECT min(date) AS first_day, max(date) AS last_day FROM (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS g FROM bare) GROUP BY g)""",
    "names", **({
        "late": "SELECT instrument, date, CASE WHEN trades > 1 THEN close END AS close, volume FROM names WHERE instrument <> 'S1' OR date >= DATE '2001-01-01'",
        "doubled": "SELECT * FROM late UNION ALL SELECT * FROM late WHERE instrument = 'S3' AND volume > 60",
        "rng": "SELECT instrument, min(date) AS lo, max(date) AS hi FROM doubled GROUP BY instrument",
        "miss": "SELECT instrument, date FROM (SELECT instrument, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM rng) EXCEPT SELECT instrument, date FROM doubled",
        "gone": ISLANDS.format(src="miss"), "synth": ISLANDS.format(src="(SELECT DISTINCT instrument, date FROM doubled WHERE close IS NULL)"),
        "cov": " UNION ALL ".join(f"SELECT instrument, '{f}' AS field, min(CASE WHEN {f} IS NOT NULL THEN date END) AS a, max(CASE WHEN {f} IS NOT NULL THEN date END) AS b, count({f}) AS n, count(*) AS r FROM doubled GROUP BY instrument" for f in ("close", "volume")),
        "bare": "SELECT CAST(date AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(lo) FROM rng), (SELECT max(hi) FROM rng), INTERVAL 1 DAY)) AS date) c WHERE NOT EXISTS (SELECT 1 FROM rng WHERE c.date BETWEEN lo AND hi)"})))
def _(spark, sf):
    n = i.names(spark, sf).select("instrument", "date", F.when(F.col("trades") > 1, F.col("close")).alias("close"), "volume")
    late = n.filter((F.col("instrument") != "S1") | (F.col("date") >= D("2001-01-01")))
    broken = late.unionByName(late.filter((F.col("instrument") == "S3") & (F.col("volume") > 60)))
    return quality.verify_panel(settle(broken, "panel"), ["close", "volume"], fail_on_gap=True)


@query("D2_synthetic_days", sql(ISLANDS.format(src="(SELECT * FROM dense WHERE close IS NULL)"), "dense"))
def _(spark, sf):
    return quality.synthetic_days(i.dense(spark, sf))


@query("D3_missing_days", sql("SELECT instrument, date FROM miss", "names", **HOLES))
def _(spark, sf):
    return quality.missing_days(i.names(spark, sf))


KNOWN = {"known": "SELECT instrument, min(date) AS from_date, max(date) AS to_date FROM names WHERE date <= DATE '2001-08-01' GROUP BY instrument",
         "listing": "SELECT 'S' || s_suppkey AS instrument, CASE WHEN s_nationkey = 2 THEN 'BREAK' ELSE 'TRADING' END AS status FROM supplier WHERE s_nationkey <> 5",
         "found": "SELECT n.instrument, min(n.date) AS first_new, max(n.date) AS last_new FROM names n JOIN known k USING (instrument) WHERE n.date > k.to_date AND n.date <= DATE '2001-08-06' GROUP BY n.instrument"}


def known(spark, sf):
    n = i.names(spark, sf)
    listing = i.table(spark, sf, "supplier").filter(F.col("s_nationkey") != 5).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument"), F.when(F.col("s_nationkey") == 2, "BREAK").otherwise("TRADING").alias("status"))
    return n, pn.instrument_ranges(n.filter(F.col("date") <= D("2001-08-01"))).drop("rows"), listing


@query("D4_backfill_plan", sql("""SELECT instrument, action, CASE WHEN action = 'extend' THEN to_date + 1 END AS fetch_from, CASE WHEN action = 'extend' THEN last_new END AS fetch_to FROM (
 SELECT k.instrument, k.to_date, f.last_new, CASE WHEN coalesce(l.status, 'TRADING') <> 'TRADING' THEN 'not_trading' WHEN k.to_date >= DATE '2001-08-06' THEN 'caught_up'
 WHEN f.first_new IS NULL AND DATE '2001-08-06' - k.to_date > 7 THEN 'error_no_data' WHEN f.first_new IS NULL THEN 'waiting' WHEN f.first_new > k.to_date + 1 THEN 'error_gap' ELSE 'extend' END AS action
 FROM known k LEFT JOIN listing l USING (instrument) LEFT JOIN found f USING (instrument))""", "names", **KNOWN))
def _(spark, sf):
    n, ranges, listing = known(spark, sf)
    return quality.backfill_plan(ranges, listing, n.select("instrument", "date"), "2001-08-06")


@query("D5_extend_plan", sql("""SELECT instrument, is_new, action, CASE WHEN action = 'fetch' THEN first_new END AS fetch_from, CASE WHEN action = 'fetch' THEN last_new END AS fetch_to FROM (
 SELECT *, to_date IS NULL AS is_new, CASE WHEN NOT req THEN 'error_absent' WHEN first_new IS NULL AND to_date IS NULL THEN 'error_no_data' WHEN first_new IS NULL AND DATE '2001-08-06' - cal_end > 7 THEN 'error_no_data'
 WHEN first_new IS NULL THEN 'waiting' WHEN to_date IS NOT NULL AND first_new > start THEN 'error_gap' ELSE 'fetch' END AS action FROM (
 SELECT e.instrument, e.to_date, e.req, e.start, e.cal_end, min(n.date) AS first_new, max(n.date) AS last_new FROM every e
 LEFT JOIN names n ON n.instrument = e.instrument AND n.date >= e.start AND n.date <= DATE '2001-08-06' GROUP BY ALL))""", "names", **{
    "known": "SELECT instrument, max(date) AS to_date FROM names WHERE date <= DATE '2001-08-01' AND instrument LIKE '%1' GROUP BY instrument",
    "req": "SELECT DISTINCT 'S' || s_suppkey AS instrument FROM supplier WHERE s_nationkey <> 5 UNION SELECT 'NEWCOMER'",
    "every": "SELECT instrument, k.to_date, r.instrument IS NOT NULL AS req, (SELECT max(to_date) FROM known) AS cal_end, CASE WHEN k.to_date IS NULL THEN DATE '2001-07-25' ELSE (SELECT max(to_date) FROM known) + 1 END AS start FROM req r FULL JOIN known k USING (instrument)"}))
def _(spark, sf):
    n = i.names(spark, sf)
    ranges = pn.instrument_ranges(n.filter((F.col("date") <= D("2001-08-01")) & F.col("instrument").like("%1"))).drop("rows")
    req = i.table(spark, sf, "supplier").filter(F.col("s_nationkey") != 5).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument"))
    req = req.unionByName(literal(spark, [("NEWCOMER",)], "instrument string"))
    return quality.extend_plan(ranges, req, n.select("instrument", "date"), "2001-07-25", "2001-08-06")


@query("D6_append_merge", sql("SELECT instrument, date, round(close, 6) AS close, volume FROM names", "names"))
def _(spark, sf):
    n = i.rounded(i.names(spark, sf).select("instrument", "date", "close", "volume"))
    return quality.append_merge(n.filter(F.col("date") < D("1999-01-01")), n.filter(F.col("date") >= D("1999-01-01")))


@query("D7_drop_instrument", sql("SELECT instrument, date, volume FROM names WHERE instrument <> 'S7'", "names"))
def _(spark, sf):
    return quality.drop_instrument(i.names(spark, sf).select("instrument", "date", "volume"), "S7")


@query("D8_rename_to_existing", sql(STITCHED, "bars", **SPLIT))
def _(spark, sf):
    return i.rounded(quality.rename_instrument(split_history(spark, sf), "OLD", "NEW"), 6, **ROUNDS)


@query("D8_rename_to_unlisted", sql(f"""SELECT CASE WHEN instrument = 'OLD' THEN 'LATER' ELSE instrument END AS instrument, date, {fields_sql()} FROM split
 UNION ALL SELECT 'LATER', CAST(unnest(generate_series((SELECT max(date) + 1 FROM split WHERE instrument = 'OLD'), DATE '1998-02-28', INTERVAL 1 DAY)) AS DATE), {SUSPENDED}""", "bars", **SPLIT))
def _(spark, sf):
    return i.rounded(quality.rename_instrument(split_history(spark, sf), "OLD", "LATER", "1998-03-01"), 6, **ROUNDS)


@query("D9_suspension_rows", sql(f"SELECT instrument, date, {fields_sql('b.')} FROM (SELECT instrument, date, CASE WHEN trades IS NULL THEN 1.0 ELSE factor END AS factor, open, close, coalesce(volume, 0) AS volume, coalesce(amount, 0) AS amount, coalesce(trades, 0) AS trades, oi FROM dense) b", "dense"))
def _(spark, sf):
    return i.rounded(pn.fill_suspended(i.dense(spark, sf).select("instrument", "date", *FIELDS)), 6, **ROUNDS)


@query("D10_available_range", sql("SELECT instrument AS symbol, min(date) AS first_day, max(date) AS last_day FROM names WHERE date BETWEEN DATE '1996-03-01' AND DATE '2000-03-01' GROUP BY instrument", "names"))
def _(spark, sf):
    return quality.available_range(i.names(spark, sf).withColumnRenamed("instrument", "symbol"), "1996-03-01", "2000-03-01")


@query("D11_capped_history", sql("SELECT CASE WHEN instrument = 'S4' AND date <= DATE '1998-05-13' THEN 'S4C' ELSE instrument END AS instrument, date, volume FROM names", "names"))
def _(spark, sf):
    return quality.capped_history(i.names(spark, sf).select("instrument", "date", "volume"), "S4", "1998-05-13", "S4C")


@query("D12_retrofit_field", sql("""SELECT n.instrument, n.date, CASE WHEN count(n.v) OVER (PARTITION BY n.instrument) < count(*) OVER (PARTITION BY n.instrument) THEN coalesce(n.v, s.v) ELSE n.v END AS funding
 FROM part_filled n LEFT JOIN series s USING (instrument, date)""", "bars",
    part_filled="SELECT instrument, date, CASE WHEN instrument = 'L1' OR date >= DATE '1998-01-01' THEN round(funding, 6) END AS v FROM bars", series="SELECT instrument, date, 9.0::DOUBLE AS v FROM bars WHERE date >= DATE '1996-01-01'"))
def _(spark, sf):
    b = i.bars(spark, sf)
    part = b.select("instrument", "date", F.when((F.col("instrument") == "L1") | (F.col("date") >= D("1998-01-01")), F.round("funding", 6)).alias("funding"))
    series = b.filter(F.col("date") >= D("1996-01-01")).select("instrument", "date", F.lit(9.0).alias("funding"))
    return quality.retrofit_field(part, series, "funding")
