"""Queries of sources, sinks and streams. Archives, CSV, JSON and Parquet inputs are derived from the tables by Spark."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.layout import fresh_path, settle
from panelspark.operators import aggregates as ag, panel as pn, stats
from panelspark.operators.joins import union_trial_sharpes
from panelspark.operators.ranking import dedupe_trials
from panelspark.queries import inputs as i
from panelspark.queries.fixtures import BROKEN_SQL, damage_on, pack_archives
from panelspark.queries.registry import query, sql
from panelspark.queries.table_queries import D
from panelspark.sources import archives as ar, tables as tb
from panelspark.streaming import jobs


def day_path(symbol, kind, date):
    return F.concat(F.lit("spot/daily/klines/"), symbol, F.lit("/"), F.lit(kind), F.lit("/"), symbol, F.lit(f"-{kind}-"), date, F.lit(".zip"))


def text(*cols):
    return F.concat_ws(",", *[c.cast("string") for c in cols])


def daily_files(spark, sf):
    """One zip per bar of the order priorities; epochs are ms before 1998 and us after, every 50th file is broken."""
    o = i.orders_panel(spark, sf).withColumn("instrument", F.concat(F.lit("P"), F.substring("instrument", 1, 1)))
    ms = F.unix_millis(F.col("date").cast("timestamp"))
    epoch = F.when(F.year("date") < 1998, ms).otherwise(ms * 1000)
    bad = F.pmod(F.datediff("date", D("1995-01-01")), F.lit(50)) == 0
    shifted = F.when(bad, epoch + F.when(F.year("date") < 1998, F.lit(86_400_000)).otherwise(F.lit(86_400_000_000))).otherwise(epoch)
    c = F.col("close")
    line = text(shifted, c, c + 1, c - 1, c, F.when(F.pmod("volume", F.lit(3)) == 0, F.lit(0.0)).otherwise(F.col("volume")), epoch, F.round("amount", 2), F.col("volume").cast("long"), F.lit(0.5), F.lit(0.25), F.lit(0))
    return pack_archives(o.select(day_path(F.col("instrument"), "1d", F.col("date").cast("string")).alias("path"), F.lit(0).alias("line_no"), line.alias("line")))


ORD = "SELECT 'P' || substr(instrument, 1, 1) AS instrument, date, close, round(amount, 2) AS amount, volume AS n, CASE WHEN volume % 3 = 0 THEN 0.0 ELSE volume END AS volume, (date - DATE '1995-01-01') % 50 = 0 AS bad FROM orders_panel"


@query("S1_read_archive", sql("SELECT 'spot/daily/klines/' || instrument || '/1d/' || instrument || '-1d-' || date || '.zip' AS path, CAST(0 AS BIGINT) AS line_no, close, CAST(n AS BIGINT) AS trades FROM o", "orders_panel", o=ORD))
def _(spark, sf):
    raw = ar.read_archive(daily_files(spark, sf), ar.BAR_COLUMNS)
    return raw.select("path", "line_no", ar.number("close").alias("close"), F.col("count").cast("long").alias("trades"))


@query("S2_read_daily_bars", sql("SELECT instrument, date, close, round(close + 1, 6) AS high, round(close - 1, 6) AS low, volume, amount, n AS trades, round(CASE WHEN volume = 0 THEN close ELSE amount / volume END, 4) AS vwap, 1.0::DOUBLE AS factor FROM o WHERE NOT bad", "orders_panel", o=ORD))
def _(spark, sf):
    bars, _ = ar.read_daily_bars(daily_files(spark, sf))
    return bars.select("instrument", "date", "close", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), "volume", "amount", "trades", F.round("vwap", 4).alias("vwap"), "factor")


@query("S2_bad_records", sql("SELECT 'spot/daily/klines/' || instrument || '/1d/' || instrument || '-1d-' || date || '.zip' AS path, 'date differs from file date' AS reason FROM o WHERE bad", "orders_panel", o=ORD))
def _(spark, sf):
    return ar.read_daily_bars(daily_files(spark, sf))[1]


def hourly_files(spark, sf):
    """One zip per symbol and day with 24 bars at most; some days' archives are damaged."""
    h = i.hourly(spark, sf)
    epoch = F.unix_millis("ts")
    line = text(epoch, *[F.col(c) for c in ("open", "high", "low", "close", "volume")], epoch, F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    lines = h.select(day_path(F.col("symbol"), "1h", F.to_date("ts").cast("string")).alias("path"), F.hour("ts").alias("line_no"), line.alias("line"), F.to_date("ts").alias("day"))
    return pack_archives(lines, header=",".join(ar.BAR_COLUMNS), damage=damage_on(F.col("day")))


HOUR_BROKEN = BROKEN_SQL.format(day="CAST(ts AS DATE)")


@query("S3_read_hourly_bars", sql(f"SELECT symbol, ts, open, high, low, close, volume FROM hourly WHERE NOT {HOUR_BROKEN}", "hourly"))
def _(spark, sf):
    return ar.read_hourly_bars(hourly_files(spark, sf))[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("S3_bad_records", sql(f"SELECT DISTINCT 'spot/daily/klines/' || symbol || '/1h/' || symbol || '-1h-' || CAST(ts AS DATE) || '.zip' AS path, true AS told FROM hourly WHERE {HOUR_BROKEN}", "hourly"))
def _(spark, sf):
    return told(ar.read_hourly_bars(hourly_files(spark, sf))[1])


def told(bad):
    return bad.select("path", (F.length("reason") > 0).alias("told"))


FUND = "SELECT l_linenumber AS x, CAST(l_shipdate AS DATE) AS d, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS m, round(sum(l_tax), 4) AS rate FROM lineitem GROUP BY ALL"


def funding_files(spark, sf):
    """Monthly funding archives, one settlement per day at 08:00 with a few ms of jitter; some months' are damaged."""
    f = i.ticks(spark, sf).groupBy("instrument", "date").agg(F.round(F.sum("l_tax"), 4).alias("rate"))
    epoch = F.unix_millis(F.col("date").cast("timestamp")) + 8 * 3_600_000 + 7
    path = F.concat(F.lit("futures/um/monthly/fundingRate/"), "instrument", F.lit("/"), "instrument", F.lit("-fundingRate-"), F.date_format("date", "yyyy-MM"), F.lit(".zip"))
    lines = f.select(path.alias("path"), F.dayofmonth("date").alias("line_no"), text(epoch, F.lit(8), F.col("rate")).alias("line"), F.trunc("date", "MM").alias("day"))
    return pack_archives(lines, header="calc_time,funding_interval_hours,last_funding_rate", damage=damage_on(F.col("day")))


@query("S4_read_funding", sql(f"SELECT 'L' || x AS perp_symbol, CAST(d AS TIMESTAMP) + INTERVAL 8 HOUR AS ts, rate FROM f WHERE NOT {BROKEN_SQL.format(day='m')}", f=FUND))
def _(spark, sf):
    return ar.read_funding(funding_files(spark, sf))[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("S4_bad_records", sql(f"SELECT DISTINCT 'futures/um/monthly/fundingRate/L' || x || '/L' || x || '-fundingRate-' || strftime(m, '%Y-%m') || '.zip' AS path, true AS told FROM f WHERE {BROKEN_SQL.format(day='m')}", f=FUND))
def _(spark, sf):
    return told(ar.read_funding(funding_files(spark, sf))[1])


SLOTS = "SELECT event_type AS s, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, arg_max(value, row(ts, event_id)) AS v, arg_max(user_id, row(ts, event_id)) AS u FROM events GROUP BY ALL"


def metrics_files(spark, sf):
    """Five-minute metrics; the columns are in another order than expected and one holds a text for missing.

    Some days' archives are damaged, and on one day of 37 the header lacks a column.
    """
    e = i.events(spark, sf)
    seq = F.struct("ts", "event_id")
    m = e.groupBy("event_type", F.window("ts", "5 minutes").start.alias("slot")).agg(F.max_by("value", seq).alias("v"), F.max_by("user_id", seq).alias("u"))
    line = text(F.lit("n/a"), F.date_format("slot", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), F.col("v"), F.col("v") * 2, F.lit(9), F.col("u"), F.lit(0.5))
    path = F.concat(F.lit("futures/um/daily/metrics/"), "event_type", F.lit("/"), "event_type", F.lit("-metrics-"), F.to_date("slot").cast("string"), F.lit(".zip"))
    header = "sum_taker_long_short_vol_ratio,create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio"
    lines = m.select(path.alias("path"), (F.hour("slot") * 60 + F.minute("slot")).alias("line_no"), line.alias("line"), F.to_date("slot").alias("day"))
    lacking = F.pmod(F.datediff("day", D("1995-01-01")), F.lit(37)) == 6
    whole = pack_archives(lines.filter(~lacking), header=header, damage=damage_on(F.col("day")))
    return whole.unionByName(pack_archives(lines.filter(lacking), header=header.replace("sum_open_interest,", "something_else,")))


SLOT_DAY = BROKEN_SQL.format(day="CAST(slot AS DATE)")
SLOT_BROKEN = f"({SLOT_DAY} OR {SLOT_DAY.replace('BETWEEN 1 AND 4', '= 6')})"


@query("S5_read_metrics", sql(f"SELECT s AS perp_symbol, CAST(slot AS DATE) AS date, arg_max(v, slot) AS oi, arg_max(v, slot) * 2 AS oi_value, CAST(arg_max(u, slot) AS DOUBLE) AS ls_top, 0.5::DOUBLE AS ls_global, CAST(NULL AS DOUBLE) AS taker_ratio FROM m WHERE NOT {SLOT_BROKEN} GROUP BY ALL", m=SLOTS))
def _(spark, sf):
    return ag.last_of_day(ar.read_metrics(metrics_files(spark, sf))[0], list(ar.METRIC_FIELDS), "perp_symbol")


@query("S5_bad_records", sql(f"SELECT DISTINCT 'futures/um/daily/metrics/' || s || '/' || s || '-metrics-' || CAST(slot AS DATE) || '.zip' AS path, true AS told FROM m WHERE {SLOT_BROKEN}", m=SLOTS))
def _(spark, sf):
    return told(ar.read_metrics(metrics_files(spark, sf))[1])


def basis_files(spark, sf):
    o = i.orders_panel(spark, sf).withColumn("instrument", F.concat(F.lit("P"), F.substring("instrument", 1, 1)))
    epoch, c = F.unix_millis(F.col("date").cast("timestamp")), F.col("close") / 1_000_000
    line = text(epoch, c, c, c, c, F.lit(0), epoch, F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    lines = o.select(day_path(F.col("instrument"), "1d", F.col("date").cast("string")).alias("path"), F.lit(0).alias("line_no"), line.alias("line"), F.col("date").alias("day"))
    return pack_archives(lines, damage=damage_on(F.col("day")))


BASIS_SQL, DAY_BROKEN = ORD.replace("close,", "close / 1000000 AS close,"), BROKEN_SQL.format(day="date")


@query("S6_read_basis", sql(f"SELECT instrument AS perp_symbol, date, close AS basis FROM o WHERE NOT {DAY_BROKEN}", "orders_panel", o=BASIS_SQL))
def _(spark, sf):
    return ar.read_basis(basis_files(spark, sf))[0]


@query("S6_bad_records", sql(f"SELECT 'spot/daily/klines/' || instrument || '/1d/' || instrument || '-1d-' || date || '.zip' AS path, true AS told FROM o WHERE {DAY_BROKEN}", "orders_panel", o=BASIS_SQL))
def _(spark, sf):
    return told(ar.read_basis(basis_files(spark, sf))[1])


def tick_files(spark, sf):
    """One zip of trades per instrument and day, without a header; some days' archives are damaged."""
    t = i.ticks(spark, sf)
    line = text(F.col("l_orderkey"), F.col("price"), F.col("quantity"), F.col("l_orderkey"), F.col("l_orderkey"), F.unix_micros(F.col("date").cast("timestamp")), F.col("is_buyer_maker"), F.lit(True))
    path = F.concat(F.lit("spot/daily/aggTrades/"), "instrument", F.lit("/"), "instrument", F.lit("-aggTrades-"), F.col("date").cast("string"), F.lit(".zip"))
    return pack_archives(t.select(path.alias("path"), F.col("l_orderkey").alias("line_no"), line.alias("line"), F.col("date").alias("day")), damage=damage_on(F.col("day")))


@query("S7_read_ticks", sql(f"SELECT instrument AS symbol, date, count(*) AS ticks, round(sum(price * quantity), 2) AS amount, round(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 2) AS maker_qty FROM ticks WHERE NOT {DAY_BROKEN} GROUP BY ALL", "ticks"))
def _(spark, sf):
    ticks, _ = ar.read_ticks(tick_files(spark, sf))
    return ticks.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("ticks"), F.round(F.sum(F.col("price") * F.col("quantity")), 2).alias("amount"),
        F.round(F.sum(F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)), 2).alias("maker_qty"))


@query("S7_bad_records", sql(f"SELECT DISTINCT 'spot/daily/aggTrades/' || instrument || '/' || instrument || '-aggTrades-' || date || '.zip' AS path, true AS told FROM ticks WHERE {DAY_BROKEN}", "ticks"))
def _(spark, sf):
    return told(ar.read_ticks(tick_files(spark, sf))[1])


@query("S8_read_onchain", sql("SELECT date, CASE WHEN n % 5 = 0 THEN NULL ELSE amount END AS market_cap, CASE WHEN n % 7 = 0 THEN NULL ELSE n END AS active_addr FROM o", "orders_panel", o=ORD))
def _(spark, sf):
    o = i.orders_panel(spark, sf)
    path = fresh_path(spark, "onchain")
    n = F.col("volume")
    o.select(
        F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("time"),
        F.when(F.pmod(n, F.lit(5)) == 0, "oops").otherwise(F.round("amount", 2).cast("string")).alias("CapMrktCurUSD"),
        F.when(F.pmod(n, F.lit(7)) == 0, "NaN").otherwise(n.cast("string")).alias("AdrActCnt")).write.json(path)
    return tb.read_onchain(spark, path)


@query("S9_read_returns", sql("SELECT trial AS recipe, 'run' || (year(date) % 2) AS run, date, round(ret, 6) AS ret FROM trials", "trials"))
def _(spark, sf):
    """A tree <root>/<recipe>/<run>/returns.csv with trades.csv beside it, written in two jobs; the folder mlruns is ignored."""
    t = i.trials(spark, sf).withColumn("run", F.concat(F.lit("run"), F.pmod(F.year("date"), F.lit(2)).cast("string")))
    t = t.unionByName(t.filter("trial = 'L1'").withColumn("trial", F.lit("mlruns"))).select("trial", "run", "date", F.round("ret", 6).alias("ret"))
    root = fresh_path(spark, "runs")
    for kind, rows in (("returns.csv", t), ("trades.csv", t.filter("ret > 0").withColumnRenamed("ret", "price"))):
        rows.withColumn("file", F.lit(kind)).repartition("trial", "run").write.partitionBy("trial", "run", "file").mode("append").option("header", "true").csv(root)
    return tb.read_returns(spark, root)


def register(spark, sf):
    return i.table(spark, sf, "orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("recipe"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("config_hash"), F.col("o_totalprice").alias("sharpe"), F.col("o_orderdate").cast("string").alias("created"), "o_orderkey")


REG = "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS id, 'c' || o_custkey AS recipe, sha256(CAST(o_custkey AS VARCHAR)) AS config_hash, o_totalprice AS sharpe, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created FROM orders"


@query("S10_read_trials", REG)
def _(spark, sf):
    path = fresh_path(spark, "register")
    tb.append_trial(register(spark, sf), path)
    return tb.read_trials(spark, path).drop("seq")


@query("S10_T5_J8_register", """WITH reg AS (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS config_hash, arg_max(o_totalprice, o_orderkey % 2 * 1000000000000 + o_orderkey) AS sharpe FROM orders GROUP BY o_custkey),
 run AS (SELECT 'run' || c_custkey AS config_hash, coalesce(r.sharpe, c_acctbal) AS sharpe FROM customer LEFT JOIN reg r ON r.config_hash = sha256(CAST(c_custkey AS VARCHAR)) AND c_custkey % 3 = 0)
SELECT config_hash, sharpe FROM run UNION ALL SELECT config_hash, sharpe FROM reg WHERE sharpe NOT IN (SELECT sharpe FROM run)""")
def _(spark, sf):
    """A register in two appends with repeated configurations, some of whose last Sharpes are already in the run."""
    path = fresh_path(spark, "register")
    r = register(spark, sf)
    for half in (0, 1):
        tb.append_trial(r.filter(F.pmod("o_orderkey", F.lit(2)) == half), path, order="o_orderkey")
    last = settle(dedupe_trials(tb.read_trials(spark, path)), "register")
    c = i.table(spark, sf, "customer").withColumn("config_hash", F.sha2(F.col("c_custkey").cast("string"), 256))
    run = c.join(last.select("config_hash", "sharpe"), "config_hash", "left").select(
        F.concat(F.lit("run"), F.col("c_custkey").cast("string")).alias("config_hash"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.coalesce("sharpe", "c_acctbal")).otherwise(F.col("c_acctbal")).alias("sharpe"))
    return union_trial_sharpes(run, last)


@query("S17_append_trial", f"SELECT recipe, count(*) AS n, max(sharpe) AS best FROM ({REG}) GROUP BY recipe")
def _(spark, sf):
    """Two appends to one register by many tasks, the first of them replayed."""
    path = fresh_path(spark, "register")
    r = register(spark, sf)
    for half in (0, 1, 0):
        tb.append_trial(r.filter(F.pmod("o_orderkey", F.lit(2)) == half), path, batch=f"half {half}", order="o_orderkey")
    return tb.read_trials(spark, path).groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.max("sharpe").alias("best"))


@query("S11_read_panel", sql("SELECT instrument, date, round(close, 6) AS close, volume FROM names WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-09-30' AND instrument IN ('S0', 'S1', 'S16')", "names"))
def _(spark, sf):
    path = fresh_path(spark, "panel")
    tb.write_panel(i.names(spark, sf), path)
    return i.rounded(tb.read_panel(spark, path, ["S0", "S1", "S16"], ["close", "volume"], "1997-03-01", "1998-09-30"))


@query("S14_write_panel", sql("SELECT instrument, date, CASE WHEN year(date) = 1999 THEN -1.0 ELSE volume END AS volume FROM names", "names"))
def _(spark, sf):
    """A full write, then a second write that replaces only the year 1999."""
    path = fresh_path(spark, "panel")
    n = i.names(spark, sf).select("instrument", "date", "volume")
    tb.write_panel(n, path)
    tb.write_panel(n.filter(F.year("date") == 1999).withColumn("volume", F.lit(-1.0)), path)
    return tb.read_panel(spark, path)


@query("S12_read_ohlcv_csv", sql("""SELECT g.instrument, g.date, o.close, o.volume, CASE WHEN o.close IS NOT NULL THEN 1.0::DOUBLE END AS factor FROM (SELECT DISTINCT instrument FROM o) a CROSS JOIN (
 SELECT CAST(unnest(generate_series((SELECT min(date) FROM o), (SELECT max(date) FROM o), INTERVAL 1 DAY)) AS DATE) AS date) c JOIN LATERAL (SELECT a.instrument, c.date) g ON true LEFT JOIN o ON o.instrument = a.instrument AND o.date = c.date""", "orders_panel", o=ORD.replace("CASE WHEN volume % 3 = 0 THEN 0.0 ELSE volume END AS volume", "volume")))
def _(spark, sf):
    o = i.orders_panel(spark, sf)
    c = F.col("close")
    path = fresh_path(spark, "ohlcv")
    o.select("date", F.concat(F.lit("p"), F.substring("instrument", 1, 1)).alias("symbol"), c.alias("open"), c.alias("high"), c.alias("low"), c.alias("close"), "volume").write.option("header", "true").csv(path)
    return pn.densify_union_calendar(tb.read_ohlcv_csv(spark, path)).select("instrument", "date", "close", "volume", "factor")


@query("S13_symbols_from_text", "SELECT upper(trim(p_name)) AS symbol, min(p_partkey) AS first_line FROM part WHERE trim(p_name) <> '' AND p_partkey % 11 <> 0 GROUP BY 1")
def _(spark, sf):
    p = i.table(spark, sf, "part")
    value = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return tb.symbols_from_text(p.select(F.col("p_partkey").alias("line_no"), value.alias("value")))


@query("S15_write_results", sql("SELECT trial, round(avg(ret) / stddev_samp(ret), 6) AS sharpe, count(*) AS n FROM trials GROUP BY trial", "trials"))
def _(spark, sf):
    out = i.rounded(i.trials(spark, sf).groupBy("trial").agg(stats.sharpe("ret").alias("sharpe"), F.count(F.lit(1)).alias("n")))
    path = fresh_path(spark, "results")
    tb.write_results(out, path, "json")
    return spark.read.schema(out.schema).json(path)


@query("S16_sample_manifest", """SELECT 'L' || l_linenumber AS pair, array_to_string(list_sort(list(DISTINCT CAST(l_shipdate AS DATE))), ',') AS present_dates, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day, CAST(sum(l_quantity) AS BIGINT) AS total_bytes
 FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND l_linenumber <= 5 GROUP BY l_linenumber""")
def _(spark, sf):
    """A listing with one file per (pair, day); its length is that day's quantity."""
    t = i.ticks(spark, sf).groupBy("instrument", "date").agg(F.sum("quantity").cast("long").alias("length"))
    path = F.concat(F.lit("spot/daily/aggTrades/"), "instrument", F.lit("/"), "instrument", F.lit("-aggTrades-"), F.col("date").cast("string"), F.lit(".zip"))
    return ar.sample_manifest(t.select(path.alias("path"), "length"), ["L1", "L2", "L3", "L4", "L5"], "1996-01-01", "1999-12-31").withColumn("present_dates", F.array_join(F.col("present_dates").cast("array<string>"), ","))


SLICES, FILES = 5, 4


def event_slices(spark, sf, root=None, slices=range(SLICES), replays=False):
    """The events in slices of time, written one after another by several tasks each; a stream takes one slice per micro-batch.

    Every 40th event comes one slice late and every 120th two, most of which is beyond the watermark. With ``replays`` every 25th comes twice in its slice. Rows are dealt by id, so a slice has as
    many files as the stream takes at once.
    """
    e = spark.read.schema(jobs.EVENT_SCHEMA).parquet(f"{sf}/events.parquet")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    root = root or fresh_path(spark, "events")
    last = SLICES - 1
    own = F.least(F.lit(last), F.floor(F.datediff("ts", F.lit(low)) * SLICES / max(1, (high - low).days)))
    delay = F.when(F.pmod("event_id", F.lit(120)) == 0, 2).when(F.pmod("event_id", F.lit(40)) == 0, 1).otherwise(0)
    comes = F.least(F.lit(last), own + delay)
    times = F.when(F.lit(replays) & (F.pmod("event_id", F.lit(25)) == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = e.withColumns({"_slice": comes, "_time": times}).withColumn("_time", F.explode("_time"))
    for n in slices:
        dealt.filter(F.col("_slice") == n).drop("_slice", "_time").repartition(FILES, "event_id").write.mode("append").parquet(root)
    return jobs.event_stream(spark, root, "*.parquet", files_per_trigger=FILES)


# What the stream counts: a late row is dropped once its window has ended before the watermark of its micro-batch, which is a day
# before the latest time of the micro-batches up to the one before the last.
def stream_ctes(window: str) -> str:
    return f"""WITH span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
own AS (SELECT e.*, least({SLICES - 1}, floor(date_diff('day', CAST(lo AS DATE), CAST(ts AS DATE)) * {SLICES} / greatest(1, floor(epoch(hi - lo) / 86400)))) AS own FROM events e, span),
came AS (SELECT *, least({SLICES - 1}, own + CASE WHEN event_id % 120 = 0 THEN 2 WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS slice FROM own),
tops AS (SELECT slice, max(ts) AS top FROM came GROUP BY slice),
marks AS (SELECT c.slice, max(t.top) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT slice FROM came) c LEFT JOIN tops t ON t.slice <= c.slice - 2 GROUP BY c.slice),
counted AS (SELECT came.*, mark FROM came JOIN marks USING (slice) WHERE mark IS NULL OR {window} > mark)"""


@query("ST1_daily_sums", stream_ctes("date_trunc('day', ts) + INTERVAL 1 DAY") + """
SELECT event_type, CAST(ts AS DATE) AS date, round(sum(value), 4) AS total, count(*) AS n FROM counted GROUP BY ALL""")
def _(spark, sf):
    out = jobs.run_available(jobs.daily_sums(event_slices(spark, sf), "event_type", "value"), "sums", ("window", "event_type"))
    return i.rounded(out.select("event_type", F.to_date("window.start").alias("date"), "total", "n"), 4)


@query("ST2_last_of_day", stream_ctes("date_trunc('day', ts) + INTERVAL 1 DAY") + """
SELECT event_type, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS last_value, max(ts) AS last_ts FROM counted GROUP BY ALL""")
def _(spark, sf):
    out = jobs.run_available(jobs.last_of_day(event_slices(spark, sf), "event_type", "value", "event_id"), "last", ("window", "event_type"))
    return out.select("event_type", F.to_date("window.start").alias("date"), "last_value", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("ST3_tick_bars", stream_ctes("ts") + """
SELECT event_type, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS trades FROM counted
WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY event_type, date_trunc('hour', ts)""")
def _(spark, sf):
    """Bars of ticks that come late and twice; a tick that comes again inside the watermark counts once."""
    ticks = event_slices(spark, sf, replays=True).withColumn("quantity", F.lit(1.0))
    out = jobs.run_available(jobs.tick_bars(ticks, "event_type", "value", "quantity", "event_id"), "bars", ("window", "event_type"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "trades")
