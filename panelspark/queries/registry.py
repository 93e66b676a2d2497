"""Query registry and the SQL building blocks of the independent checks (plain DuckDB text)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions import scalar as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SEQ = "seq"
BAR_SELECT = f"""arg_min(price, {SEQ}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {SEQ}) AS close,
 sum(quantity) AS volume, sum(price * quantity) AS amount, CAST(count(*) AS DOUBLE) AS trades,
 sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS taker_buy_base,
 sum(CASE WHEN NOT is_buyer_maker THEN price * quantity ELSE 0 END) AS taker_buy_amount,
 CASE WHEN sum(quantity) <> 0 THEN sum(price * quantity) / sum(quantity) ELSE arg_max(price, {SEQ}) END AS vwap,
 CAST(1.0 AS DOUBLE) AS factor"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), """SELECT 'L' || l_linenumber AS instrument, 'S' || l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS date,
 l_extendedprice / l_quantity / 314.1592653589793::DOUBLE AS price, l_quantity AS quantity, l_returnflag = 'N' AS is_buyer_maker,
 l_orderkey * 4096 + l_partkey % 4096 AS seq, l_orderkey, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem"""),
    "bars": (("ticks",), f"""SELECT instrument, date, {BAR_SELECT},
 round(sum(l_tax - 0.04), 12) AS funding, CAST(sum(l_partkey) + 1 AS DOUBLE) AS oi, round(sum(l_partkey * l_discount), 12) AS oi_value,
 round(avg(l_discount) + 0.5, 12) AS ls_top, round(avg(l_tax), 12) AS ls_global,
 round(sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END)
   / nullif(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 0), 12) AS taker_ratio,
 round(avg(l_discount - l_tax), 12) AS basis FROM ticks GROUP BY instrument, date"""),
    "dense": (("bars",), """SELECT instrument, date, b.* EXCLUDE (instrument, date) FROM (
 SELECT instrument, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY instrument) g
 LEFT JOIN bars b USING (instrument, date)"""),
    "names": (("ticks",), f"SELECT supplier AS instrument, date, {BAR_SELECT} FROM ticks GROUP BY supplier, date"),
    "orders_panel": ((), """SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close,
 sum(o_totalprice) AS amount, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL"""),
    "orders_dense": (("orders_panel",), """SELECT instrument, date, b.* EXCLUDE (instrument, date) FROM (
 SELECT instrument, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM orders_panel GROUP BY instrument) g
 LEFT JOIN orders_panel b USING (instrument, date)"""),
    "hourly": ((), """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)"""),
    "returns": (("dense",), """SELECT *, close / lag(close) OVER wi - 1 AS ret, lead(close) OVER wi / close - 1 AS fwd FROM dense
 WINDOW wi AS (PARTITION BY instrument ORDER BY date)"""),
    "trials": (("returns",), "SELECT instrument AS trial, date, ret / 100 AS ret FROM returns WHERE ret IS NOT NULL"),
    "common": (("trials",), """SELECT * FROM trials WHERE date IN (SELECT date FROM trials GROUP BY date
 HAVING count(DISTINCT trial) = (SELECT count(DISTINCT trial) FROM trials))"""),
    "moments": (("trials",), """SELECT trial, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd,
 avg(m * m * m) / pow(avg(m * m), 1.5) AS g3, avg(m * m * m * m) / pow(avg(m * m), 2) AS g4
 FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY trial) AS m FROM trials) GROUP BY trial"""),
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` behind the named building blocks and ``extra`` CTEs, dependencies first."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, text = CTES[name]
        for d in deps:
            add(d)
        done[name] = text

    for n in needs:
        add(n)
    done.update(extra)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + "\n" + body if done else body


def over(n: int | None = None, part: str = "instrument", order: str = "date", ahead: int = 0) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    if ahead:
        frame = f" ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING"
    return f"OVER (PARTITION BY {part} ORDER BY {order}{frame})" if part else f"OVER (ORDER BY {order}{frame})"


def rmean(x: str, n: int, **k) -> str:
    return f"(CASE WHEN count({x}) {over(n, **k)} = {n} THEN avg({x}) {over(n, **k)} END)"


def rsum(x: str, n: int, **k) -> str:
    return f"(CASE WHEN count({x}) {over(n, **k)} = {n} THEN sum({x}) {over(n, **k)} END)"


def rstd(x: str, n: int, **k) -> str:
    return f"(CASE WHEN count({x}) {over(n, **k)} = {n} THEN stddev_samp({x}) {over(n, **k)} END)"


def fsum(x: str, h: int, **k) -> str:
    return f"(CASE WHEN count({x}) {over(ahead=h, **k)} = {h} THEN sum({x}) {over(ahead=h, **k)} END)"


def lagged(x: str, n: int, **k) -> str:
    return f"(lag({x}, {n}) {over(**k)})" if n >= 0 else f"(lead({x}, {-n}) {over(**k)})"


def pct(x: str, n: int, **k) -> str:
    return f"({x} / nullif({lagged(x, n, **k)}, 0) - 1)"


def zsql(x: str, n: int, **k) -> str:
    return f"(({x} - {rmean(x, n, **k)}) / nullif({rstd(x, n, **k)}, 0))"


def csrank(x: str, by: str = "date") -> str:
    """Average-tie rank over the count of non-NULL values."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x})"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)"
    )


def _horner(cs, x: str, tail_one: bool = False) -> str:
    acc = repr(float(cs[0])) + "::DOUBLE"
    for c in cs[1:]:
        acc = f"({acc} * {x} + {float(c)!r}::DOUBLE)"
    return f"({acc} * {x} + 1.0)" if tail_one else acc


def cdf(x: str) -> str:
    """Standard normal distribution function of a column (rational form, valid for |x| < 7.07; beyond it the tail is 0)."""
    z = f"abs({x})"
    tail = f"(CASE WHEN {z} >= 7.07106781186547 THEN 0.0 ELSE exp(-{z} * {z} / 2) * {_horner(s.HART_NUMERATOR, z)} / {_horner(s.HART_DENOMINATOR, z)} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def with_ppf(src: str, p: str, out: str) -> str:
    """Subquery adding the standard normal quantile ``out`` of column ``p`` to ``src``."""
    t = lambda e: f"sqrt(-2 * ln({e}))"
    side = lambda e: f"({_horner(s.ACKLAM_C, t(e))} / {_horner(s.ACKLAM_D, t(e), True)})"
    q = f"({p} - 0.5)"
    mid = f"({_horner(s.ACKLAM_A, f'({q} * {q})')} * {q} / {_horner(s.ACKLAM_B, f'({q} * {q})', True)})"
    start = f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {s.ACKLAM_LOW} THEN {side(p)} WHEN {p} > {1 - s.ACKLAM_LOW} THEN -{side(f'(1 - {p})')} ELSE {mid} END"
    return (
        f"(SELECT * EXCLUDE (_s, _u), _s - _u / (1 + _s * _u / 2) AS {out} FROM (SELECT *, ({cdf('_s')} - {p}) * {s.SQRT_TWO_PI!r} * exp(_s * _s / 2) AS _u"
        f" FROM (SELECT *, {start} AS _s FROM {src})))"
    )


def emax(src: str, n: str, out: str) -> str:
    """Subquery adding the expected maximum of ``n`` standard normals."""
    base = f"(SELECT *, 1 - 1.0 / {n} AS _p1, 1 - 1.0 / ({n} * {s.E!r}) AS _p2 FROM {src})"
    return (
        f"(SELECT * EXCLUDE (_p1, _p2, _z1, _z2), {1 - s.EULER_GAMMA!r} * _z1 + {s.EULER_GAMMA!r} * _z2 AS {out} FROM "
        + with_ppf(with_ppf(base, "_p1", "_z1"), "_p2", "_z2") + ")"
    )


PSR_Z = "((mean / sd - {b}) * sqrt(n - 1) / sqrt(greatest(1 - g3 * mean / sd + (g4 - 1) / 4 * (mean / sd) * (mean / sd), 1e-12)))"


def psr_sql(src: str, b: str, out: str) -> str:
    """Subquery adding the PSR from the moment columns (n, mean, sd, g3, g4)."""
    return f"(SELECT * EXCLUDE (_z), CASE WHEN n >= 2 AND sd > 0 THEN {cdf('_z')} END AS {out} FROM (SELECT *, {PSR_Z.format(b=b)} AS _z FROM {src}))"
