"""Lead-lag study: pooled panel regressions of forward returns on a predictor's past returns, for a whole grid at once.

Input is a dense hourly panel (symbol, ts, r) of log returns. Every (predictor, k, h) cell is a key column; nothing
loops over cells on the driver. Regressions reduce to grouped sums, so a cell's observations never meet in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import expected_max_normal, pearson, ratio, two_sided_p
from panelspark.layout import BLOCK_ROWS, group_quantiles, group_stats, settle, trailing
from panelspark.operators.ranking import best_cell
from panelspark.operators.windows import forward_sum, log_return, roll_sum
from panelspark.plans.resampling import bootstrap_ci

CELL = ("predictor", "k", "h")

# Study universes and the default grid.
PREDICTORS = ("BTCUSDT", "ETHUSDT")
MAJORS = ("BTCUSDT", "ETHUSDT", "BNBUSDT", "SOLUSDT", "XRPUSDT", "ADAUSDT", "AVAXUSDT", "LINKUSDT", "DOGEUSDT", "TRXUSDT")
MIDCAPS = (
    "LTCUSDT", "BCHUSDT", "ATOMUSDT", "DOTUSDT", "UNIUSDT", "ETCUSDT", "FILUSDT", "ALGOUSDT", "VETUSDT", "NEARUSDT",
    "AAVEUSDT", "SANDUSDT", "MANAUSDT", "EOSUSDT",
)
K_GRID = (1, 2, 3, 6)
H_GRID = (1, 2, 3, 4, 6)
MIN_OBSERVATIONS = 10


PRESETS = {"majors": (PREDICTORS, MAJORS), "midcap": (PREDICTORS, (*PREDICTORS, *MIDCAPS))}


def universe_preset(name: str, presets: dict[str, tuple[Sequence[str], Sequence[str]]] = PRESETS) -> tuple[Sequence[str], Sequence[str]]:
    """(predictors, symbols) of a named universe."""
    if name not in presets:
        raise ValueError(f"unknown universe {name!r}; choose one of {sorted(presets)}")
    return presets[name]


def select_universe(bars: DataFrame, name: str, presets: dict[str, tuple[Sequence[str], Sequence[str]]] = PRESETS) -> DataFrame:
    """Rows of the named universe with an ``is_predictor`` flag; the symbol filter reaches the scan."""
    predictors, symbols = universe_preset(name, presets)
    return bars.filter(F.col("symbol").isin(*symbols)).withColumn("is_predictor", F.col("symbol").isin(*predictors))


def preregister_grid(spark, predictors: Sequence[str], ks: Sequence[int] = K_GRID, hs: Sequence[int] = H_GRID) -> DataFrame:
    """The predictor x k x h grid with its size, to be written before any return is read."""
    cells = [(p, int(k), int(h)) for p in predictors for k in ks for h in hs]
    if min(ks) < 1:
        raise ValueError("look-ahead: k must be at least 1")
    return spark.createDataFrame(cells, "predictor string, k int, h int").withColumn("n_trials", F.lit(len(cells)))


def hourly_returns(bars: DataFrame) -> DataFrame:
    """Log returns on the union of all timestamps: (symbol, ts, r), NULL where either close is missing.

    The grid is the union of observed timestamps, so the row before is the previous observed timestamp of the panel.
    """
    grid = bars.select("ts").distinct().withColumn("step", F.row_number().over(Window.orderBy("ts")))  # one row per hour
    steps = F.sequence(F.lit(1), bars.agg(F.countDistinct("ts").cast("int")).scalar())
    frame = (
        bars.select("symbol").distinct().withColumn("step", F.explode(steps)).join(grid, "step")
        .join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    )
    body = lambda df, w: df.withColumn("r", log_return("close", w))
    return trailing(frame, 1, body, keys=["symbol"], pos="step", seconds=0).select("symbol", "ts", "step", "r")


def lagged_sums(panel: DataFrame, ks: Sequence[int], hs: Sequence[int], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Trailing sums past_k and forward sums fwd_h of r for all k and h in one pass over each series."""
    def body(df, w):
        return df.withColumns(
            {f"past_{k}": roll_sum("r", k, w) for k in ks} | {f"fwd_{h}": forward_sum("r", h, w) for h in hs}
        )

    return trailing(panel, max(ks), body, ahead=max(hs), keys=keys, pos="step", seconds=0).drop("r")


def wide_observations(
    panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, predictor, symbol, ts, step, pred_k…, past_k…, fwd_h…): every target against every predictor, the grid as columns."""
    keys = list(keys)
    sums = lagged_sums(panel, ks, hs, [*keys, "symbol"])
    pred = sums.filter(F.col("symbol").isin(*predictors)).select(
        *keys, F.col("symbol").alias("predictor"), "step", *[F.col(f"past_{k}").alias(f"pred_{k}") for k in ks]
    )
    return sums.join(pred, [*keys, "step"]).filter(F.col("symbol") != F.col("predictor"))


def observations(
    panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """Pooled rows (cell, symbol, ts, pred, own, fwd) of every target against every predictor."""
    keys = list(keys)
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"), F.lit(h).alias("h"), F.col(f"pred_{k}").alias("pred"), F.col(f"past_{k}").alias("own"),
                F.col(f"fwd_{h}").alias("fwd"),
            )
            for k in ks for h in hs
        ]
    )
    return wide_observations(panel, predictors, ks, hs, keys).select(*keys, "predictor", "symbol", "ts", "step", F.explode(cells).alias("_c")).select(
        *keys, "predictor", "_c.k", "_c.h", "symbol", "ts", "step", "_c.pred", "_c.own", "_c.fwd"
    )


def _per_cell(ks: Sequence[int], hs: Sequence[int], columns: Sequence[str], **named: str) -> Column:
    """One struct (k, h, …) per cell of the grid from columns named ``<column>_k_h``; ``named`` gives further ones as SQL of {k} and {h}."""
    field = lambda k, h: [f"{k} AS k", f"{h} AS h", *[f"{c}_{k}_{h} AS {c}" for c in columns], *[f"{q.format(k=k, h=h)} AS {n}" for n, q in named.items()]]
    return F.expr("array(" + ", ".join(f"struct({', '.join(field(k, h))})" for k in ks for h in hs) + ")")


# Expressions of a grid are many and alike, so they are written as SQL: a cell's rows are those that have all three values.
FULL = "pred_{k} IS NOT NULL AND past_{k} IS NOT NULL AND fwd_{h} IS NOT NULL"
PRODUCTS = {
    "sp": "pred_{k}", "so": "past_{k}", "sf": "fwd_{h}", "spp": "pred_{k} * pred_{k}", "spo": "pred_{k} * past_{k}", "soo": "past_{k} * past_{k}",
    "spf": "pred_{k} * fwd_{h}", "sof": "past_{k} * fwd_{h}", "sff": "fwd_{h} * fwd_{h}",
}


def _grid(ks: Sequence[int], hs: Sequence[int], **named: str) -> list[Column]:
    """Columns ``<name>_k_h`` of every cell from SQL of {k} and {h}."""
    return [F.expr(f"{q.format(k=k, h=h)} AS {n}_{k}_{h}") for k in ks for h in hs for n, q in named.items()]


def moment_cube(wide: DataFrame, ks: Sequence[int], hs: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, predictor, symbol, k, h) with counts and sums of products of complete rows, all cells from one aggregate of the wide rows.

    ``pairs`` counts rows that have predictor and forward return. The result has one row per cell and symbol, whatever the length of
    the series.
    """
    counts = {"n": f"count_if({FULL})", "pairs": "count_if(pred_{k} IS NOT NULL AND fwd_{h} IS NOT NULL)"}
    sums = {n: f"sum(CASE WHEN {FULL} THEN {x} END)" for n, x in PRODUCTS.items()}
    wide_sums = wide.groupBy(*keys, "predictor", "symbol").agg(*_grid(ks, hs, **counts, **sums))
    return wide_sums.select(*keys, "predictor", "symbol", F.explode(_per_cell(ks, hs, [*counts, *sums])).alias("_c")).select(*keys, "predictor", "symbol", "_c.*")


def cube_ols(cube: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """``pooled_ols`` with symbol means removed, from the cube's sums alone; ``ee`` is the residual sum of squares."""
    inside = lambda xy, x, y: F.sum(F.col(f"s{xy}") - F.col(f"s{x}") * F.col(f"s{y}") / F.col("n"))
    sums = cube.filter("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("n_obs"), inside("pp", "p", "p").alias("a11"), inside("po", "p", "o").alias("a12"), inside("oo", "o", "o").alias("a22"),
        inside("pf", "p", "f").alias("b1"), inside("of", "o", "f").alias("b2"), inside("ff", "f", "f").alias("yy"),
    )
    return _solved(sums, keys, ee=F.col("yy") - F.col("beta") * F.col("b1") - F.col("gamma") * F.col("b2"))


def wide_scores(wide: DataFrame, cube: DataFrame, fit: DataFrame, ks: Sequence[int], hs: Sequence[int]) -> DataFrame:
    """Wide rows with the centred forward return ``y_k_h`` and the scores ``s1_k_h``, ``s2_k_h`` of every cell; NULL where incomplete.

    Means, betas and pair counts travel as one row per (predictor, symbol).
    """
    params = cube.join(fit.select(*CELL, "beta", "gamma"), list(CELL)).filter("n > 0 OR pairs > 0")
    of = {"mp": "sp / nullif(n, 0)", "mo": "so / nullif(n, 0)", "mf": "sf / nullif(n, 0)", "beta": "beta", "gamma": "gamma", "pairs": "pairs"}
    table = params.groupBy("predictor", "symbol").agg(*_grid(ks, hs, **{n: f"max(CASE WHEN k = {{k}} AND h = {{h}} THEN {q} END)" for n, q in of.items()}))
    rest = "fwd_{h} - mf_{k}_{h} - beta_{k}_{h} * (pred_{k} - mp_{k}_{h}) - gamma_{k}_{h} * (past_{k} - mo_{k}_{h})"
    # a missing value in any of the three makes all of these NULL by itself
    joined = wide.join(table, ["predictor", "symbol"]).select("*", *_grid(ks, hs, y=f"CASE WHEN {FULL} THEN fwd_{{h}} - mf_{{k}}_{{h}} END", e=rest))
    return joined.select(
        "predictor", "symbol", "ts", "step", *[f"pred_{k}" for k in ks], *[f"fwd_{h}" for h in hs], *[f"{n}_{k}_{h}" for k in ks for h in hs for n in ("pairs", "y")],
        *_grid(ks, hs, s1="(pred_{k} - mp_{k}_{h}) * e_{k}_{h}", s2="(past_{k} - mo_{k}_{h}) * e_{k}_{h}"),
    )


def hourly_cells(scored: DataFrame, ks: Sequence[int], hs: Sequence[int]) -> DataFrame:
    """One row per (cell, ts): sums over the targets that clustering, IC and decile spread need, from one aggregate of the wide rows.

    ``n``, ``sy``: complete rows and their signs of y; ``g``, ``g1``, ``g2``: rows with scores and their sums; ``m10``, ``f10`` and ``m20``, ``f20``:
    pairs and their forward returns of symbols with at least ten and twenty pairs.
    """
    sums = {"n": "count(y_{k}_{h})", "sy": "sum(signum(y_{k}_{h}))", "g": "count(s1_{k}_{h})", "g1": "sum(s1_{k}_{h})", "g2": "sum(s2_{k}_{h})"}
    for least in (10, 20):
        use = f"pred_{{k}} IS NOT NULL AND fwd_{{h}} IS NOT NULL AND pairs_{{k}}_{{h}} >= {least}"
        sums |= {f"m{least}": f"count_if({use})", f"f{least}": f"sum(CASE WHEN {use} THEN fwd_{{h}} END)"}
    wide = scored.groupBy("predictor", "ts").agg(*[F.max(f"pred_{k}").alias(f"pred_{k}") for k in ks], *_grid(ks, hs, **sums))
    return wide.select("predictor", "ts", F.explode(_per_cell(ks, hs, list(sums), pred="pred_{k}")).alias("_c")).select("predictor", "ts", "_c.*")


def demeaned(obs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Complete rows with per-symbol means removed (fixed effects); the raw predictor stays as ``pred``."""
    full = obs.filter(F.col("pred").isNotNull() & F.col("own").isNotNull() & F.col("fwd").isNotNull())
    means = group_stats(full, [*keys, "symbol"], F.avg("pred").alias("_mp"), F.avg("own").alias("_mo"), F.avg("fwd").alias("_mf"))
    return means.withColumns(
        {"x1": F.col("pred") - F.col("_mp"), "x2": F.col("own") - F.col("_mo"), "y": F.col("fwd") - F.col("_mf")}
    ).drop("_mp", "_mo", "_mf")


def pooled_ols(rows: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """beta, gamma and the inverse normal matrix per cell from five sums; below ten rows, or singular, NULL."""
    x1, x2, y = F.col("x1"), F.col("x2"), F.col("y")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(x1 * x1).alias("a11"), F.sum(x1 * x2).alias("a12"),
        F.sum(x2 * x2).alias("a22"), F.sum(x1 * y).alias("b1"), F.sum(x2 * y).alias("b2"),
    )
    return _solved(sums, keys)


def _solved(sums: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """Solution and inverse of the two-variable normal equations in a11, a12, a22, b1, b2; ``more`` may use beta and gamma."""
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    ok = (F.col("n_obs") >= MIN_OBSERVATIONS) & (det > 0)
    over = lambda v: F.when(ok, v / F.nullif(det, F.lit(0.0)))
    solved = sums.withColumns({
        "beta": over(F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")), "gamma": over(F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")),
        "i11": over(F.col("a22")), "i12": over(-F.col("a12")), "i22": over(F.col("a11")),
    })
    return solved.select(*keys, "n_obs", "beta", "gamma", "i11", "i12", "i22", *[c.alias(n) for n, c in more.items()])


def _sandwich(m11: Column, m12: Column, m22: Column) -> Column:
    """First diagonal entry of (X'X)^-1 M (X'X)^-1."""
    i11, i12 = F.col("i11"), F.col("i12")
    return i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22


def scores(rows: DataFrame, fit: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    resid = F.col("y") - F.col("beta") * F.col("x1") - F.col("gamma") * F.col("x2")
    return rows.join(fit.filter(F.col("beta").isNotNull()).select(*keys, "beta", "gamma"), list(keys)).withColumn("e", resid).withColumns(
        {"s1": F.col("x1") * F.col("e"), "s2": F.col("x2") * F.col("e")}
    ).drop("beta", "gamma")


def clustered_variance(scored: DataFrame, fit: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Variance of beta clustered by timestamp, with the G/(G-1) * (n-1)/(n-p) correction."""
    return _clustered(scored.groupBy(*keys, "ts").agg(F.sum("s1").alias("g1"), F.sum("s2").alias("g2")), fit, keys)


def _clustered(per_ts: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    g1, g2 = F.col("g1"), F.col("g2")
    meat = per_ts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_g"), F.sum(g1 * g1).alias("m11"), F.sum(g1 * g2).alias("m12"), F.sum(g2 * g2).alias("m22")
    )
    factor = F.try_divide(F.col("_g").cast("double"), F.col("_g") - 1) * F.try_divide((F.col("n_obs") - 1).cast("double"), F.col("n_obs") - 2)
    return fit.join(meat, list(keys)).select(*keys, (factor * _sandwich(F.col("m11"), F.col("m12"), F.col("m22"))).alias("var_cluster"))


def newey_west_variance(
    scored: DataFrame, fit: DataFrame, hs: Sequence[int], keys: Sequence[str] = CELL, stacked: bool = False, *, block: int = BLOCK_ROWS
) -> DataFrame:
    """Bartlett-weighted variance of beta with h - 1 lags; h = 1 is the classic residual variance.

    Lags run inside each symbol, over its complete rows. Products of lags are summed in blocks of ``block`` steps, and the last and
    first h - 1 rows of the blocks, numbered through, give the pairs across an edge; so no task sees a whole series.
    ``stacked=True`` adds the pairs that cross from one symbol's last rows to the next symbol's first rows, as a lag over the
    concatenated rows would.
    """
    keys = list(keys)
    reach = max(hs) - 1
    parts = [*keys, "symbol", "_seg"]
    cut = scored.withColumn("_seg", F.floor(F.col("step") / F.lit(block)))
    w, whole = Window.partitionBy(*parts).orderBy("step"), Window.partitionBy(*parts)
    lags = range(1, reach + 1)
    weight = lambda l: F.greatest(1 - F.lit(float(l)) / F.col("h"), F.lit(0.0))
    lagged = cut.withColumns(
        {f"_{s}_{l}": F.lag(s, l).over(w) for s in ("s1", "s2") for l in lags} | {"_a": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)}
    )
    meat = _lag_products(F.col("s1"), F.col("s2"), [(weight(l), F.col(f"_s1_{l}"), F.col(f"_s2_{l}")) for l in lags])
    sums = lagged.groupBy(*keys).agg(*[F.sum(m).alias(n) for n, m in meat.items()], F.sum(F.col("e") * F.col("e")).alias("ee"))
    if reach:
        edges = lagged.filter((F.col("_a") <= reach) | (F.col("_n") - F.col("_a") < reach)).select(*parts, "_a", "_n", "s1", "s2")
        sums = _with_edges(sums, edges, reach, keys, stacked)
    return _hac(fit.drop("ee").join(sums, keys), keys)


def _lag_products(s1: Column, s2: Column, lags: Sequence[tuple[Column, Column, Column]]) -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m11, m12, m22 = s1 * s1, s1 * s2, s2 * s2
    for weight, p1, p2 in lags:
        m11, m12, m22 = m11 + weight * 2 * s1 * zero(p1), m12 + weight * (s1 * zero(p2) + s2 * zero(p1)), m22 + weight * 2 * s2 * zero(p2)
    return {"m11": m11, "m12": m12, "m22": m22}


def _hac(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    classic = F.try_divide(F.col("ee"), F.greatest(F.col("n_obs") - 2, F.lit(1))) * F.col("i11")
    robust = _sandwich(F.col("m11"), F.col("m12"), F.col("m22"))
    return sums.select(*keys, F.when(F.col("h") == 1, classic).otherwise(robust).alias("var_hac"))


def _with_edges(sums: DataFrame, edges: DataFrame, reach: int, keys: Sequence[str], stacked: bool) -> DataFrame:
    """Add the lag products between rows of different blocks to ``m11``, ``m12``, ``m22``.

    ``edges``: (keys, symbol, _seg, _a, _n, s1, s2), the first and last ``reach`` rows of every block with their place and the block's
    size. Numbered through in the order of symbol and block, rows at most ``reach`` apart pair up; a block of fewer rows is its own edge.
    """
    sizes = edges.groupBy(*keys, "symbol", "_seg").agg(F.max("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("symbol", "_seg").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = sizes.select(*keys, "symbol", "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = edges.join(starts, [*keys, "symbol", "_seg"]).withColumn("_row", F.col("_start") + F.col("_a"))
    right = placed.select(
        *keys, F.col("symbol").alias("_sym"), F.col("_seg").alias("_oseg"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
        F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_l"), "_row",
    ).withColumn("_row", F.col("_row") + F.col("_l"))
    same = F.col("symbol") == F.col("_sym")
    apart = (same & (F.col("_seg") != F.col("_oseg"))) | (~same if stacked else F.lit(False))
    pairs = placed.join(right, [*keys, "_row"]).filter(apart)
    wl = F.greatest(1 - F.col("_l") / F.col("h"), F.lit(0.0))
    s1, s2, p1, p2 = (F.col(c) for c in ("s1", "s2", "p1", "p2"))
    cross = pairs.groupBy(*keys).agg(
        F.sum(wl * 2 * s1 * p1).alias("c11"), F.sum(wl * (s1 * p2 + s2 * p1)).alias("c12"), F.sum(wl * 2 * s2 * p2).alias("c22")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rest = [c for c in sums.columns if c not in (*keys, "m11", "m12", "m22")]
    return sums.join(cross, list(keys), "left").select(*keys, *rest, *[(F.col(m) + zero(F.col(f"c{m[1:]}"))).alias(m) for m in ("m11", "m12", "m22")])


def wide_newey_west(scored: DataFrame, fit: DataFrame, ks: Sequence[int], hs: Sequence[int], stacked: bool = False, *, block: int = BLOCK_ROWS) -> DataFrame:
    """``newey_west_variance`` of all cells from the wide scores: lags skip the rows that a cell has not got, so no row is copied per cell.

    ``fit`` carries the residual sums ``ee`` of ``cube_ols``.
    """
    reach = max(hs) - 1
    parts = "predictor, symbol, _seg"
    over = f"OVER (PARTITION BY {parts} ORDER BY step)"
    cells = [(k, h) for k in ks for h in hs if h > 1]
    if not cells:
        return _hac(fit.withColumns({m: F.lit(0.0) for m in ("m11", "m12", "m22")}), CELL)
    cut = scored.select("predictor", "symbol", "step", F.floor(F.col("step") / F.lit(block)).alias("_seg"), *[f"{s}_{k}_{h}" for k, h in cells for s in ("s1", "s2")])
    new = [f"lag({s}_{k}_{h}, {l}) IGNORE NULLS {over} AS {s}_{k}_{h}_{l}" for k, h in cells for s in ("s1", "s2") for l in range(1, h)]
    new += [q for k, h in cells for q in (f"count(s1_{k}_{h}) {over} AS a_{k}_{h}", f"count(s1_{k}_{h}) OVER (PARTITION BY {parts}) AS z_{k}_{h}")]
    lagged = cut.selectExpr("*", *new)
    aggs, each, edge = [], [], []
    for k, h in cells:
        c = f"{k}_{h}"
        lags = [(1 - l / h, f"coalesce(s1_{c}_{l}, 0D)", f"coalesce(s2_{c}_{l}, 0D)") for l in range(1, h)]
        meat = {
            "m11": " + ".join([f"s1_{c} * s1_{c}", *[f"{w!r}D * 2 * s1_{c} * {p1}" for w, p1, _ in lags]]),
            "m12": " + ".join([f"s1_{c} * s2_{c}", *[f"{w!r}D * (s1_{c} * {p2} + s2_{c} * {p1})" for w, p1, p2 in lags]]),
            "m22": " + ".join([f"s2_{c} * s2_{c}", *[f"{w!r}D * 2 * s2_{c} * {p2}" for w, _, p2 in lags]]),
        }
        aggs += [F.expr(f"sum({q}) AS {n}_{c}") for n, q in meat.items()]
        each.append(f"struct({k} AS k, {h} AS h, " + ", ".join(f"{n}_{c} AS {n}" for n in meat) + ")")
        edge.append(f"CASE WHEN s1_{c} IS NOT NULL AND (a_{c} <= {reach} OR z_{c} - a_{c} < {reach}) THEN struct({k} AS k, {h} AS h, a_{c} AS _a, z_{c} AS _n, s1_{c} AS s1, s2_{c} AS s2) END")
    sums = lagged.groupBy("predictor").agg(*aggs).select("predictor", F.expr(f"explode(array({', '.join(each)})) AS _c")).select("predictor", "_c.*")
    edges = lagged.select("predictor", "symbol", "_seg", F.expr(f"explode(array_compact(array({', '.join(edge)}))) AS _c")).select("predictor", "symbol", "_seg", "_c.*")
    full = _with_edges(sums, edges, reach, CELL, stacked)
    return _hac(fit.join(full, list(CELL), "left"), CELL)


def combined_test(fit: DataFrame, hac: DataFrame, cluster: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """beta with the larger of both variances, t and the two-sided normal p (1 where undefined)."""
    se = F.sqrt(F.greatest("var_hac", "var_cluster", F.lit(0.0)))
    out = fit.join(hac, list(keys), "left").join(cluster, list(keys), "left").withColumn("se", F.when(F.col("beta").isNotNull(), se))
    t = ratio("beta", F.when(F.col("se") > 0, F.col("se")))
    return out.select(*keys, "n_obs", "beta", "gamma", "se", t.alias("t_stat")).withColumn(
        "p_value", F.coalesce(two_sided_p("t_stat"), F.lit(1.0))
    )


def sign_ic(rows: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean over timestamps with two or more targets of sign(pred) * mean(sign(demeaned forward return))."""
    per_ts = rows.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.signum("y")).alias("_s"), F.first("pred").alias("_p")
    ).filter(F.col("_n") >= 2)
    return per_ts.groupBy(*keys).agg(F.avg(F.signum("_p") * F.col("_s")).alias("rank_ic"))


def hourly_sign_ic(hourly: DataFrame) -> DataFrame:
    """``sign_ic`` from the sums of ``hourly_cells``."""
    return hourly.filter("n >= 2").groupBy(*CELL).agg(F.avg(F.signum("pred") * F.col("sy") / F.col("n")).alias("rank_ic"))


def bh_fdr(cells: DataFrame, p: str = "p_value", order: Sequence[str] = CELL, out: str = "bh_q") -> DataFrame:
    """Benjamini-Hochberg q over one row per cell of a pre-registered grid."""
    n = cells.agg(F.count(F.lit(1))).scalar()
    ranked = cells.withColumn("_rank", F.row_number().over(Window.orderBy(p, *order)))
    raw = F.least(F.lit(1.0), F.col(p) * n / F.col("_rank"))
    w = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_raw", raw).withColumn(out, F.min("_raw").over(w)).drop("_rank", "_raw")


def deflated_ic(ic: Column, n_trials: Column, n_obs: Column) -> Column:
    """IC less the expected best of n_trials skill-less ICs; unchanged below two trials."""
    haircut = expected_max_normal(F.greatest(n_trials, F.lit(2))) / F.sqrt(F.greatest(n_obs, F.lit(400)))
    return F.when(n_trials < 2, ic).otherwise(ic - haircut)


def decile_spread(obs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean forward return in the top decile of the predictor less the bottom decile, in basis points.

    Symbols with fewer than 20 pairs, and cells with fewer than 20 rows, contribute nothing (0).
    """
    pairs = obs.filter(F.col("pred").isNotNull() & F.col("fwd").isNotNull())
    counted = group_stats(pairs, [*keys, "symbol"], F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 20)
    cuts = group_quantiles(counted, keys, "pred", {"_q10": 0.1, "_q90": 0.9})
    means = counted.join(cuts, list(keys)).groupBy(*keys).agg(
        F.avg(F.when(F.col("pred") >= F.col("_q90"), F.col("fwd"))).alias("_top"),
        F.avg(F.when(F.col("pred") <= F.col("_q10"), F.col("fwd"))).alias("_bottom"),
    )
    return means.select(*keys, (F.coalesce(F.col("_top") - F.col("_bottom"), F.lit(0.0)) * 1e4).alias("spread_bps"))


def hourly_decile_spread(hourly: DataFrame) -> DataFrame:
    """``decile_spread`` from the sums of ``hourly_cells``: a predictor value stands for all pairs of its hour."""
    pairs = hourly.filter("m20 > 0 AND pred IS NOT NULL")
    cuts = group_quantiles(pairs, CELL, "pred", {"_q10": 0.1, "_q90": 0.9}, copies="m20")
    mean = lambda inside: F.try_divide(F.sum(F.when(inside, F.col("f20"))), F.sum(F.when(inside, F.col("m20"))))
    means = pairs.join(cuts, list(CELL)).groupBy(*CELL).agg(mean(F.col("pred") >= F.col("_q90")).alias("_top"), mean(F.col("pred") <= F.col("_q10")).alias("_bottom"))
    return means.select(*CELL, (F.coalesce(F.col("_top") - F.col("_bottom"), F.lit(0.0)) * 1e4).alias("spread_bps"))


def per_year_beta(panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int]) -> DataFrame:
    """beta per cell and calendar year, windows restarting inside each year, plus the same-sign flag."""
    yearly = panel.withColumn("year", F.year("ts"))
    keys = (*CELL, "year")
    fit = cube_ols(moment_cube(wide_observations(yearly, predictors, ks, hs, ["year"]), ks, hs, ["year"]), keys)
    return fit.select(*keys, "n_obs", "beta")


def same_sign(yearly: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    signs = yearly.groupBy(*keys).agg(F.count("beta").alias("_n"), F.min(F.signum("beta")).alias("_lo"), F.max(F.signum("beta")).alias("_hi"))
    return signs.select(*keys, ((F.col("_n") >= 2) & (F.col("_lo") == F.col("_hi"))).alias("same_sign_all_years"))


def nonoverlap_beta(panel: DataFrame, predictor: str, k: int, h: int) -> DataFrame:
    """Beta and p at horizon 1 on every h-th timestamp of the panel, where no two forward returns overlap."""
    thin = panel.filter(F.pmod(F.col("step") - 1, F.lit(h)) == 0).withColumn("step", F.expr(f"(step - 1) div {h} + 1").cast("int"))
    wide = settle(wide_observations(thin, [predictor], [k], [1]), "thin")
    cube = moment_cube(wide, [k], [1])
    fit = settle(cube_ols(cube), "thin-fit")
    hourly = hourly_cells(wide_scores(wide, cube, fit, [k], [1]), [k], [1])
    tested = combined_test(fit, wide_newey_west(wide, fit, [k], [1]), _clustered(hourly.filter("g > 0"), fit, CELL))
    return tested.select("predictor", "k", F.lit(h).alias("h"), "n_obs", "beta", "p_value")


def ic_series(obs: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Per timestamp the mean over targets of sign(pred) * fwd, for the bootstrap; symbols below ten pairs drop out."""
    pairs = obs.filter(F.col("pred").isNotNull() & F.col("fwd").isNotNull())
    counted = group_stats(pairs, [*keys, "symbol"], F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 10)
    return counted.groupBy(*keys, F.col("ts").alias("date")).agg(F.avg(F.signum("pred") * F.col("fwd")).alias("ret"))


def rolling_ic(panel: DataFrame, predictor: str, k: int, h: int, n: int = 1440) -> DataFrame:
    """Rolling mean of sum(sign(pred) * fwd over targets) / number of targets; a missing target counts as 0."""
    targets = panel.filter(F.col("symbol") != predictor).agg(F.countDistinct("symbol")).scalar()
    obs = observations(panel, [predictor], [k], [h])
    pairs = obs.filter(F.col("pred").isNotNull() & F.col("fwd").isNotNull())
    per_ts = pairs.groupBy("ts").agg((F.sum(F.signum("pred") * F.col("fwd")) / targets).alias("ic"))
    w = Window.orderBy("ts").rowsBetween(-(n - 1), 0)  # one row per hour
    return per_ts.withColumn("rolling_ic", F.when(F.count("ic").over(w) == n, F.avg("ic").over(w)))


def cross_correlation(panel: DataFrame, predictor: str, lags: Sequence[int] = tuple(range(-6, 7))) -> DataFrame:
    """Correlation of the predictor at t with each target at t + lag on the aligned rows."""
    pred = panel.filter(F.col("symbol") == predictor).select("ts", F.col("r").alias("p"))
    aligned = panel.filter(F.col("symbol") != predictor).join(pred, "ts").filter(F.col("p").isNotNull() & F.col("r").isNotNull())
    w = Window.partitionBy("symbol").orderBy("ts")
    moved = lambda lag: F.lead("r", lag).over(w) if lag >= 0 else F.lag("r", -lag).over(w)
    shifted = aligned.select("symbol", "ts", "p", *[moved(l).alias(f"r{i}") for i, l in enumerate(lags)])
    cells = F.array(*[F.struct(F.lit(l).alias("lag"), F.col(f"r{i}").alias("r")) for i, l in enumerate(lags)])
    tall = shifted.select("symbol", "p", F.explode(cells).alias("_c")).select("symbol", "p", "_c.*")
    out = tall.groupBy("symbol", "lag").agg(F.count(F.lit(1)).alias("_all"), F.count("r").alias("n"), pearson("p", "r").alias("_c"))
    ok = (F.col("_all") >= 20) & (F.col("n") >= 10)
    return out.select("symbol", "lag", F.when(ok, F.col("_c")).alias("corr"))


def beta_grid(cells: DataFrame, predictor: str, hs: Sequence[int]) -> DataFrame:
    """beta over k (rows) and h (columns) of one predictor; the column list is the grid's own."""
    return cells.filter(F.col("predictor") == predictor).groupBy("k").pivot("h", list(hs)).agg(F.first("beta")).select(
        "k", *[F.col(str(h)).alias(f"h{h}") for h in hs]
    )


def _measured(panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int], stacked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(beta, t, p, IC and q per cell, sums per cell and hour). Rows are read three times as wide rows; cells become rows only as sums."""
    wide = settle(wide_observations(panel, predictors, ks, hs), "wide")
    cube = settle(moment_cube(wide, ks, hs), "cube")
    fit = settle(cube_ols(cube), "fit")
    scored = wide_scores(wide, cube, fit, ks, hs)
    hourly = settle(hourly_cells(scored, ks, hs), "cell-hours")
    clustered = _clustered(hourly.filter("g > 0"), fit, CELL)
    tested = combined_test(fit, wide_newey_west(scored, fit, ks, hs, stacked), clustered)
    return bh_fdr(tested.join(hourly_sign_ic(hourly), list(CELL), "left")), hourly


def run_cells(panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int], stacked: bool = False) -> DataFrame:
    """beta, t, p, IC and q of every cell of the grid in one plan."""
    return _measured(panel, predictors, ks, hs, stacked)[0]


def analyze(
    panel: DataFrame, predictors: Sequence[str], ks: Sequence[int], hs: Sequence[int], *, resamples: int = 500, seed: int = 42
) -> DataFrame:
    """All statistics per cell, one row each; the best cell also has ``nonoverlap_beta`` and ``nonoverlap_p``, the others NULL."""
    n_trials = len(predictors) * len(ks) * len(hs)
    measured, hourly = _measured(panel, predictors, ks, hs)
    cells = settle(measured, "cells")
    ics = hourly.filter("m10 > 0").select(*CELL, F.col("ts").alias("date"), (F.signum("pred") * F.col("f10") / F.col("m10")).alias("ret"))
    ci = bootstrap_ci(
        ics, block=F.greatest(F.col("h"), F.lit(1)).cast("double"), resamples=resamples, seed=seed, statistic=F.avg, keys=CELL
    ).select(*CELL, F.col("lo").alias("ic_ci_lo"), F.col("hi").alias("ic_ci_hi"))
    on = list(CELL)
    out = (
        cells
        .withColumn("deflated_ic", deflated_ic(F.coalesce("rank_ic", F.lit(0.0)), F.lit(n_trials), F.col("n_obs")))
        .join(ci, on, "left")
        .join(same_sign(per_year_beta(panel, predictors, ks, hs)), on, "left")
        .join(hourly_decile_spread(hourly), on, "left")
    )
    best = best_cell(cells).select(*CELL).first()  # the name of one cell
    if best is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("nonoverlap_beta", "nonoverlap_p")})
    check = nonoverlap_beta(panel, best.predictor, best.k, best.h)
    return out.join(check.select(*CELL, F.col("beta").alias("nonoverlap_beta"), F.col("p_value").alias("nonoverlap_p")), on, "left")


def verdict(cells: DataFrame, roundtrip_bps: float) -> DataFrame:
    """Four gates on the best cell: significance, sign stability, economics, and an IC peak inside the horizon range."""
    best = best_cell(cells)
    profile = cells.groupBy("predictor", "k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("h").alias("_first"), F.max("h").alias("_last"),
        F.min_by("h", F.struct(-F.coalesce("rank_ic", F.lit(0.0)), F.col("h"))).alias("_peak"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    return best.join(profile, ["predictor", "k"]).select(
        "predictor", "k", "h", "beta", "bh_q", "deflated_ic", "ic_ci_lo", "rank_ic", "spread_bps",
        (F.col("spread_bps") - roundtrip_bps).alias("net_edge_bps"),
        no((F.col("bh_q") < 0.05) & (F.col("deflated_ic") > 0) & (F.col("ic_ci_lo") > 0)).alias("statistical"),
        no(F.col("same_sign_all_years")).alias("regime_stable"),
        no((F.col("spread_bps") > 3 * roundtrip_bps) & (F.col("rank_ic") >= 0.03)).alias("economic"),
        ((F.col("_n") < 3) | ((F.col("_peak") > F.col("_first")) & (F.col("_peak") < F.col("_last")))).alias("coherent_decay"),
    ).withColumn("go", F.col("statistical") & F.col("regime_stable") & F.col("economic") & F.col("coherent_decay"))
