"""Experiment recipes as parameter rows, and the sweep that runs all weight-based recipes in one plan."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.scalar import ratio
from panelspark.layout import settle, trailing
from panelspark.operators.asof import asof
from panelspark.operators.portfolio import (
    FEE_PRESETS, MAKER_FILL_HAIRCUT, Tilt, carried, froth_signal, inverse_vol_weights, portfolio_returns, strong_trend, tilt_chain,
)
from panelspark.operators.ranking import liquidity_schedule
from panelspark.operators.windows import momentum, oi_divergence, ref, regime_exposure, roll_mean, roll_std

# Instruments every point-in-time universe adds, in order.
PIT_ADDITIONS = (
    "DASHUSDT", "ZECUSDT", "QTUMUSDT", "ICXUSDT", "FTTUSDT", "WAVESUSDT", "OMGUSDT", "XEMUSDT", "BTGUSDT", "NANOUSDT", "LUNCUSDT",
)

# The knobs of every recipe. A family gives the defaults, each recipe only what differs.
SCORE_BOOK = {"model": "boosted", "factors": "ohlcv_windows", "label_horizon": 5, "purge_days": 6, "topk": 10}
GATED_SCORE_BOOK = {**SCORE_BOOK, "regime_mode": "binary", "ma_window": 200}
EQUAL_BOOK = {**GATED_SCORE_BOOK, "model": "constant", "vol_target": 0.50}
VOL_BOOK = {
    "model": "constant", "factors": "ohlcv_windows", "label_horizon": 5, "purge_days": 6, "weighting": "inverse_vol",
    "vol_lookback": 30, "regime_mode": "binary", "ma_window": 200, "vol_target": 0.50, "universe": "majors",
}
NULL_BOOK = {**VOL_BOOK, "universe": "full_liquid", "member_top_n": 10, "member_lookback": 30}
MOMENTUM = {**NULL_BOOK, "momentum_lookback": 30, "momentum_k": 1.0}
OI = {**NULL_BOOK, "oi_lookback": 14, "oi_k": 1.0}
RECIPES: dict[str, dict] = {
    "skeleton": {**SCORE_BOOK, "label_horizon": 1, "purge_days": 2, "topk": 5},
    "steady": SCORE_BOOK,
    "linear_steady": {**SCORE_BOOK, "model": "ridge"},
    "alpha360_steady": {**SCORE_BOOK, "factors": "ohlcv_lags"},
    "h1_steady": {**SCORE_BOOK, "label_horizon": 1, "purge_days": 2},
    "h10_steady": {**SCORE_BOOK, "label_horizon": 10, "purge_days": 11},
    "h20_steady": {**SCORE_BOOK, "label_horizon": 20, "purge_days": 21},
    "crossasset_steady": {**SCORE_BOOK, "extra_features": "cross_asset"},
    "funding_steady": {**SCORE_BOOK, "extra_features": "funding"},
    "derivatives_steady": {**SCORE_BOOK, "extra_features": "derivatives"},
    "funding_crossasset_steady": {**SCORE_BOOK, "extra_features": "cross_asset+funding"},
    "regime_steady": GATED_SCORE_BOOK,
    "regime_fast": {**GATED_SCORE_BOOK, "ma_window": 100},
    "regime_cross": {**GATED_SCORE_BOOK, "regime_mode": "cross", "ma_fast": 50},
    "regime_graded": {**GATED_SCORE_BOOK, "regime_mode": "graded", "band": 0.05, "chop": 0.5},
    "regime_voltarget": {**GATED_SCORE_BOOK, "vol_target": 0.50},
    "regime_funding_voltarget": {**GATED_SCORE_BOOK, "vol_target": 0.50, "extra_features": "funding"},
    "regime_crossasset_voltarget": {**GATED_SCORE_BOOK, "vol_target": 0.50, "extra_features": "cross_asset"},
    "regime_equalweight": {**EQUAL_BOOK, "topk": 19},
    "regime_equalweight_majors": EQUAL_BOOK,
    "regime_equalweight_top5": {**EQUAL_BOOK, "topk": 5},
    "regime_volweight_majors": VOL_BOOK,
    "beta_null": NULL_BOOK,
    "beta_null_confirm2": {**NULL_BOOK, "confirm": 2},
    "beta_null_confirm3": {**NULL_BOOK, "confirm": 3},
    "beta_null_confirm5": {**NULL_BOOK, "confirm": 5},
    "beta_null_confirm10": {**NULL_BOOK, "confirm": 10},
    "beta_null_vt40": {**NULL_BOOK, "vol_target": 0.40},
    "beta_null_vt45": {**NULL_BOOK, "vol_target": 0.45},
    "beta_null_vt55": {**NULL_BOOK, "vol_target": 0.55},
    "beta_null_vt60": {**NULL_BOOK, "vol_target": 0.60},
    "beta_null_hicost": {**NULL_BOOK, "haircut": 0.00043309643984270344},
    "momentum_tilt": MOMENTUM,
    "momentum_tilt_k05": {**MOMENTUM, "momentum_k": 0.5},
    "momentum_tilt_k15": {**MOMENTUM, "momentum_k": 1.5},
    "momentum_tilt_k20": {**MOMENTUM, "momentum_k": 2.0},
    "momentum_tilt_l14": {**MOMENTUM, "momentum_lookback": 14},
    "momentum_tilt_l60": {**MOMENTUM, "momentum_lookback": 60},
    "momentum_tilt_l90": {**MOMENTUM, "momentum_lookback": 90},
    "momentum_tilt_hicost": {**MOMENTUM, "haircut": 0.00043309643984270344},
    "basis_froth": {**NULL_BOOK, "froth_lookback": 90, "froth_z": 1.5, "froth_derisk": 0.0},
    "basis_tilt": {**NULL_BOOK, "crowding_k": 1.0},
    "oi_divergence_tilt": OI,
    "oi_divergence_directional": {**OI, "oi_directional": True},
    "oi_div_strong_trend": {**OI, "oi_directional": True, "oi_trend_margin": 0.25},
    "smart_money_tilt": {**NULL_BOOK, "smart_k": 1.0},
    "onchain_regime": {**NULL_BOOK, "onchain_window": 365, "onchain_z": 1.0, "onchain_derisk": 0.0},
    "tsmom_voltarget": {**NULL_BOOK, "trend_window": 100},
    "tsmom_voltarget_w200": {**NULL_BOOK, "trend_window": 200},
    "tsmom_compose": {**NULL_BOOK, "trend_window": 100, "compose_market_gate": True},
}

PARAM_SCHEMA = T.StructType(
    [T.StructField("recipe", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for n in ("model", "factors", "extra_features", "weighting", "regime_mode", "universe")]
    + [
        T.StructField(n, T.IntegerType())
        for n in (
            "label_horizon", "purge_days", "topk", "vol_lookback", "ma_window", "ma_fast", "confirm", "member_top_n", "member_lookback",
            "momentum_lookback", "oi_lookback", "froth_lookback", "onchain_window", "trend_window",
        )
    ]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "vol_target", "band", "chop", "haircut", "momentum_k", "oi_k", "oi_trend_margin", "crowding_k", "smart_k", "froth_z",
            "froth_derisk", "onchain_z", "onchain_derisk",
        )
    ]
    + [T.StructField(n, T.BooleanType()) for n in ("oi_directional", "compose_market_gate")]
)


def recipe_table(spark) -> DataFrame:
    """Every recipe as one row of knobs; an absent knob is NULL."""
    rows = [{"recipe": name, **knobs} for name, knobs in RECIPES.items()]
    return spark.createDataFrame([tuple(r.get(f.name) for f in PARAM_SCHEMA.fields) for r in rows], PARAM_SCHEMA)


def resolve_recipe(name: str, table: dict[str, dict] = RECIPES) -> dict:
    if name not in table:
        raise ValueError(f"unknown recipe {name!r}; choose one of {', '.join(sorted(table))}")
    return table[name]


def with_pit_universe(universe: DataFrame) -> DataFrame:
    """(instrument, position) with the point-in-time additions appended once each, survivors first."""
    size = universe.agg(F.max("position")).scalar()
    more = universe.sparkSession.createDataFrame(
        [(s, i + 1) for i, s in enumerate(PIT_ADDITIONS)], "instrument string, position int"
    ).withColumn("position", F.col("position") + size)
    return universe.unionByName(more).groupBy("instrument").agg(F.min("position").alias("position"))


def sweep_names() -> list[str]:
    return [n for n, r in RECIPES.items() if r.get("weighting") == "inverse_vol"]


def recipe_sweep(
    panel: DataFrame, benchmark: str, onchain: DataFrame | None = None, recipes: Sequence[str] | None = None, *,
    table: dict[str, dict] = RECIPES, universes: DataFrame | None = None,
) -> DataFrame:
    """(recipe, date, instrument, weight, target) of all inverse-vol recipes at once.

    Signals of every look-back are computed once per instrument, each row is then exploded into the recipes, and the
    cross-sectional steps run keyed by (recipe, date). Membership is a join on the recipe's own (top n, look-back), the trend of the
    benchmark one on its own window, and with ``universes`` (universe, instrument) a recipe trades the names of its universe only.
    Exposure needs one small daily series per distinct gate.
    """
    names = list(recipes or [n for n, r in table.items() if r.get("weighting") == "inverse_vol"])
    knobs = {n: resolve_recipe(n, table) for n in names}
    pick = lambda key: sorted({k[key] for k in knobs.values() if k.get(key) is not None})
    moms, vols, ois, trends = pick("momentum_lookback"), pick("vol_lookback"), pick("oi_lookback"), pick("trend_window")

    def body(df, w):
        df = df.withColumn("_ret", momentum("close", 1, w))
        now = {f"v_{n}": roll_std("_ret", n, w) for n in vols} | {f"m_{n}": momentum("close", n, w) for n in moms}
        for n in ois:
            now |= {f"o_{n}": oi_divergence("close", "oi", n, w), f"d_{n}": oi_divergence("close", "oi", n, w, True)}
        now |= {"smart_now": ratio("ls_top", "ls_global"), "basis_now": F.col("basis")}
        df = df.withColumns(now).withColumns({c: ref(c, 1, w) for c in now})
        return df.withColumns({f"t_{n}": F.coalesce(F.col("close") > roll_mean("close", n, w), F.lit(False)) for n in trends})

    reach = max([*moms, *vols, *ois, *trends]) + 3
    signals = trailing(panel.select("instrument", "date", "close", "oi", "ls_top", "ls_global", "basis"), reach, body)
    first = panel.agg(F.min("date")).scalar()
    null = F.lit(None).cast("double")

    def row(name: str):
        k = knobs[name]
        oi = k.get("oi_lookback")
        young = F.lit(True) if k.get("trend_window") is None else (
            (F.datediff(F.col("date"), first) + 1 < k["trend_window"]) | F.col(f"t_{k['trend_window']}")
        )
        return F.struct(
            F.lit(name).alias("recipe"), F.col(f"v_{k['vol_lookback']}").alias("vol"),
            (F.col(f"m_{k['momentum_lookback']}") if "momentum_lookback" in k else null).alias("mom"),
            (F.col(f"{'d' if k.get('oi_directional') else 'o'}_{oi}") if oi else null).alias("oi_div"),
            (F.col("smart_now") if "smart_k" in k else null).alias("smart"),
            (F.col("basis_now") if "crowding_k" in k else null).alias("crowding"),
            young.alias("keep"), F.lit(k.get("universe")).cast("string").alias("universe"),
            *[F.lit(k.get(c)).cast("int").alias(c) for c in ("member_top_n", "member_lookback", "ma_window")],
            *[F.lit(k.get(c)).cast("double").alias(c) for c in ("momentum_k", "oi_k", "smart_k", "crowding_k", "oi_trend_margin")],
        )

    rows = signals.select("instrument", "date", F.explode(F.array(*[row(n) for n in names])).alias("_r")).select("instrument", "date", "_r.*")
    rows = rows.filter("keep")
    if universes is not None:
        named = universes.select("universe", "instrument").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(named, ["universe", "instrument"], "left").filter(F.col("universe").isNull() | F.col("_in")).drop("_in")
    rules = sorted({(k["member_top_n"], k["member_lookback"]) for k in knobs.values() if "member_top_n" in k})
    if rules:
        rows = _members_of(rows, reduce(DataFrame.unionByName, [
            liquidity_schedule(panel, top, back).select(F.lit(top).alias("member_top_n"), F.lit(back).alias("member_lookback"), "month", "instrument") for top, back in rules
        ]))
    trends_of = [strong_trend(panel, benchmark, ma).withColumn("ma_window", F.lit(ma)) for ma in pick("ma_window")]
    rows = rows.join(reduce(DataFrame.unionByName, trends_of), ["date", "ma_window"], "left") if trends_of else rows.withColumn("trend", null)
    by = ["recipe", "date"]
    w = inverse_vol_weights(settle(rows, "sweep"), "vol", by)
    has = lambda c: F.col(c).isNotNull()
    margin = F.col("oi_trend_margin")
    chain = [
        Tilt("crowding", F.col("crowding_k"), -1, has("crowding_k")),
        Tilt("oi_div", F.col("oi_k"), +1, has("oi_k") & (margin.isNull() | (F.col("trend") > margin))),
        Tilt("smart", F.col("smart_k"), +1, has("smart_k")), Tilt("mom", F.col("momentum_k"), +1, has("momentum_k")),
    ]
    w = tilt_chain(w, chain, keys=by).filter(F.col("weight") > 0)
    exposure = sweep_exposure(panel, benchmark, names, onchain, table)
    return w.select("recipe", "date", "instrument", "weight").join(exposure, by, "left").withColumn(
        "target", F.col("weight") * F.coalesce("exposure", F.lit(1.0))
    ).drop("exposure")


def _members_of(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Rows whose instrument is a member under the row's own rule (member_top_n, member_lookback) in the latest schedule month.

    Rows without a rule, and dates before a rule's first month, are unrestricted.
    """
    rule = ["member_top_n", "member_lookback"]
    dated = rows.withColumn("month", F.trunc("date", "MM"))
    months = dated.filter(F.col("member_top_n").isNotNull()).select(*rule, "month").distinct()
    known = schedule.select(*rule, "month").distinct().withColumn("schedule_month", F.col("month"))
    aligned = asof(months, known, ["schedule_month"], keys=rule, pos="month")
    members = schedule.select(*rule, F.col("month").alias("schedule_month"), "instrument", F.lit(True).alias("_in"))
    joined = dated.join(aligned, [*rule, "month"], "left").join(members, [*rule, "schedule_month", "instrument"], "left")
    return joined.filter(F.col("schedule_month").isNull() | F.col("_in")).drop("_in", "schedule_month", "month")


def cost_rates(spark, names: Sequence[str], table: dict[str, dict] = RECIPES) -> DataFrame:
    """(recipe, cost_rate): the mean fee of both sides and the recipe's haircut, or the calibrated one, per unit traded."""
    rows = []
    for n in names:
        k = resolve_recipe(n, table)
        buy, sell = FEE_PRESETS[k.get("fee_preset", "vip2_bnb")]
        rows.append((n, (buy + sell) / 2 + k.get("haircut", MAKER_FILL_HAIRCUT)))
    return spark.createDataFrame(rows, "recipe string, cost_rate double")


def sweep_returns(targets: DataFrame, fwd: DataFrame, rates: DataFrame) -> DataFrame:
    """(recipe, date, gross, turnover, cost, ret) of the sweep's targets, every recipe at its own cost rate."""
    daily = portfolio_returns(targets, fwd, targets.select("recipe", "date").distinct(), 0.0, ["recipe"], "target")
    priced = daily.drop("cost", "ret").join(F.broadcast(rates), "recipe")  # one row per recipe
    return priced.withColumn("cost", F.col("turnover") * F.col("cost_rate")).withColumn("ret", F.col("gross") - F.col("cost")).drop("cost_rate")


def sweep_exposure(
    panel: DataFrame, benchmark: str, names: Sequence[str], onchain: DataFrame | None = None, table: dict[str, dict] = RECIPES
) -> DataFrame:
    """(recipe, date, exposure): one daily series per recipe, all on the benchmark close."""
    bench = panel.filter(F.col("instrument") == benchmark).select("instrument", "date", "close")
    groups: dict[tuple, list[str]] = {}
    resolve = lambda n: resolve_recipe(n, table)
    for n in names:
        k = resolve(n)
        gated = k.get("trend_window") is None or bool(k.get("compose_market_gate"))
        gate = (k["regime_mode"], k["ma_window"], k.get("vol_target"), k.get("confirm", 0)) if gated else ()
        groups.setdefault(gate, []).append(n)
    out = None
    for gate, members in groups.items():
        series = (
            regime_exposure(bench, mode=gate[0], ma_window=gate[1], vol_target=gate[2], confirm=gate[3]) if gate
            else bench.select("date", F.lit(1.0).alias("exposure"))
        )
        part = series.select("date", "exposure", F.explode(F.array(*[F.lit(m) for m in members])).alias("recipe"))
        out = part if out is None else out.unionByName(part)
    froth = {n: resolve(n) for n in names if "froth_lookback" in resolve(n)}
    chain = {n: resolve(n) for n in names if "onchain_window" in resolve(n)} if onchain is not None else {}
    for overlays, signal, strict, zkey, dkey in (
        (froth, lambda k: froth_signal(panel, "basis", k["froth_lookback"]), False, "froth_z", "froth_derisk"),
        (chain, lambda k: onchain, True, "onchain_z", "onchain_derisk"),
    ):
        for n, k in overlays.items():
            z = carried(bench, signal(k).withColumnRenamed("z", "_z"), "_z", strict=strict).withColumn("recipe", F.lit(n))
            out = out.join(z, ["recipe", "date"], "left").withColumn(
                "exposure", F.when(F.col("_z") > k[zkey], F.col("exposure") * k[dkey]).otherwise(F.col("exposure"))
            ).drop("_z")
    return out
