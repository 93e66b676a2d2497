"""Hand-computed answers, look-ahead traps, and closed forms against naive loops."""
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as sc
from panelspark.operators import aggregates as ag, features, joins, panel as pn, portfolio as pf, quality, ranking, stats, windows as wo
from panelspark.plans import recipes
from tests.conftest import day, rows


def panel(spark, data, schema="instrument string, date date, close double"):
    return spark.createDataFrame(data, schema)


def walk(seed, names=("A", "B", "C"), n=120, fields=("close",)):
    rng = np.random.default_rng(seed)
    return [(k, day(t), *[float(x) for x in np.exp(0.03 * rng.normal(size=len(fields)) + 4)]) for k in names for t in range(n)]


def test_normal_functions(spark):
    xs = [-8.5, -5.0, -1.96, -0.3, 0.0, 0.7, 2.5, 7.2]
    nd = statistics.NormalDist()
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(sc.norm_cdf("x")).collect()]
    assert np.allclose(got, [nd.cdf(x) for x in xs], atol=1e-14)
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(sc.norm_ppf("p")).collect()]
    assert np.allclose(got, [nd.inv_cdf(p) for p in ps], atol=1e-9)
    assert spark.range(1).select(sc.norm_ppf(F.lit(0.0)), sc.norm_ppf(F.lit(1.0))).first() == (None, None)


def test_scalar_edge_cases(spark):
    r = spark.range(1).select(
        sc.ratio(F.lit(1.0), F.lit(0.0)), sc.clip(F.lit(None).cast("double"), 0, 1), sc.finite(F.lit(float("nan"))), sc.epoch_to_date(F.lit(1735689600000000)),
        sc.epoch_to_date(F.lit(1735689599999)), sc.safe_ln(F.lit(-1.0)), sc.vwap(F.lit(10.0), F.lit(0.0), F.lit(3.0)),
    ).first()
    assert tuple(r) == (None, None, None, day(0), day(-1), None, 3.0)


def test_long_short_legs_ties_and_costs(spark):
    schema = "instrument string, date date, score double, fwd double"
    # scores 5..1 over five names: the two best earn 7 % and 1 %, the two worst -4 % and 2 %; the middle one is in no leg
    fwd = {"KILO": 0.07, "LIMA": 0.01, "MIKE": 0.50, "NOVA": 0.02, "OSCAR": -0.04}
    df = panel(spark, [(k, day(3), 5.0 - n, f) for n, (k, f) in enumerate(fwd.items())], schema)
    assert [round(r["ret"], 6) for r in pf.long_short_spread(df, 2).collect()] == [0.05]
    # equal scores are settled by name, whatever the order of arrival: same legs on both days, so costs fall due once
    tied = [(k, day(t), 1.0, 0.0) for t in (0, 1) for k in (("PAPA", "ROMEO") if t else ("ROMEO", "PAPA"))]
    got = [round(r["ret"], 6) for r in pf.long_short_spread(panel(spark, tied, schema), 1, 0.01).orderBy("date").collect()]
    assert got[1] == 0.0 and got[0] < 0
    # three names allow one a leg however many are asked for, one name none
    few = panel(spark, [("UNIT", day(0), 3.0, 0.06), ("VIGOR", day(0), 2.0, 0.9), ("WHISKY", day(0), 1.0, 0.01), ("UNIT", day(1), 3.0, 0.06)], schema)
    assert [round(r["ret"], 6) for r in pf.long_short_spread(few, 4).orderBy("date").collect()][:1] == [0.05]


def test_trades_of_a_holding(spark):
    """Opening, adding, cutting, closing and reopening; an unchanged holding trades nothing."""
    held = {"GOLD": [4.0, 4.0, 10.0, 2.5, None, 1.0], "TIN": [None, 100.0, 100.0, None, 40.0, 40.0]}
    price = {"GOLD": 20.0, "TIN": 0.5}
    pos = [(day(t), s, q, price[s] + t) for s, quantities in held.items() for t, q in enumerate(quantities) if q is not None]
    df = spark.createDataFrame(pos, "date date, symbol string, amount double, price double")
    got = [(r.line, (r.date - day(0)).days, r.side, r.symbol, r.qty, r.value) for r in joins.trades(df).orderBy("line").collect()]
    assert [g[:5] for g in got] == [
        (1, 0, "buy", "GOLD", 4.0), (2, 1, "buy", "TIN", 100.0), (3, 2, "buy", "GOLD", 6.0), (4, 3, "sell", "GOLD", 7.5), (5, 3, "sell", "TIN", 100.0),
        (6, 4, "sell", "GOLD", 2.5), (7, 4, "buy", "TIN", 40.0), (8, 5, "buy", "GOLD", 1.0)]
    assert got[0][5] == 80.0 and got[2][5] == 6.0 * 22.0
    n, buys, sells, _ = ag.trade_summary(joins.position_diff(df)).first()
    assert (n, buys, sells) == (8, 5, 3)


def test_liquidity_schedule_follows_turnover(spark):
    """A name that doubles in the second month enters the third month's list; before a full look-back strict has none."""
    amount = lambda name, t: {"ash": 50.0, "birch": 40.0, "cedar": 10.0 if t < 31 else 80.0}[name]
    df = panel(spark, [(k, day(t), amount(k, t)) for k in ("ash", "birch", "cedar") for t in range(70)], "instrument string, date date, amount double")
    got = {m: [r["instrument"] for r in ranking.liquidity_schedule(df, 2, 20).filter(F.col("month") == m).orderBy("rank").collect()] for m in ("2025-02-01", "2025-03-01")}
    assert got == {"2025-02-01": ["ash", "birch"], "2025-03-01": ["cedar", "ash"]}
    assert ranking.liquidity_schedule(df, 2, 20, strict=True).filter("month = '2025-01-01'").count() == 0


def test_overlays_and_exposure_carry_the_last_value(spark):
    days = spark.createDataFrame([(day(t), 1.0) for t in range(6)], "date date, exposure double")
    z = spark.createDataFrame([(day(1), 9.0), (day(4), None)], "date date, z double")
    known = {strict: [r["exposure"] for r in pf.derisk(days, z, 2.0, 0.25, strict=strict).orderBy("date").collect()] for strict in (False, True)}
    assert known == {False: [1.0, 0.25, 0.25, 0.25, 1.0, 1.0], True: [1.0, 1.0, 0.25, 0.25, 0.25, 1.0]}
    weights = spark.createDataFrame([(k, day(t), 0.5) for t in range(4) for k in ("X", "Y")], "instrument string, date date, weight double")
    gate = spark.createDataFrame([(day(1), 0.0), (day(3), 0.5)], "date date, exposure double")
    got = [r["target"] for r in pf.apply_exposure(weights, gate, base=1.0).filter("instrument = 'X'").orderBy("date").collect()]
    assert got == [0.5, 0.0, 0.0, 0.25]


def test_designs_that_cannot_work_are_refused(spark):
    from panelspark.plans import reports, resampling

    short = spark.createDataFrame([(day(t), "A", 1.0, 1.0, 0.1) for t in range(12)], "date date, instrument string, x double, LABEL double, fwd double")
    with pytest.raises(ValueError, match="training day"):
        reports.cpcv_predictions(short, ["x"], "LABEL", groups=4, tests=2, purge=3, embargo=12)
    with pytest.raises(ValueError, match="as many days"):
        resampling.cscv_sharpes(spark.createDataFrame([("t", day(t), 0.1) for t in range(5)], "trial string, date date, ret double"), 6)


def test_debounce_equals_the_state_machine(spark):
    random.seed(3)
    data, want = [], {}
    for s in range(6):
        raw = [None] * random.randint(0, 4) + [random.choice([0.0, 1.0]) if random.random() > 0.1 else None for _ in range(60)]
        for n in (1, 2, 5):
            held, run = None, 0
            for t, r in enumerate(raw):
                if r is None:
                    continue
                if held is None:
                    held = r
                if r != held:
                    run += 1
                    if run >= n:
                        held, run = r, 0
                else:
                    run = 0
                want[(f"s{s}", n, t)] = held
        data += [(f"s{s}", day(t), r) for t, r in enumerate(raw)]
    df = panel(spark, data, "instrument string, date date, raw double")
    for n in (1, 2, 5):
        for r in wo.debounce(df, "raw", n, ["instrument"], "held").collect():
            assert r["held"] == want.get((r["instrument"], n, (r["date"] - day(0)).days)), (n, r)


def test_regime_modes(spark):
    closes = [10.0, 11, 12, 13, 9, 8, 12, 14]
    df = panel(spark, [("A", day(t), float(c)) for t, c in enumerate(closes)])
    binary = [r["exposure"] for r in wo.regime_exposure(df, ma_window=3).orderBy("date").collect()]
    assert binary == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        wo.regime_exposure(df, mode="cross")
    with pytest.raises(ValueError):
        wo.regime_exposure(df, mode="other")


def test_features_are_leak_safe(spark):
    """The last row of a truncated panel equals the same row of the full panel."""
    fields = ("close", "funding", "oi", "oi_value", "ls_top", "ls_global", "taker_ratio", "basis")
    schema = "instrument string, date date, " + ", ".join(f"{f} double" for f in fields)
    full = panel(spark, walk(7, n=110, fields=fields), schema)
    cut = full.filter(F.col("date") <= day(89))
    for make in (lambda p: features.cross_asset_features(p, "A"), features.funding_features, features.derivatives_features):
        a = make(full).filter(F.col("date") == day(89)).orderBy("instrument").toPandas()
        b = make(cut).filter(F.col("date") == day(89)).orderBy("instrument").toPandas()
        pd.testing.assert_frame_equal(a, b[a.columns])


def test_cross_asset_benchmark_rows(spark):
    out = features.cross_asset_features(panel(spark, walk(8, n=80)), "A").filter("instrument = 'A'").orderBy("date").toPandas()
    assert (out["rs_5"] == 0).all() and (out["beta_20"] == 1).all() and (out["coint_z"] == 0).all() and out["leadlag_1"].isna().all()


def test_densify_and_suspension(spark):
    sparse = panel(spark, [("A", day(0), 1.0), ("A", day(3), 4.0), ("B", day(2), 2.0)])
    dense = rows(pn.densify(sparse), "instrument", "date")
    assert dense == [("A", day(0), 1.0), ("A", day(1), None), ("A", day(2), None), ("A", day(3), 4.0), ("B", day(2), 2.0)]
    assert pn.densify_union_calendar(sparse).count() == 8
    assert rows(quality.missing_days(sparse), "date") == [("A", day(1)), ("A", day(2))]


def test_islands_and_missing_spans_of_repeated_days(spark):
    """D1: spans of missing days come from their two ends; no day between them is ever a row."""
    held = [("A", day(d)) for d in (0, 0, 1, 4, 4, 4, 9, 10, 11, 11)] + [("B", day(5)), ("C", day(2)), ("C", day(2)), ("C", day(900))]
    random.Random(3).shuffle(held)
    days = panel(spark, held, "instrument string, date date")
    spans = [("A", day(2), day(3)), ("A", day(5), day(8)), ("C", day(3), day(899))]
    assert rows(quality.missing_spans(days), "instrument", "first_day") == spans
    assert rows(wo.gap_islands(quality.missing_days(days)).drop("days"), "instrument", "first_day") == spans
    islands = [("A", day(0), day(1), 2), ("A", day(4), day(4), 1), ("A", day(9), day(11), 3), ("B", day(5), day(5), 1), ("C", day(2), day(2), 1), ("C", day(900), day(900), 1)]
    assert rows(wo.gap_islands(days), "instrument", "first_day") == islands
    findings = quality.verify_panel(days.withColumns({"close": F.lit(1.0), "volume": F.lit(1.0)}), ["close", "volume"])
    assert {(r.instrument, r.detail) for r in findings.filter("check = 'missing_day'").collect()} == {(i, f"{a}..{b}") for i, a, b in spans}
    assert "sequence(" not in findings._jdf.queryExecution().optimizedPlan().toString()


def test_equal_open_interest_values_tie_in_any_row_order(spark):
    """W13: the rank of oi_value must not depend on the order in which doubles are added."""
    from panelspark.queries import inputs

    total = lambda x: round(float(np.cumsum([k * d for k, d in x])[-1]), 12)  # noqa: E731, added in order
    draw = random.Random(7)
    there = [(draw.randint(1, 120_000), draw.randint(0, 10) / 100) for _ in range(60)]
    other = next(x for x in (draw.sample(there, 60) for _ in range(1000)) if total(x) != total(there))
    third = [(1, 0.5), (1, math.nan)]
    lines = [(n, k, d) for n, x in enumerate((there, other, third)) for k, d in x]
    ticks = spark.createDataFrame(lines, "n int, l_partkey long, l_discount double").coalesce(1)
    got = rows(ticks.groupBy("n").agg(inputs.exact_sum("l_partkey", "l_discount").alias("v")), "n")
    assert got[0][1] == got[1][1] == sum(k * round(d * 100) for k, d in there) / 100 and math.isnan(got[2][1])


def test_sharpe_psr_against_numpy(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0.01, 0.05, 200)
    df = spark.createDataFrame([("t", float(x)) for x in r], "trial string, ret double")
    got = stats.psr(df, ["trial"], 0.02).first()
    sr = r.mean() / r.std(ddof=1)
    m = r - r.mean()
    g3, g4 = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2
    z = (sr - 0.02) * math.sqrt(199) / math.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr**2)
    assert got["sharpe"] == pytest.approx(sr) and got["psr"] == pytest.approx(statistics.NormalDist().cdf(z))
    flat = spark.createDataFrame([("t", 0.1)] * 3, "trial string, ret double")
    assert tuple(stats.psr(flat, ["trial"]).first())[2:] == (0.0, None)
    assert stats.expected_max_sharpe(spark.createDataFrame([(0.1,)], "sharpe double")).first()["expected_max"] is None


def test_tilt_chain_equals_one_by_one(spark):
    rng = np.random.default_rng(4)
    data = [(k, day(t), float(rng.uniform(0.1, 1)), None if rng.random() < 0.2 else float(rng.normal()), float(rng.normal())) for t in range(5) for k in "ABCDE"]
    df = panel(spark, data, "instrument string, date date, vol double, s1 double, s2 double")
    w = pf.inverse_vol_weights(df)
    chain = pf.tilt_chain(w, [pf.Tilt("s1", 0.5, -1), pf.Tilt("s2", 1.0, 1, F.col("date") > F.lit(day(1)))]).orderBy("date", "instrument").toPandas()
    pdf = w.orderBy("date", "instrument").toPandas()
    for d, g in pdf.groupby("date"):
        weights = g["weight"].to_numpy()
        for name, k, sign in (("s1", 0.5, -1), ("s2", 1.0, 1)):
            if name == "s2" and d <= day(1):
                continue
            s = g[name].astype(float)
            z = (s - s.mean()) / s.std(ddof=0)
            weights = weights * np.exp(sign * k * z).fillna(1).to_numpy()
            weights = weights / weights.sum()
        assert np.allclose(chain[chain["date"] == d]["weight"], weights)


def test_inverse_vol_fallbacks(spark):
    df = panel(spark, [("A", day(0), 0.5), ("B", day(0), 0.25), ("C", day(0), 0.0), ("A", day(1), None), ("B", day(1), -1.0)], "instrument string, date date, vol double")
    got = {(r["instrument"], r["date"]): r["weight"] for r in pf.inverse_vol_weights(df).collect()}
    assert got[("A", day(0))] == pytest.approx(1 / 3) and got[("C", day(0))] == 0 and got[("A", day(1))] == 0.5


def test_strictly_prior_signals(spark):
    """A spike on the last day must not move that day's signals."""
    base = [(k, day(t), 10.0 + math.sin(t + ord(k)), 5.0 + t % 3, 1.1, 1.0, 0.01) for k in "AB" for t in range(60)]
    schema = "instrument string, date date, close double, oi double, ls_top double, ls_global double, basis double"
    spiked = [(k, d, c * 9 if d == day(59) else c, oi * 9 if d == day(59) else oi, *rest) for k, d, c, oi, *rest in base]
    a, b = (rows(pf.strategy_signals(panel(spark, x, schema)).filter(F.col("date") == day(59)).select("instrument", "vol", "crowding", "oi_div", "smart", "mom"), "instrument") for x in (base, spiked))
    assert a == b


def test_maintenance_refusals(spark):
    p = panel(spark, [("OLD", day(t), 1.0) for t in range(5)] + [("NEW", day(t), 2.0) for t in range(8, 12)])
    merged = rows(joins.stitch_rename(p, "OLD", "NEW"), "date")
    assert [r[0] for r in merged] == ["NEW"] * 12 and [r[2] for r in merged[5:8]] == [None] * 3
    overlap = p.unionByName(panel(spark, [("NEW", day(3), 2.0)]))
    with pytest.raises(Exception, match="overlap"):
        joins.stitch_rename(overlap, "OLD", "NEW").collect()
    with pytest.raises(Exception, match="twice"):
        quality.append_merge(p, p).collect()
    with pytest.raises(ValueError, match="unknown"):
        quality.drop_instrument(p, "NOPE")
    with pytest.raises(ValueError, match="last"):
        quality.drop_instrument(p.filter("instrument = 'OLD'"), "OLD")
    bridge = p.unionByName(panel(spark, [("MID", day(t), 3.0) for t in range(3, 10)]))
    with pytest.raises(ValueError, match="uncovered"):
        quality.drop_instrument(bridge, "MID")
    findings = quality.verify_panel(p.unionByName(panel(spark, [("NEW", day(9), 2.0)])), ["close"], fail_on_gap=True)
    assert {r["check"] for r in findings.filter("severity = 'error'").collect()} == {"duplicate_day", "uncovered_day"}
    with pytest.raises(ValueError, match="duplicate_day"):
        quality.require_clean(findings)


def test_retrofit_is_idempotent(spark):
    p = panel(spark, [("A", day(0), 1.0), ("A", day(1), None), ("B", day(0), 5.0)], "instrument string, date date, f double")
    s = panel(spark, [("A", day(0), 9.0), ("A", day(1), 2.0), ("B", day(0), 9.0)], "instrument string, date date, f double")
    once = quality.retrofit_field(p, s, "f").select("instrument", "date", "f")
    assert rows(once, "instrument", "date") == [("A", day(0), 1.0), ("A", day(1), 2.0), ("B", day(0), 5.0)]
    assert rows(quality.retrofit_field(once, s, "f").select("instrument", "date", "f"), "instrument", "date") == rows(once, "instrument", "date")


def test_impact_of_a_linear_book(spark):
    ticks = spark.createDataFrame([("S", i, 100.0 + i / 10, 10.0) for i in range(5)], "symbol string, agg_id long, price double, quantity double")
    total = sum((100 + i / 10) * 10 for i in range(5))
    target, value, qty = total * 0.3, 0.0, 0.0
    for i in range(5):
        take = min((100 + i / 10) * 10, target - value)
        value, qty = value + take, qty + take / (100 + i / 10)
        if value >= target:
            break
    got = ag.book_walk_impact(ticks, ["symbol"], ["agg_id"], 0.3).first()["impact"]
    assert got == pytest.approx(abs(value / qty - 100) / 100 / 0.09)


def test_recipe_table_and_sweep(spark):
    assert recipes.recipe_table(spark).count() == 50
    with pytest.raises(ValueError):
        recipes.resolve_recipe("none")
    fields = ("close", "oi", "ls_top", "ls_global", "basis", "amount")
    p = panel(spark, walk(11, names=("A", "B", "C", "D"), n=260, fields=fields), "instrument string, date date, " + ", ".join(f"{f} double" for f in fields))
    out = recipes.recipe_sweep(p, "A", recipes=["regime_volweight_majors", "momentum_tilt_k20", "tsmom_voltarget"])
    got = out.filter("recipe = 'momentum_tilt_k20'").orderBy("date", "instrument").toPandas()
    single = pf.target_weights(pf.membership_filter(pf.strategy_signals(p), p, 10, 30), momentum_k=2.0).orderBy("date", "instrument").toPandas()
    assert np.allclose(got["weight"], single["weight"]) and (got["date"] == single["date"]).all()
    sums = out.groupBy("recipe", "date").agg(F.sum("weight").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)
    loose = out.filter("recipe = 'tsmom_voltarget'").agg(F.sum(F.abs(F.col("target") - F.col("weight")))).first()[0]
    assert loose == pytest.approx(0)
