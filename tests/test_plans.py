"""Split designs, resampling, study, models and reports on small planted data."""
import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import aggregates, models, ranking
from panelspark.plans import leadlag as ll, resampling as rs, validation as va
from panelspark.sources import tables
from tests.conftest import day, rows


def calendar(spark, n):
    return spark.createDataFrame([(day(t),) for t in range(n)], "date date")


def test_cpcv_matches_enumeration(spark):
    n_days, n, k, purge, embargo = 47, 6, 2, 2, 3
    plan = va.cpcv_splits(calendar(spark, n_days), n, k, purge, embargo).toPandas()
    sizes = [n_days // n + (g < n_days % n) for g in range(n)]
    grp = np.repeat(range(n), sizes)
    for sid, combo in enumerate(itertools.combinations(range(n), k)):
        test = {p for p in range(n_days) if grp[p] in combo}
        bad = {q for p in test if p - 1 not in test for q in range(p - purge, p)} | {q for p in test if p + 1 not in test for q in range(p + 1, p + 1 + embargo)}
        train = set(range(n_days)) - test - bad
        mine = plan[plan.split_id == sid]
        pos = lambda role: {(d - day(0)).days for d in mine[mine.role == role].date}
        assert pos("test") == test and pos("train") == train
    assert va.starved_splits(va.cpcv_splits(calendar(spark, 12), 3, 2, 4, 4)).count() > 0
    with pytest.raises(ValueError):
        va.cpcv_splits(calendar(spark, 12), 3, 3, 0, 0)


def test_paths_use_each_cell_once(spark):
    paths = va.path_assignment(spark, 6, 2)
    assert paths.count() == 30 and va.n_paths(6, 2) == 5
    assert paths.groupBy("path_id").agg(F.countDistinct("grp").alias("g")).filter("g <> 6").count() == 0


def test_windows_and_periods(spark):
    starts = spark.createDataFrame([(dt.date(y, 1, 1),) for y in (2022, 2023, 2024, 2025)], "test_start date")
    data = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2026, 6, 15))], "data_start date, data_end date")
    w = va.oos_windows(starts, data).orderBy("label").collect()
    assert [r["label"] for r in w] == ["oos_2022", "oos_2023", "oos_2024", "oos_2025"]
    assert all((r["test_start"] - r["train_end"]).days == 8 for r in w)
    assert [r["test_end"] for r in w] == [dt.date(2022, 12, 31), dt.date(2023, 12, 31), dt.date(2024, 12, 31), dt.date(2026, 6, 15)]
    b = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2025, 1, 1), dt.date(2026, 6, 30))], "train_start date, test_start date, test_end date")
    annual = va.wf_periods(b, freq="year").orderBy("period_id").collect()
    assert [(r["test_start"], r["test_end"]) for r in annual] == [(dt.date(2025, 1, 1), dt.date(2025, 12, 31)), (dt.date(2026, 1, 1), dt.date(2026, 6, 30))]
    rolling = va.wf_periods(b, window="rolling", purge=6).orderBy("period_id").first()
    assert rolling["train_start"] == dt.date(2022, 1, 1) and (rolling["test_start"] - rolling["train_end"]).days == 7


def trial_frame(spark, matrix):
    return spark.createDataFrame(
        [(f"t{j:02d}", day(t), float(matrix[t, j])) for j in range(matrix.shape[1]) for t in range(matrix.shape[0])], "trial string, date date, ret double")


def test_pbo_dominant_and_noise(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.01, (320, 5))
    m[:, 2] += 0.01
    assert rs.pbo_cscv(trial_frame(spark, m), 8).first()["pbo"] < 0.3
    noise = [rs.pbo_cscv(trial_frame(spark, np.random.default_rng(s).normal(0, 1, (400, 10))), 8).first()["pbo"] for s in (1, 2, 3)]
    assert np.mean(noise) > 0.25
    with pytest.raises(ValueError):
        rs.pbo_cscv(trial_frame(spark, m), 7)


def test_pbo_matches_slices(spark):
    m = np.random.default_rng(9).normal(0.001, 0.02, (61, 4))
    groups = np.array_split(np.arange(61), 6)
    want = {}
    for combo in itertools.combinations(range(6), 3):
        i = np.concatenate([groups[g] for g in combo])
        o = np.setdiff1d(np.arange(61), i)
        sr = lambda r: m[r].mean(0) / m[r].std(0, ddof=1)
        rank = (sr(o) <= sr(o)[np.argmax(sr(i))]).sum()
        om = rank / 5
        want[sum(1 << g for g in combo)] = np.log(om / (1 - om))
    got = {r["combo"]: r["logit"] for r in rs.cscv_logits(trial_frame(spark, m), 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_bootstrap_walk(spark):
    lengths = spark.createDataFrame([("a", 200), ("b", 50)], "k string, n long")
    idx = rs.bootstrap_indices(lengths, 10, 30, 1, ["k"])
    pdf = idx.orderBy("k", "b", "t").toPandas()
    a = pdf[pdf.k == "a"]
    assert len(a) == 6000 and a.idx.between(0, 199).all()
    step = (a.idx.diff() % 200)[a.t > 0]
    assert abs((step != 1).mean() - 0.1) < 0.03
    again = rs.bootstrap_indices(lengths.repartition(5), 10, 30, 1, ["k"]).orderBy("k", "b", "t").toPandas()
    assert (again.idx == pdf.idx).all()
    series = spark.createDataFrame([(day(t), float(x)) for t, x in enumerate(np.random.default_rng(3).normal(0.1, 1, 150))], "date date, ret double")
    ci = rs.bootstrap_ci(series, block=5, resamples=80, seed=4).first()
    assert ci["lo"] < ci["point"] < ci["hi"] and ci["se"] > 0
    assert rs.bootstrap_ci(series.limit(1), block=5, resamples=10).count() == 0


def hourly(spark, theta, n=500, names=6, seed=0):
    rng = np.random.default_rng(seed)
    lead = rng.normal(0, 0.01, n)
    out = [("BTC", *x) for x in enumerate(np.exp(np.cumsum(lead)))]
    for j in range(names):
        r = rng.normal(0, 0.01, n)
        r[1:] += theta * lead[:-1]
        out += [(f"X{j}", *x) for x in enumerate(np.exp(np.cumsum(r)))]
    start = dt.datetime(2023, 1, 1)
    return spark.createDataFrame([(s, start + dt.timedelta(hours=int(t)), float(c)) for s, t, c in out], "symbol string, ts timestamp, close double")


def test_study_finds_planted_signal_only(spark):
    cells = {}
    for theta in (0.4, 0.0):
        p = ll.hourly_returns(hourly(spark, theta))
        cells[theta] = {(r["k"], r["h"]): r for r in ll.run_cells(p, ["BTC"], [1, 2], [1, 2]).collect()}
    hit = cells[0.4][(1, 1)]
    assert abs(hit["beta"] - 0.4) < 0.05 and hit["bh_q"] < 0.01 and hit["rank_ic"] > 0.1
    assert cells[0.0][(1, 1)]["bh_q"] > 0.05
    with pytest.raises(ValueError, match="look-ahead"):
        ll.preregister_grid(spark, ["BTC"], [0], [1])
    grid = ll.preregister_grid(spark, ["BTC", "ETH"])
    assert grid.count() == 40 and grid.first()["n_trials"] == 40
    assert ll.universe_preset("majors")[0] == ("BTCUSDT", "ETHUSDT") and len(ll.universe_preset("midcap")[1]) == 16
    with pytest.raises(ValueError):
        ll.universe_preset("tiny")


def test_ridge_equals_lstsq_for_every_split(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = x @ [0.5, -1.0] + 0.3 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(f"i{t % 3}", day(t // 3), float(a), float(b), float(c)) for t, ((a, b), c) in enumerate(zip(x, y))], "instrument string, date date, a double, b double, y double")
    plan = df.select("date").distinct().withColumn("split_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "role", F.when((F.dayofyear("date") % 2) == F.col("split_id"), "train").otherwise("test"))
    pred = models.fit_predict(df, plan, ["a", "b"], "y", "linear").toPandas()
    pdf = df.toPandas()
    for s in (0, 1):
        train = pdf[[d.timetuple().tm_yday % 2 == s for d in pdf.date]]
        coef = np.linalg.lstsq(np.c_[np.ones(len(train)), train[["a", "b"]]], train.y, rcond=None)[0]
        mine = pred[pred.split_id == s]
        assert len(mine) and np.allclose(mine.pred, coef[0] + mine.a * coef[1] + mine.b * coef[2])
    with pytest.raises(ValueError):
        models.fit_predict(df, plan, ["a", "b"], "y", "none")


def test_runs_give_the_moments_of_the_written_out_resamples(spark):
    """Sums of runs from prefix sums equal sums over all resampled rows: several series, missing values, blocks from 1 up, wraps."""
    rng = np.random.default_rng(8)
    rows = [(k, day(t), None if rng.random() < 0.1 else float(rng.normal(0.1, 1)), float(rng.normal())) for k, n in (("a", 90), ("b", 7), ("c", 1)) for t in range(n)]
    series = spark.createDataFrame(rows, "k string, date date, x double, y double").cache()
    for block in (1, 2.5, 400):
        got = rs.moment_resamples(series, ["x", "y"], block, 25, 11, ["k"]).toPandas().set_index(["k", "b"]).sort_index()
        draws = rs.bootstrap_draws(series, ["x", "y"], block, 25, 11, ["k"])
        want = draws.groupBy("k", "b").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]).toPandas().set_index(["k", "b"]).sort_index()
        assert len(got) == 75 and (got.index == want.index).all()
        for c in "xy":
            n, s1, s2 = (got[f"{c}_{m}"].to_numpy(float) for m in ("n", "s1", "s2"))
            assert (n.round() == want[f"n_{c}"]).all()
            with np.errstate(all="ignore"):
                assert np.allclose(got[f"{c}_c"].to_numpy(float) + s1 / n, want[f"mean_{c}"].astype(float), equal_nan=True)
                assert np.allclose(np.sqrt(np.maximum(s2 - s1 * s1 / n, 0) / (n - 1)), want[f"sd_{c}"].astype(float), equal_nan=True, atol=1e-7)


def test_a_resample_costs_rows_per_run_not_per_position(spark):
    lengths = spark.createDataFrame([("a", 5000)], "k string, n long")
    runs = rs.bootstrap_runs(lengths, 50, 20, 1, ["k"]).toPandas()
    assert abs(len(runs) - 5000 * 20 / 50) < 250
    assert (runs.groupby("b")["size"].sum() == 5000).all() and (runs["size"] > 0).all()


def test_other_statistics_keep_the_long_path(spark):
    series = spark.createDataFrame([(day(t), float(t % 7)) for t in range(60)], "date date, ret double")
    ci = rs.bootstrap_ci(series, block=5, resamples=30, seed=4, statistic=F.median).first()
    assert ci["point"] == 3.0 and ci["lo"] <= 3.0 <= ci["hi"]


@pytest.fixture(scope="module")
def gappy(spark):
    """Hourly returns of two predictors and four targets, with rows missing at random and one short series."""
    rng = np.random.default_rng(12)
    rows = [(s, dt.datetime(2023, 12, 25) + dt.timedelta(hours=t), None if rng.random() < 0.15 else float(rng.normal(0, 0.01))) for s in ("P", "Q", "A", "B", "C", "D") for t in range(15 if s == "D" else 400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, r double")
    grid = df.select("ts").distinct().withColumn("step", F.row_number().over(Window.orderBy("ts")))
    every = df.select("symbol").distinct().crossJoin(grid).join(df, ["symbol", "ts"], "left")
    return every.cache()


KS, HS, PREDICTORS = (1, 3), (1, 2, 4), ("P", "Q")


@pytest.mark.parametrize("stacked", [False, True])
def test_cube_equals_the_rows_of_every_cell(spark, gappy, stacked):
    """Sums over wide rows give what the rows of every cell give, however short the blocks are."""
    obs = ll.observations(gappy, PREDICTORS, KS, HS).cache()
    rows = ll.demeaned(obs).cache()
    fit = ll.pooled_ols(rows).cache()
    scored = ll.scores(rows, fit).cache()
    wide = ll.wide_observations(gappy, PREDICTORS, KS, HS).cache()
    cube = ll.moment_cube(wide, KS, HS).cache()
    short = ll.cube_ols(cube).cache()
    table = lambda df: df.toPandas().set_index(["predictor", "k", "h"]).sort_index()
    a, b = table(fit), table(short)
    assert len(a) == 12 and np.allclose(a[["n_obs", "beta", "gamma", "i11", "i12", "i22"]].astype(float), b[["n_obs", "beta", "gamma", "i11", "i12", "i22"]].astype(float), rtol=1e-9)
    ws = ll.wide_scores(wide, cube, short, KS, HS)
    hourly = ll.hourly_cells(ws, KS, HS).cache()
    close = lambda x, y, c: np.allclose(table(x)[c].astype(float), table(y)[c].astype(float), rtol=1e-8, equal_nan=True)
    one = ll.newey_west_variance(scored, fit, HS, stacked=stacked, block=10**6)
    assert close(one, ll.newey_west_variance(scored, fit, HS, stacked=stacked, block=7), "var_hac")
    assert close(one, ll.wide_newey_west(ws, short, KS, HS, stacked, block=7), "var_hac")
    assert close(ll.clustered_variance(scored, fit), ll._clustered(hourly.filter("g > 0"), short, ll.CELL), "var_cluster")
    assert close(ll.sign_ic(rows), ll.hourly_sign_ic(hourly), "rank_ic")
    assert close(ll.decile_spread(obs), ll.hourly_decile_spread(hourly), "spread_bps")
    ic = ll.ic_series(obs).groupBy(*ll.CELL).agg(F.avg("ret").alias("ic"))
    assert close(ic, hourly.filter("m10 > 0").groupBy(*ll.CELL).agg(F.avg(F.signum("pred") * F.col("f10") / F.col("m10")).alias("ic")), "ic")


def test_newey_west_lags_by_hand(spark, gappy):
    obs = ll.observations(gappy, ["P"], [1], [4])
    rows = ll.demeaned(obs)
    fit = ll.pooled_ols(rows)
    scored = ll.scores(rows, fit)
    got = ll.newey_west_variance(scored, fit, [4], block=16).first()["var_hac"]
    f, meat = fit.first(), np.zeros((2, 2))
    for _, part in scored.toPandas().sort_values("step").groupby("symbol"):
        s = part[["s1", "s2"]].to_numpy()
        meat += s.T @ s
        for lag in range(1, 4):
            meat += (1 - lag / 4) * (s[lag:].T @ s[:-lag] + s[:-lag].T @ s[lag:])
    inverse = np.array([[f["i11"], f["i12"]], [f["i12"], f["i22"]]])
    assert np.isclose(got, (inverse @ meat @ inverse)[0, 0], rtol=1e-9)


def test_study_checks_its_best_cell_without_overlap(spark):
    out = ll.analyze(ll.hourly_returns(hourly(spark, 0.4)), ["BTC"], [1, 2], [1, 2], resamples=20).toPandas()
    best = out[out["nonoverlap_beta"].notna()]
    assert len(out) == 4 and len(best) == 1 and best["nonoverlap_p"].iloc[0] < 0.01 and abs(best["nonoverlap_beta"].iloc[0] - 0.4) < 0.1


def test_register_is_a_log(spark, tmp_path):
    path = str(tmp_path / "register")
    frame = lambda rows: spark.createDataFrame(rows, "id string, recipe string, config_hash string, sharpe double, created string, at long").repartition(5)
    first = frame([(str(n), "r", f"c{n % 4}", float(n), "t", n) for n in range(40)])
    assert tables.append_trial(first, path, batch="one", order="at") == 1
    assert tables.append_trial(frame([("x", "r", "c1", -1.0, "t", 0)]), path, batch="two", order="at") == 2
    want = {"c0": 36.0, "c1": -1.0, "c2": 38.0, "c3": 39.0}
    last = lambda: {r.config_hash: r.sharpe for r in ranking.dedupe_trials(tables.read_trials(spark, path)).collect()}
    assert last() == want and tables.read_trials(spark, path).count() == 41
    assert tables.append_trial(first, path, batch="one", order="at") == 1  # replayed: nothing changes, nor does it become the last
    assert last() == want and tables.read_trials(spark, path).count() == 41
    assert tables.append_trial(frame([("y", "r", "c9", 9.0, "t", 0)]), path) == 3 and tables.append_trial(frame([("z", "r", "c9", 8.0, "t", 0)]), path) == 4
    assert last() == {**want, "c9": 8.0}
    plain = tmp_path / "trials.jsonl"
    plain.write_text('{"id": "1", "recipe": "a", "config_hash": "c", "sharpe": 1.0, "created": "x"}\n{"id": "2", "recipe": "a", "config_hash": "c", "sharpe": 0.5, "created": "y"}\n')
    assert [r.sharpe for r in ranking.dedupe_trials(tables.read_trials(spark, str(plain))).collect()] == [0.5]


def test_book_walk_orders_one_bucket_only(spark):
    rng = np.random.default_rng(3)
    rows = [(b, float(t), float(rng.uniform(1, 2)), float(rng.integers(0, 3)), None) for b in ("x", "y") for t in rng.permutation(300)] + [("z", 1.0, 2.0, 0.0, None), ("w", 1.0, 3.0, 5.0, None)]
    df = spark.createDataFrame(rows, "bar string, seq double, price double, quantity double, _v string")
    for fraction in (0.01, 0.4, 1.0):
        for bucket in (None, F.floor("seq"), F.floor(F.col("seq") / 40), F.floor(F.col("seq") / 1000)):
            got = {r["bar"]: r["impact"] for r in aggregates.book_walk_impact(df, ["bar"], ["seq"], fraction, bucket).collect()}
            for bar in "xyzw":
                mine = sorted((t, p, q) for b, t, p, q, _ in rows if b == bar)
                target, value, quantity = fraction * sum(p * q for _, p, q in mine), 0.0, 0.0
                for _, p, q in mine:
                    part = min(p * q, target - value)
                    if part > 0:
                        value, quantity = value + part, quantity + part / p
                want = abs(value / quantity - mine[0][1]) / mine[0][1] / fraction**2 if quantity else 0.0
                assert abs(got[bar] - want) < 1e-9
