"""Boosted trees against a plain loop over splits, rounds, nodes and cuts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, models
from tests.conftest import day


def plain_edges(x, bins):
    order = np.sort(x)
    below = np.searchsorted(order, order, "left")
    place = below * bins // len(x)
    return [order[place == b].min() for b in np.unique(place) if b > 0]


def plain_boost(x, y, x_test, trees, depth, rate, reg, bins):
    """Predictions of trees on all rows; weights are 1."""
    edges = [plain_edges(c, bins) for c in x.T]
    put = lambda m: np.array([np.searchsorted(e, c, "right") for e, c in zip(edges, m.T)]).T
    b, bt = put(x), put(x_test)
    pred, out = np.full(len(y), y.mean()), np.full(len(x_test), y.mean())
    for _ in range(trees):
        r, node, node_t = y - pred, np.zeros(len(y), int), np.zeros(len(x_test), int)
        for _ in range(depth):
            step, step_t = node * 2 + 1, node_t * 2 + 1
            for k in np.unique(node):
                mine = node == k
                best = (1e-9, None)
                for f in range(b.shape[1]):
                    for cut in range(1, len(edges[f]) + 1):
                        left = mine & (b[:, f] < cut)
                        right = mine & ~left
                        if left.any() and right.any():
                            part = lambda m: r[m].sum() ** 2 / (m.sum() + reg)
                            gain = part(left) + part(right) - part(mine)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
                if best[1]:
                    f, cut = best[1]
                    step[mine] += b[mine, f] >= cut
                    step_t[node_t == k] += bt[node_t == k, f] >= cut
            node, node_t = step, step_t
        for k in np.unique(node):
            v = rate * r[node == k].sum() / ((node == k).sum() + reg)
            pred[node == k] += v
            out[node_t == k] += v
    return out


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 2)).round(3)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * np.where(x[:, 1] > 0, 1, 0.2) + rng.normal(0, 0.05, 240)
    rows = [(f"i{t % 3}", day(t // 3), float(a), float(b), 1.0, float(c)) for t, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "instrument string, date date, a double, b double, flat double, y double")


def alternating(panel):
    """Two splits that train on the other's test days."""
    plan = panel.select("date").distinct().withColumn("split_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return plan.withColumn("role", F.when((F.dayofyear("date") % 2) == F.col("split_id"), "train").otherwise("test"))


@pytest.mark.parametrize("trees,depth", [(3, 2), (2, 0)])
def test_splits_grow_together_and_equal_a_plain_loop(spark, panel, trees, depth):
    options = {"trees": trees, "depth": depth, "subsample": 1, "rate": 0.5, "reg": 2.0, "bins": 8}
    got = models.fit_predict(panel, alternating(panel), ["a", "b", "flat"], "y", "boosted", **options).toPandas()
    pdf = panel.toPandas()
    assert set(got.columns) == {"date", "instrument", "a", "b", "flat", "y", "split_id", "pred"} and len(got) == len(pdf)
    for s in (0, 1):
        on = np.array([d.timetuple().tm_yday % 2 == s for d in pdf.date])
        x = pdf[["a", "b", "flat"]].to_numpy()
        want = pdf[~on].assign(want=plain_boost(x[on], pdf.y[on].to_numpy(), x[~on], trees, depth, 0.5, 2.0, 8))
        both = got[got.split_id == s].merge(want[["instrument", "date", "want"]], on=["instrument", "date"])
        assert len(both) == (~on).sum() and np.allclose(both.pred, both.want, atol=1e-6)
    if depth:
        assert np.corrcoef(got.pred, got.y)[0, 1] > 0.8


def test_one_row_per_draw_whatever_the_partitioning(spark, panel):
    options = {"trees": 2, "depth": 2, "subsample": 0.5, "seed": 4}
    runs = [
        {(r.instrument, r.date, r.split_id): r.pred for r in models.fit_predict(p, alternating(panel), ["a", "b"], "y", "boosted", **options).collect()}
        for p in (panel.repartition(1), panel.repartition(7, "a"))
    ]
    assert runs[0] == runs[1]


def test_missing_values_weights_and_starved_keys(spark, panel):
    holed = panel.withColumn("a", F.when(F.dayofmonth("date") % 5 != 0, F.col("a"))).withColumn("y", F.when(F.dayofmonth("date") != 3, F.col("y")))
    seeded = models.seeded_plan(alternating(panel), 2)
    keys = ["split_id", "seed"]
    got = models.fit_predict(holed, seeded, ["a", "b"], "y", "boosted", trees=1, depth=1, keys=keys, subsample=1)
    assert got.filter("pred is null").count() == 0 and got.select(*keys).distinct().count() == 4
    assert got.count() == 2 * panel.count()  # rows without a label are scored, too
    # a key whose training days all have weight 0 has no predictions
    starved = seeded.withColumn("sample_weight", F.when(F.col("seed") == 1, F.col("sample_weight")).otherwise(0.0))
    left = models.fit_predict(holed, starved, ["a", "b"], "y", "boosted", trees=1, depth=1, keys=keys, subsample=1)
    assert [r[0] for r in left.select("seed").distinct().collect()] == [1]
    assert models.fit_predict(holed.limit(0), seeded, ["a", "b"], "y", "boosted", trees=1, depth=1, keys=keys).count() == 0


def test_edges_are_exact_quantiles_of_the_training_rows(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 1, 1, 1, 2, 3, 4, 5)], "k int, v double")
    edges = boosting.bin_edges(df, ["v"], ["k"], bins=4).first()["_edges"]
    assert edges == {0: [2.0, 4.0]}
