"""The layout helpers give the same results whether a group is cut into pieces or not."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark import layout
from panelspark.operators import asof, windows as wo
from tests.conftest import day


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds nine tenths of the rows and a third of them share one value."""
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.9, "hot", "cold")
    value = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 10, n), 1))
    pdf = pd.DataFrame({"key": key, "v": value, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(8)


@pytest.mark.parametrize("rows_a_chunk", [10, 10**9])
def test_value_ranks_match_pandas(skewed, rows_a_chunk):
    pdf, df = skewed
    got = layout.value_ranks(df, ["key"], "v", chunks=16, chunk_rows=rows_a_chunk).toPandas().set_index(["key", "v"])
    low = pdf.groupby("key")["v"].rank(method="min") - 1
    want = pdf.assign(below=low).drop_duplicates(["key", "v"]).set_index(["key", "v"])
    assert len(got) == len(want)
    assert (got["below"].sort_index().astype(int) == want["below"].sort_index().astype(int)).all()
    assert got["copies"].sum() == len(pdf)
    if rows_a_chunk == 10:
        assert (got["total"] == pdf.groupby("key").size().reindex(got.index.get_level_values(0)).to_numpy()).all()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    for hot in (20, 10**9):
        got = layout.group_quantiles(df, ["key"], "v", {"a": 0.0, "b": 0.137, "c": 0.5, "d": 1.0}, chunk_rows=hot).toPandas().set_index("key")
        for k, part in pdf.groupby("key"):
            assert np.allclose(got.loc[k, list("abcd")].astype(float), np.quantile(part["v"], [0, 0.137, 0.5, 1]))


def test_row_ranks_do_not_depend_on_the_path(skewed):
    pdf, df = skewed
    a, b = (layout.with_ranks(df, ["key"], "v", chunk_rows=hot).orderBy("id").toPandas() for hot in (10, 10**9))
    pd.testing.assert_frame_equal(a[["id", "below", "copies", "total"]], b[["id", "below", "copies", "total"]])
    panel = df.select(F.col("id").cast("string").alias("instrument"), F.col("key").alias("date"), "v")
    x, y = (wo.cs_rank_pct(panel, {"r": "v"}, chunk_rows=hot).orderBy("instrument").toPandas() for hot in (10, 10**9))
    assert np.allclose(x["r"], y["r"]) and np.allclose(x.set_index(x.instrument.astype(int))["r"].sort_index(), pdf.groupby("key")["v"].rank(pct=True))


def test_running_total_in_chunks(skewed):
    pdf, df = skewed
    got = layout.running_total(df, ["key"], ["id"], "id", F.abs("v"), "before", chunks=8, chunk_rows=50).toPandas().sort_values("id")
    want = pdf.assign(a=pdf["v"].abs()).groupby("key")["a"].transform(lambda s: s.cumsum().shift(fill_value=0))
    assert np.allclose(got["before"].to_numpy(), want.to_numpy())


def test_trailing_blocks_equal_one_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(k, day(n), None if rng.random() < 0.1 else float(rng.normal())) for k in "ab" for n in range(300)], columns=["instrument", "date", "x"])
    df = spark.createDataFrame(pdf, "instrument string, date date, x double")
    body = lambda d, w: d.withColumn("p", wo.ref("x", 3, w)).withColumns({"m": wo.roll_mean("p", 5, w), "f": wo.forward_sum("x", 4, w)})
    blocked = layout.trailing(df, 8, body, ahead=4, block=40).orderBy("instrument", "date").toPandas()
    whole = body(df, Window.partitionBy("instrument").orderBy("date")).orderBy("instrument", "date").toPandas()
    pd.testing.assert_frame_equal(blocked[whole.columns], whole)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_blocks_match_merge_asof(spark, strict):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"instrument": "a", "date": [day(n) for n in range(0, 400, 3)]})
    right = pd.DataFrame({"instrument": "a", "date": [day(int(n)) for n in sorted(rng.choice(400, 25, replace=False))]})
    right["v"] = [None if rng.random() < 0.3 else float(n) for n in range(len(right))]
    got = asof.asof(
        spark.createDataFrame(left, "instrument string, date date"), spark.createDataFrame(right, "instrument string, date date, v double"), ["v"],
        strict=strict, block=32,
    ).orderBy("date").toPandas()
    want = pd.merge_asof(left.assign(date=pd.to_datetime(left.date)), right.assign(date=pd.to_datetime(right.date)), on="date", allow_exact_matches=not strict)
    assert np.allclose(got["v"].astype(float), want["v"].astype(float), equal_nan=True)


def test_settle_uses_the_shared_folder(spark):
    base = layout.shared_dir(spark)
    df = layout.settle(spark.range(5).withColumn("x", F.lit("é")))
    assert df.count() == 5 and base
    assert layout.shared_dir(spark) == base


def test_plans_are_built_without_jobs(spark):
    """Ranks, rank correlation, medians and the book walk only describe work; nothing runs until a result is asked for."""
    from panelspark.operators import aggregates as ag, stats

    df = spark.range(200).selectExpr("cast(id % 7 as string) AS instrument", "date_add(date'2025-01-01', cast(id / 7 as int)) AS date", "cast(id as double) AS x", "cast(id % 5 as double) AS y")
    ticks = df.selectExpr("instrument", "date", "x + 1 AS price", "y + 1 AS quantity", "x AS seq")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    wo.cs_rank_pct(df, {"a": "x", "b": "y"})
    stats.rank_ic(df, "x", "y")
    ag.cross_sectional_median(df, "x")
    ag.book_walk_impact(ticks, ["instrument", "date"], ["seq"])
    assert not tracker.getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stage_scope_removes_its_tables_only(spark, tmp_path):
    import os

    files = lambda df: {os.path.dirname(f.removeprefix("file:")) for f in df.inputFiles()}
    outside = layout.settle(spark.range(5))
    with layout.stage_scope(spark):
        first = layout.settle(spark.range(3))
        with layout.stage_scope(spark):
            second = layout.settle(first.withColumn("x", F.col("id") * 2))
            second.write.parquet(f"{tmp_path}/result")
            inner = files(second)
        assert not any(map(os.path.exists, inner)) and first.count() == 3
        kept = files(first)
    assert not any(map(os.path.exists, kept)) and outside.count() == 5
    assert spark.read.parquet(f"{tmp_path}/result").count() == 3
    with pytest.raises(ZeroDivisionError), layout.stage_scope(spark):
        gone = files(layout.settle(spark.range(2)))
        1 / 0
    assert not any(map(os.path.exists, gone))
