"""Split designs: purged combinatorial CV, walk-forward periods, out-of-sample windows, segment roles.

Split tables grow with the calendar and the number of combinations, never with the panel; they are joined to it on date.
"""
from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import window_days


def cv_groups(calendar: DataFrame, n: int) -> DataFrame:
    """Contiguous groups of the calendar (date, pos, grp); the first groups are one longer. One row per day."""
    if n < 2:
        raise ValueError("at least two groups are needed")
    w = Window.orderBy("date")
    return calendar.select("date").distinct().select(
        "date", (F.row_number().over(w) - 1).alias("pos"), (F.ntile(n).over(w) - 1).alias("grp")
    )


def combinations_table(spark, n: int, k: int) -> DataFrame:
    """All k-of-n group sets in lexicographic order: (split_id, grp, is_test), one row per split and group.

    A set is a bit mask whose highest bit is group 0, so descending masks are the lexicographic order.
    """
    masks = spark.range(2**n).filter(F.bit_count("id") == k)
    # The number of sets is a parameter of the design (n <= 20 in practice), not of the data.
    ranked = masks.select((F.row_number().over(Window.orderBy(F.desc("id"))) - 1).alias("split_id"), F.col("id").alias("_mask"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return ranked.select("split_id", "_mask", groups.alias("grp")).select(
        "split_id", "grp", (F.getbit("_mask", F.lit(n - 1) - F.col("grp")) == 1).alias("is_test")
    )


def cpcv_splits(calendar: DataFrame, n: int, k: int, purge: int, embargo: int) -> DataFrame:
    """(split_id, date, grp, role) with role test or train; purged and embargoed days are left out.

    Test blocks are described by their group bounds: a training day is dropped when it lies within ``purge`` positions
    before, or ``embargo`` positions after, a run of test groups. Runs are merged on the tiny (split, group) table.
    """
    if not 1 <= k < n:
        raise ValueError("test groups must be in [1, n)")
    days = cv_groups(calendar, n)
    bounds = days.groupBy("grp").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    sets = combinations_table(calendar.sparkSession, n, k)
    test = sets.filter("is_test").join(F.broadcast(bounds), "grp").withColumn(
        "_run", F.col("grp") - F.row_number().over(Window.partitionBy("split_id").orderBy("grp"))
    )
    blocks = test.groupBy("split_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    per_split = blocks.groupBy("split_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_blocks"))  # at most k blocks
    plan = sets.join(per_split, "split_id").join(days, "grp")
    near = F.exists(
        "_blocks",
        lambda b: ((F.col("pos") >= b.lo - purge) & (F.col("pos") < b.lo))
        | ((F.col("pos") > b.hi) & (F.col("pos") <= b.hi + embargo)),
    )
    role = F.when(F.col("is_test"), "test").when(~near, "train")
    return plan.select("split_id", "date", "grp", role.alias("role")).filter(F.col("role").isNotNull())


def starved_splits(plan: DataFrame) -> DataFrame:
    """Splits without a single training day; the caller refuses the design when any exists."""
    counts = plan.groupBy("split_id").agg(F.count_if(F.col("role") == "train").alias("train_days"))
    return counts.filter(F.col("train_days") == 0).select("split_id")


def path_assignment(spark, n: int, k: int) -> DataFrame:
    """(path_id, grp, split_id): path j takes each group from the j-th split that tests it."""
    order = Window.partitionBy("grp").orderBy("split_id")
    return combinations_table(spark, n, k).filter("is_test").select(
        "grp", "split_id", (F.row_number().over(order) - 1).alias("path_id")
    )


def n_paths(n: int, k: int) -> int:
    return comb(n - 1, k - 1)


def assemble_paths(predictions: DataFrame, n: int, k: int) -> DataFrame:
    """Give every (split_id, grp) test prediction its path; each cell is used exactly once."""
    paths = path_assignment(predictions.sparkSession, n, k)
    return predictions.join(F.broadcast(paths), ["split_id", "grp"])


def wf_periods(
    bounds: DataFrame, *, freq: str = "quarter", window: str = "expanding", rolling_years: int = 3, purge: int = 0
) -> DataFrame:
    """Retrain periods of one row (train_start, test_start, test_end): calendar quarters or years, clamped.

    train_end = period start - (purge + 1) days; the training window expands or spans ``rolling_years``.
    """
    unit, step = ("QUARTER", "INTERVAL 3 MONTH") if freq == "quarter" else ("YEAR", "INTERVAL 12 MONTH")
    starts = bounds.withColumn(
        "_p", F.explode(F.sequence(F.trunc("test_start", unit), F.trunc("test_end", unit), F.expr(step)))
    )
    begin = F.greatest("_p", "test_start")
    end = F.least(F.date_sub(F.add_months("_p", 3 if freq == "quarter" else 12), 1), "test_end")
    train_from = F.add_months(begin, -12 * rolling_years) if window == "rolling" else F.col("train_start")
    return starts.select(
        F.row_number().over(Window.orderBy("_p")).alias("period_id"), train_from.alias("train_start"),
        F.date_sub(begin, purge + 1).alias("train_end"), begin.alias("test_start"), end.alias("test_end"),
    )


def oos_windows(starts: DataFrame, data: DataFrame, purge: int = 8) -> DataFrame:
    """Expanding out-of-sample windows from (test_start) rows and one (data_start, data_end) row."""
    w = Window.orderBy("test_start")
    s = starts.select(
        "test_start", F.lead("test_start").over(w).alias("_next"),
        data.select("data_start").scalar().alias("data_start"), data.select("data_end").scalar().alias("data_end"),
    )
    train_end = F.date_sub("test_start", purge)
    return s.select(
        F.concat(F.lit("oos_"), F.year("test_start")).alias("label"), F.col("data_start").alias("train_start"),
        train_end.alias("train_end"), F.date_add(train_end, 1).alias("valid_start"), F.date_sub("test_start", 1).alias("valid_end"),
        "test_start", F.coalesce(F.date_sub("_next", 1), F.col("data_end")).alias("test_end"),
    )


def segment_roles(panel: DataFrame, segments: DataFrame) -> DataFrame:
    """Tag rows train / valid / test from (role, start, end) ranges by an equi-join on the days of the ranges."""
    return panel.join(window_days(segments, "role"), "date")


def window_roles(windows: DataFrame) -> DataFrame:
    """(label, role, date) of the train and test ranges of every window."""
    spans = windows.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("role"), F.col("train_start").alias("a"), F.col("train_end").alias("b")),
                F.struct(F.lit("test").alias("role"), F.col("test_start").alias("a"), F.col("test_end").alias("b")),
            )
        ).alias("_s"),
    ).select("label", "_s.*")
    days = F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date")
    return spans.filter(F.col("a") <= F.col("b")).select("label", "role", days)
