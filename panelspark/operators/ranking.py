"""Top-k, schedules, best-of and de-duplication."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.panel import calendar


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark limits each group inside every partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def liquidity_schedule(panel: DataFrame, top_n: int, lookback: int, *, strict: bool = False, field: str = "amount") -> DataFrame:
    """Month starts with their ``top_n`` instruments by trailing mean of ``field``: (month, instrument, rank, score).

    The mean covers the last ``lookback`` calendar rows up to and including the month start (``strict``: the day
    before it) and needs one non-NULL value. Instead of a window per instrument, each value is sent to the month
    starts it counts for and averaged there, so the work is one combinable aggregate.
    """
    span = calendar(panel)
    months = span.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence(F.trunc(F.col("lo"), "MM"), F.col("hi"), F.expr("INTERVAL 1 MONTH"))).alias("month"), "lo"
    ).filter(F.col("month") >= F.col("lo")).select("month")
    # A day's value counts for the month starts of the following `lookback` days, at most lookback/28 + 1 of them.
    shift = 1 if strict else 0
    contributions = panel.filter(F.col(field).isNotNull()).select(
        "instrument", field, "date",
        F.explode(
            F.sequence(
                F.trunc(F.date_add("date", shift), "MM"),
                F.trunc(F.date_add("date", lookback - 1 + shift), "MM"),
                F.expr("INTERVAL 1 MONTH"),
            )
        ).alias("month"),
    ).filter(F.col("month") >= F.date_add("date", shift))
    scores = contributions.groupBy("month", "instrument").agg(F.avg(field).alias("score")).join(months, "month", "left_semi")
    return top_per_group(scores, ["month"], [F.desc("score"), "instrument"], top_n)


def top_bottom_k(scored: DataFrame, k: int, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Long and short legs per date with k' = min(k, n // 2); ties go by instrument. Dates with k' = 0 have no rows.

    Both ends are cut to k by the partition-local group limit before the per-date count is joined.
    """
    by = [*keys, "date"]
    longs = top_per_group(scored, by, [F.desc(score), F.desc("instrument")], k).withColumn("leg", F.lit("long"))
    shorts = top_per_group(scored, by, [F.asc(score), F.asc("instrument")], k).withColumn("leg", F.lit("short"))
    sizes = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    both = longs.unionByName(shorts).join(sizes, by)
    return both.withColumn("k", F.least(F.lit(k), F.floor(F.col("_n") / 2)).cast("long")).filter(F.col("rank") <= F.col("k")).drop("_n")


def rank_table(trials: DataFrame, score: str = "sharpe", trial: str = "trial") -> DataFrame:
    """Descending table of one row per trial; the first name wins a tie."""
    return trials.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), trial)))


def best_cell(cells: DataFrame) -> DataFrame:
    """Among positive betas the lowest q, then the largest absolute IC; without any, the lowest q."""
    return cells.orderBy(
        F.when(F.col("beta") > 0, 0).otherwise(1), "bh_q", F.when(F.col("beta") > 0, -F.abs("rank_ic")), "predictor", "k", "h"
    ).limit(1)


def dedupe_trials(register: DataFrame, key: str = "config_hash", seq: str = "seq") -> DataFrame:
    """Last Sharpe per configuration, ordered by first appearance."""
    return register.groupBy(key).agg(F.max_by("sharpe", seq).alias("sharpe"), F.min(seq).alias("first_seen"))


def dedupe_dates(series: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keep the first row per date of concatenated periods: a combinable minimum instead of a sort."""
    rest = [c for c in series.columns if c not in (*keys, "date", order)]
    first = series.groupBy(*keys, "date").agg(F.min_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(order))
    return first.select(*keys, "date", order, "_r.*")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    return df.orderBy(*order).limit(n)
