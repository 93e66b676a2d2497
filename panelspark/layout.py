"""Data-layout helpers that keep every operator spread over the cluster.

Four ideas are used all over the package:

* ``trailing``    bounded look-back windows run on (key, time block) with a halo, so one long series is many tasks;
* ``group_stats`` whole-group statistics are a partial aggregate joined back, not a window over the group;
* ``value_ranks`` exact ranks and quantiles come from a value histogram cut into chunks, so a hot group is many tasks;
* ``settle``      writes an intermediate table to the shared folder, which cuts lineage and survives executor loss.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024  # grid positions per window block
CHUNKS = 1024  # quantiles from which the cuts of a group are taken
CHUNK_ROWS = 200_000  # values or rows a chunk of a group holds, roughly


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local session without one (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("stage_scopes", default=())


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the stage tables that are settled inside once the block ends, also after an error.

    Write the result inside the block: a DataFrame that still reads a stage table cannot be used afterwards. Tables settled in other
    threads, or outside, stay. Scopes may be nested; a table belongs to the innermost one.
    """
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read many: later branches scan pruned Parquet columns instead of recomputing the lineage.

    The table stays in the shared folder until its retention, or the end of the ``stage_scope`` around the call.
    """
    path = fresh_path(df.sparkSession, label)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grid_index(pos: str, seconds: int | None = None) -> Column:
    """Integer position on the dense grid: days for a DATE, multiples of ``seconds`` for a TIMESTAMP, 0: an index."""
    if seconds == 0:
        return F.col(pos).cast("long")
    if seconds is None:
        return F.datediff(F.col(pos), F.lit("1970-01-01").cast("date")).cast("long")
    return F.floor(F.unix_seconds(F.col(pos)) / F.lit(seconds)).cast("long")


def trailing(
    df: DataFrame,
    lookback: int,
    body: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    ahead: int = 0,
    keys: Sequence[str] = ("instrument",),
    pos: str = "date",
    seconds: int | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Run bounded windows block by block.

    ``body(frame, w)`` adds columns that look at most ``lookback`` rows back and ``ahead`` rows forward. Rows near a
    block edge are copied to the neighbour as halo and dropped afterwards, so results equal one window over the whole
    series, while the longest sort any task sees is one block. The frame must be dense on the grid.

    Sliding frames cost look-back x rows of CPU but few bytes, so the partition count is fixed: AQE would merge these
    small partitions and leave the work to a few cores.
    """
    size = max(block, 4 * lookback, 4 * ahead)
    idx = grid_index(pos, seconds)
    home = F.floor(idx / F.lit(size)).cast("long")
    offset = idx - home * F.lit(size)
    copies = [home]
    if lookback:
        copies.append(F.when(offset >= F.lit(size - lookback), home + 1))
    if ahead:
        copies.append(F.when(offset < F.lit(ahead), home - 1))
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(F.array(*copies))))
    spread = spread_over(spread, *keys, "_block")
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    return body(spread, w).filter(F.col("_block") == F.col("_home")).drop("_home", "_block")


def group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row: map-side combined, then an equi-join AQE may broadcast or split."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")


def cuts_of(size: Column, quantiles: Column, chunks: int, chunk_rows: int) -> Column:
    """As many of a group's quantiles as cut it into chunks of about ``chunk_rows``; none for a group of one chunk."""
    step = F.greatest(F.lit(1), F.floor(F.lit(chunks) / F.ceil(size / F.lit(chunk_rows))))
    return F.array_distinct(F.filter(quantiles, lambda _, i: F.pmod(i + 1, step) == 0))


def quantile_marks(value: str, chunks: int) -> Column:
    # one expression in SQL: a column per mark would cost the driver more than most queries take
    marks = ", ".join(f"{i / chunks!r}D" for i in range(1, chunks))
    return F.expr(f"percentile_approx(`{value}`, array({marks}), {chunks * 4})")


def with_chunks(rows: DataFrame, keys: Sequence[str], cut_on: str, chunks: int, chunk_rows: int, *sums: Column) -> DataFrame:
    """Attach ``_size`` (rows of the group), ``sums`` (aggregates of it) and ``_chunk``, and deal the rows by (keys, chunk).

    Sizes are one plain aggregate. Only groups above ``chunk_rows`` meet a quantile sketch and are cut along ``cut_on``; all others
    go through as chunk 0. Where no group is that large, the sketch has no input.
    """
    keys = list(keys)
    sized = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *sums), keys)
    large = sized.filter(F.col("_size") > chunk_rows).groupBy(*keys).agg(F.max("_size").alias("_n"), quantile_marks(cut_on, chunks).alias("_marks"))
    cuts = large.select(*keys, cuts_of(F.col("_n"), F.col("_marks"), chunks, chunk_rows).alias("_cuts"))
    split = sized.join(cuts, keys, "left").withColumn("_chunk", F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col(cut_on))), F.lit(0))).drop("_cuts")
    return split.withColumn("_chunk", F.when(F.col("_size") > chunk_rows, F.col("_chunk")).otherwise(0)).repartition(*keys, "_chunk")


def _chunk_offsets(chunked: DataFrame, keys: Sequence[str], total: Column, chunk_rows: int) -> DataFrame:
    """(keys, _chunk, _offset): what earlier chunks of a large group hold. Groups of one chunk have no row."""
    tops = chunked.groupBy(*keys, "_chunk").agg(total.alias("_sum"), F.max("_size").alias("_size")).filter(F.col("_size") > chunk_rows)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(*keys, "_chunk", F.sum("_sum").over(earlier).alias("_offset"))


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, *, chunks: int = CHUNKS, chunk_rows: int = CHUNK_ROWS, copies: str | None = None
) -> DataFrame:
    """One row per (keys, distinct value): ``copies``, ``below`` (rows with a smaller value) and ``total``.

    A row stands for itself, or for as many as its column ``copies`` says.
    Equal values are counted before anything is sorted. A group with more distinct values than ``chunk_rows`` is cut at approximate
    quantiles, and only chunk totals are ordered per group, so no task ever holds a whole hot group.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("copies"))
    split = with_chunks(hist, keys, value, chunks, chunk_rows, F.sum("copies").alias("total"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = split.withColumn("_inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    offsets = _chunk_offsets(split, keys, F.sum("copies"), chunk_rows)
    return ranked.join(offsets, [*keys, "_chunk"], "left").select(
        *keys, value, "copies", (F.coalesce("_offset", F.lit(0)) + F.col("_inside")).alias("below"), "total"
    )


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach ``below``, ``copies`` and ``total`` to every row with a non-NULL value."""
    keys = list(keys)
    there = df.filter(F.col(value).isNotNull())
    return there.join(value_ranks(there, keys, value, chunk_rows=chunk_rows), [*keys, value])


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], *, chunk_rows: int = CHUNK_ROWS, copies: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, read off the chunked value histogram; NULL values are skipped."""
    ranks = value_ranks(df, keys, value, chunk_rows=chunk_rows, copies=copies)
    aggs = []
    for name, q in quantiles.items():
        place = (F.col("total") - 1) * F.lit(q)
        low = F.floor(place)
        upto = F.col("below") + F.col("copies")
        aggs += [
            F.min(F.when(upto > low, F.col(value))).alias(f"_{name}_lo"),
            F.min(F.when(upto > F.least(low + 1, F.col("total") - 1), F.col(value))).alias(f"_{name}_hi"),
            F.max(place - low).alias(f"_{name}_f"),
        ]
    out = ranks.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
            for n in quantiles
        ],
    )


def spread_over(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows that will be expanded or are CPU-heavy over all shuffle partitions; AQE keeps a stated count."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cut_on: str, value: Column, out: str,
    *, chunks: int = CHUNKS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, ordered by ``order`` whose first column is ``cut_on``.

    A group above ``chunk_rows`` is cut along ``cut_on``; each chunk is summed by its own task and the chunk totals carry over.
    """
    keys = list(keys)
    split = with_chunks(df.withColumn("_value", value), keys, cut_on, chunks, chunk_rows)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _chunk_offsets(split, keys, F.sum("_value"), chunk_rows)
    return (
        split.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0.0)))
        .join(offsets, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_offset", F.lit(0.0)) + F.col("_inside"))
        .drop("_chunk", "_value", "_inside", "_offset", "_size")
    )
