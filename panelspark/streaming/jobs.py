"""Daily sums, last-of-day and tick-to-bar as Structured Streaming jobs.

Sources are file streams. State and checkpoints live in the shared folder, so a lost executor or a restarted query
resumes. Windows close by watermark, which also evicts
their state.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.layout import fresh_path

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 64) -> DataFrame:
    """File stream of events with a zoned timestamp (watermarks need one)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the files hold UTC wall-clock times
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    )


def daily_sums(events: DataFrame, symbol: str, value: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, symbol).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def last_of_day(events: DataFrame, symbol: str, value: str, tie: str, late: str = "1 day") -> DataFrame:
    order = F.struct("ts", tie)
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), symbol).agg(
        F.max_by(value, order).alias("last_value"), F.max("ts").alias("last_ts")
    )


def tick_bars(ticks: DataFrame, symbol: str, price: str, quantity: str, tick_id: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """OHLCV bars of a tick stream; replayed ticks inside the watermark are dropped by id."""
    order = F.struct("ts", tick_id)
    clean = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark([tick_id])
    return clean.groupBy(F.window("ts", width), symbol).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(quantity).alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def run_available(result: DataFrame, label: str, keys: tuple[str, ...] = (), mode: str = "update", root: str | None = None) -> DataFrame:
    """Drain the source and return the result table.

    ``root`` is the folder of state and table; a job started again with the same one goes on where the earlier one ended.

    State leaves memory with the watermark in both modes. ``update`` writes the windows that a micro-batch changed, and the
    table has the latest row of each of ``keys``; ``append`` writes windows once they are closed. Each micro-batch overwrites
    its own folder, so a replayed batch changes nothing.
    """
    spark = result.sparkSession
    root = root or fresh_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={batch_id}")

    query = (
        result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table = spark.read.parquet(f"{root}/table")
    if mode == "update":
        rest = [c for c in result.columns if c not in keys]
        last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        return last.select(*keys, "_last.*").select(*result.columns)
    return table.drop("batch")
