"""Text, JSON, CSV and Parquet sources and sinks."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONCHAIN_SCHEMA = "time string, CapMrktCurUSD string, AdrActCnt string"
TRIAL_SCHEMA = "id string, recipe string, config_hash string, sharpe double, created string"
TRIAL_COLUMNS = ("id", "recipe", "config_hash", "sharpe", "created")
OHLCV_SCHEMA = "date date, symbol string, open double, high double, low double, close double, volume double"


def read_onchain(spark: SparkSession, path: str) -> DataFrame:
    """(date, market_cap, active_addr) from JSON rows with numbers as text; unparsable values are NULL."""
    finite = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    return spark.read.schema(ONCHAIN_SCHEMA).json(path).select(
        F.to_date(F.try_to_timestamp("time")).alias("date"), finite("CapMrktCurUSD").alias("market_cap"), finite("AdrActCnt").alias("active_addr")
    )


def read_returns(spark: SparkSession, root: str) -> DataFrame:
    """(recipe, run, date, ret) from <root>/<recipe>/<run>/returns.csv, a file or a folder of part files.

    Recipe and run are the names of the two folders above, without the ``key=`` of partition folders. Other files of a run, such
    as trades.csv, and the folder mlruns are not read.
    """
    above = r"([^/]+)/([^/]+)/(?:[^/=]+=)?returns\.csv(?:/[^/]+)?$"
    name = lambda n: F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), above, n), "^[^=]+=", "")
    rows = (
        spark.read.schema("date date, ret double").option("header", "true").option("recursiveFileLookup", "true").csv(root)
        .filter(F.col("_metadata.file_path").rlike(above)).select(name(1).alias("recipe"), name(2).alias("run"), "date", "ret")
    )
    return rows.filter(F.col("recipe") != "mlruns")


def _folder(spark: SparkSession, path: str):
    """(file system, path object) of a path in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _marked(fs, path, text: str) -> str | None:
    """Create a small file with ``text``; if it is there already, return what it holds. The store decides who was first."""
    try:
        out = fs.create(path, False)
    except Exception as e:  # noqa: BLE001 - the class differs by store
        if not fs.exists(path):
            raise e
        held = fs.open(path)
        try:
            return held.readUTF()
        finally:
            held.close()
    try:
        out.writeUTF(text)
    finally:
        out.close()
    return None


def batch_number(spark: SparkSession, path: str, name: str) -> int:
    """Number of the append ``name`` in the register's manifest: its own if it has one, else the next free one.

    Two markers in ``_log``: one per number, created by one appender only, and one per name. A crash between them burns a number.
    """
    fs, root = _folder(spark, path)
    join = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, "_log", *parts]))
    by_name = join("name", hashlib.sha256(name.encode()).hexdigest())
    if fs.exists(by_name):
        return int(_marked(fs, by_name, ""))
    numbers = join("number")
    number = len(fs.listStatus(numbers)) if fs.exists(numbers) else 0
    while True:
        number += 1
        if _marked(fs, join("number", f"{number:012d}"), name) is None:
            break
    earlier = _marked(fs, by_name, str(number))
    return number if earlier is None else int(earlier)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The trial register with ``seq``, the order in which trials were appended; a missing path is an empty register.

    A register is a log of appends: ``seq`` is the append's number and the place inside it, both written with the rows, so it does
    not depend on when files were finished. A plain JSON-lines file is one append in the order of its lines.
    """
    seq = "seq struct<batch long, block long, place long>"
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return spark.createDataFrame([], f"{TRIAL_SCHEMA}, {seq}")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.getFileStatus(root).isDirectory() else []
    if any(n.startswith("batch=") for n in names):
        rows = spark.read.schema(f"{TRIAL_SCHEMA}, place long").option("basePath", path).json(f"{path}/batch=*")
        order = F.struct(F.col("batch").cast("long").alias("batch"), F.lit(0).cast("long").alias("block"), "place")
    else:
        rows = spark.read.schema(TRIAL_SCHEMA).json(path)
        order = F.struct(F.lit(0).cast("long").alias("batch"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return rows.select(*TRIAL_COLUMNS, order.alias("seq"))


def append_trial(trials: DataFrame, path: str, *, batch: str | None = None, order: str | None = None) -> int:
    """Append trials as one batch and return its number.

    ``order`` names a whole-number column that tells the order inside the batch; without it rows count in the order of the frame. Any
    number of tasks may write. ``batch`` names the append: one of the same name replaces the earlier one and keeps its number, so a
    replayed append changes nothing. Without a name every append is a new one.
    """
    spark = trials.sparkSession
    number = batch_number(spark, path, batch or uuid.uuid4().hex)
    place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    trials.select(*TRIAL_COLUMNS, place.alias("place")).write.mode("overwrite").json(f"{path}/batch={number:012d}")
    return number


def read_ohlcv_csv(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, date, OHLCV, factor) from a header CSV, symbols upper-cased, factor 1 when absent."""
    df = spark.read.schema(OHLCV_SCHEMA).option("header", "true").csv(path)
    return df.select(F.upper("symbol").alias("instrument"), "date", "open", "high", "low", "close", "volume", F.lit(1.0).alias("factor"))


def symbols_from_text(lines: DataFrame) -> DataFrame:
    """Distinct upper-cased symbols of (line_no, value) rows with their first line; blank lines are dropped."""
    cleaned = lines.select("line_no", F.upper(F.trim("value")).alias("symbol")).filter(F.col("symbol") != "")
    return cleaned.groupBy("symbol").agg(F.min("line_no").alias("first_line"))


def require_symbols(symbols: DataFrame) -> DataFrame:
    if symbols.isEmpty():
        raise ValueError("no symbols in the file")
    return symbols


def validate_symbols(symbols: DataFrame, listing: DataFrame) -> DataFrame:
    """Attach (base, quote, status) of the listing; status defaults to TRADING, ``known`` marks unlisted symbols."""
    listed = listing.select("symbol", "base", "quote", "status", F.lit(True).alias("_hit"))
    return symbols.join(listed, "symbol", "left").select(
        "symbol", "base", "quote", F.when(F.col("_hit"), F.coalesce("status", F.lit("TRADING"))).alias("status"),
        F.col("_hit").isNotNull().alias("known"),
    )


def require_known(validated: DataFrame) -> DataFrame:
    """All symbols, if every one is listed; the unknown ones are ``validated.filter("not known")``."""
    unknown = validated.filter(~F.col("known")).select("symbol")
    first = [r["symbol"] for r in unknown.orderBy("symbol").limit(20).collect()]
    if first:
        raise ValueError(f"{unknown.count()} unknown symbols, the first are {first}")
    return validated.drop("known")


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by year; only the years present are replaced. Rows are ordered inside a file for min/max pruning.

    The rebalance hint lets Spark size the writers by the data: small years share none, large ones get as many as they need.
    """
    (
        panel.withColumn("year", F.year("date")).hint("rebalance", "year")
        .sortWithinPartitions("year", "instrument", "date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    )


def read_panel(
    spark: SparkSession, path: str, instruments: Sequence[str] | None = None, fields: Sequence[str] | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Subset of instruments, fields and dates; year partitions, columns and both filters reach the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
    if end:
        df = df.filter((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
    if instruments is not None:
        df = df.filter(F.col("instrument").isin(*instruments))
    names = fields or [c for c in df.columns if c not in ("instrument", "date", "year")]
    return df.select("instrument", "date", *names)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Metrics, returns, trades or summaries as json, csv (with header) or parquet."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "parquet": writer.parquet, "csv": lambda p: writer.option("header", "true").csv(p)}[fmt](path)
