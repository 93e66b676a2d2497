"""Zipped CSV archives: one distributed decode, everything else in DataFrame columns.

Decoders take a DataFrame shaped like Spark's ``binaryFile`` source (path, length, content), so the same code reads a
folder tree and archives that arrive in a table.
"""
from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import epoch_to_date, epoch_to_ts, finite, vwap
from panelspark.layout import settle

# Column layouts of the archives and the names of the derived fields.
BAR_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "count",
    "taker_buy_base_volume", "taker_buy_quote_volume", "ignore",
)
FUNDING_COLUMNS = ("calc_time", "funding_interval_hours", "last_funding_rate")
TICK_COLUMNS = ("agg_id", "price", "quantity", "first_id", "last_id", "ts", "is_buyer_maker", "is_best_match")
METRIC_FIELDS = {
    "oi": "sum_open_interest", "oi_value": "sum_open_interest_value", "ls_top": "sum_toptrader_long_short_ratio",
    "ls_global": "count_long_short_ratio", "taker_ratio": "sum_taker_long_short_vol_ratio",
}
DATED_NAME = r"([^/]+?)-([^/-]+)-(\d{4}-\d{2}(?:-\d{2})?)\.zip$"

# Texts that count as a missing number in archive cells.
MISSING = ("", "NA", "N/A", "n/a", "nan", "NaN", "-nan", "-NaN", "null", "NULL", "None", "<NA>", "#N/A", "#NA")

BLOCK_BYTES = 4 << 20


def archive_files(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "content")
    )


def archive_key(path: str | Column) -> tuple[Column, Column, Column]:
    """(symbol, kind, date text) from ``.../SYMBOL-KIND-YYYY-MM[-DD].zip``."""
    p = F.col(path) if isinstance(path, str) else path
    return tuple(F.regexp_extract(p, DATED_NAME, i) for i in (1, 2, 3))


def _is_number(cell: bytes) -> bool:
    try:
        return int(cell) is not None
    except ValueError:
        return False


def _whole_member(archive: zipfile.ZipFile) -> tuple[str, int, str | None]:
    """(member, bytes of its header line, header) after it was read to its end, so that length, checksum and encoding hold."""
    members = archive.namelist()
    if len(members) != 1:
        raise ValueError(f"expected one member, found {len(members)}")
    decoder, first, ended, data = codecs.getincrementaldecoder("utf-8")(), b"", False, False
    with archive.open(members[0]) as member:
        while chunk := member.read(BLOCK_BYTES):
            decoder.decode(chunk)
            if ended:
                data = data or bool(chunk.strip())
            else:
                first += chunk
                line, newline, rest = first.partition(b"\n")
                if newline:
                    first, ended, data = line, True, bool(rest.strip())
        decoder.decode(b"", True)
    header = first.strip() and not _is_number(first.partition(b",")[0])
    if not data and (header or not first.strip()):
        raise ValueError("no data rows")
    return members[0], len(first) + 1 if header else 0, first.decode().strip() if header else None


def _text_blocks(archive: zipfile.ZipFile, member: str, skip: int) -> Iterator[bytes]:
    """The member after ``skip`` bytes in blocks that end at line ends."""
    with archive.open(member) as lines:
        lines.read(skip)
        held = b""
        while chunk := lines.read(BLOCK_BYTES):
            held += chunk
            cut = held.rfind(b"\n") + 1
            if cut:
                yield held[:cut]
                held = held[cut:]
        if held:
            yield held


def read_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line, header, error): exactly one non-empty CSV member per zip, else one error row and no line.

    A member is read through once before any of it counts: a wrong checksum, a cut or damaged stream or broken UTF-8 gives one
    error row and nothing else. Then it leaves the task in text blocks of bounded size; lines are split by Spark. A first line
    whose first cell is no whole number is the header and is carried on every row. ``line_no`` counts lines after it.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(path, first, text, header, error):
            values = ([path], [first], [text], [header], [error])
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["path", "first", "text", "header", "error"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                    member, skip, header = _whole_member(archive)
                except (ValueError, EOFError, NotImplementedError, RuntimeError, zlib.error, zipfile.BadZipFile) as err:
                    yield block(path, 0, None, None, f"{type(err).__name__}: {err}")
                    continue
                first = 0
                for text in _text_blocks(archive, member, skip):
                    yield block(path, first, text.decode(), header, None)
                    first += text.count(b"\n")

    blocks = files.select("path", "content").mapInArrow(decode, "path string, first long, text string, header string, error string")
    lines = blocks.select("path", "first", "header", "error", F.posexplode_outer(F.split("text", "\r?\n")).alias("at", "line"))
    return lines.select("path", (F.col("first") + F.coalesce("at", F.lit(0))).alias("line_no"), "line", "header", "error").filter("error is not null or line <> ''")


def read_archive(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positional string columns of every data line, with (path, line_no, header, error)."""
    cells = F.split("line", ",")
    return read_lines(files).select("path", "line_no", "header", "error", *[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def no_number(*cells: str | Column) -> Column:
    """Why a line is refused: the first cell that is neither a number nor a text for a missing one, else NULL."""
    named = [F.col(c) if isinstance(c, str) else c for c in cells]
    wrong = [F.when(c.try_cast("double").isNull() & ~F.trim(c).isin(*MISSING), F.concat(F.lit("not a number: "), c)) for c in named]
    return F.coalesce(*wrong)


def no_epoch(cell: str) -> Column:
    return F.when(F.col(cell).try_cast("long").isNull(), F.concat(F.lit("no time: "), F.coalesce(cell, F.lit(""))))


def accepted(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows of sound files, bad records) of (path, line_no, error, wrong, ...): a file with any error gives no row at all.

    The typed rows are written once, so archives are decoded once; ``reason`` is that of the file's first bad line.
    """
    typed = settle(rows.withColumn("wrong", F.coalesce("error", "wrong")).drop("error"), label)
    bad = typed.filter("wrong is not null").groupBy("path").agg(F.min_by("wrong", "line_no").alias("reason"))
    return typed.filter("wrong is null").join(bad.select("path"), "path", "left_anti").drop("path", "line_no", "wrong"), bad


def number(c: str | Column) -> Column:
    """Text to DOUBLE; anything unparsable, NaN or infinite is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def read_daily_bars(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, bad records): one row per file whose date equals the file date, 11 bar fields."""
    symbol, _, day = archive_key("path")
    raw = read_archive(files, BAR_COLUMNS).select(
        "path", F.coalesce("error", no_epoch("open_time"), no_number("open", "high", "low", "close", "volume", "quote_asset_volume")).alias("error"), symbol.alias("instrument"), epoch_to_date(F.col("open_time").try_cast("long")).alias("date"),
        day.try_cast("date").alias("_file_date"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        number("quote_asset_volume").alias("amount"), number("count").alias("trades"),
        number("taker_buy_base_volume").alias("taker_buy_base"), number("taker_buy_quote_volume").alias("taker_buy_amount"),
    )
    # One file normally yields one row, so the per-file count is a cheap combinable aggregate.
    names = [c for c in raw.columns if c != "path"]
    per_file = raw.groupBy("path").agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*names)).alias("_r")).select("path", "_rows", "_r.*")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_rows") != 1, F.concat(F.lit("expected 1 row, got "), F.col("_rows").cast("string")))
        .when(~F.col("date").eqNullSafe(F.col("_file_date")), F.lit("date differs from file date"))
    )
    judged = settle(per_file.withColumn("reason", reason), "daily-bars")
    bars = judged.filter(F.col("reason").isNull()).select(
        "instrument", "date", "open", "high", "low", "close", "volume", "amount", "trades", "taker_buy_base", "taker_buy_amount",
        vwap("amount", "volume", "close").alias("vwap"), F.lit(1.0).alias("factor"),
    )
    return bars, judged.filter(F.col("reason").isNotNull()).select("path", "reason")


def read_hourly_bars(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hourly bars, bad records)."""
    symbol, _, _ = archive_key("path")
    prices = ("open", "high", "low", "close", "volume")
    return accepted(read_archive(files, BAR_COLUMNS).select(
        "path", "line_no", "error", F.coalesce(no_epoch("open_time"), no_number(*prices)).alias("wrong"),
        epoch_to_ts(F.col("open_time").try_cast("long")).alias("ts"), symbol.alias("symbol"), *[number(c).alias(c) for c in prices],
    ), "hourly-bars")


def read_funding(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((perp_symbol, ts, rate) settlements, bad records); millisecond jitter stays inside the second."""
    symbol, _, _ = archive_key("path")
    return accepted(read_archive(files, FUNDING_COLUMNS).select(
        "path", "line_no", "error", F.coalesce(no_epoch("calc_time"), no_number("last_funding_rate")).alias("wrong"),
        symbol.alias("perp_symbol"), epoch_to_ts(F.col("calc_time").try_cast("long")).alias("ts"), number("last_funding_rate").alias("rate"),
    ), "funding")


def read_metrics(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((perp_symbol, create_time, five fields), bad records); columns are found by header name, a file lacking one is bad."""
    symbol, _, _ = archive_key("path")
    names, cells = F.transform(F.split("header", ","), lambda c: F.trim(c)), F.split("line", ",")
    # a name that is not there has position 0: the cell before the first, which is none
    at = lambda name: F.trim(F.get(cells, F.coalesce(F.array_position(names, name).cast("int"), F.lit(0)) - 1))
    needed = F.array(F.lit("create_time"), *[F.lit(c) for c in METRIC_FIELDS.values()])
    lacking = F.array_except(needed, F.coalesce(names, F.array().cast("array<string>")))
    wrong = F.when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacking, ", ")))
    return accepted(read_lines(files).select(
        "path", "line_no", "error", F.coalesce(wrong, no_number(*[at(c) for c in METRIC_FIELDS.values()])).alias("wrong"),
        symbol.alias("perp_symbol"), F.try_to_timestamp(at("create_time")).alias("create_time"), *[number(at(c)).alias(f) for f, c in METRIC_FIELDS.items()],
    ), "metrics")


def read_basis(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((perp_symbol, date, basis), bad records): close of the file's last premium-index bar, under the file's date."""
    symbol, _, day = archive_key("path")
    width = F.size(F.split("line", ","))
    cells = F.split("line", ",")
    close = F.trim(F.get(cells, F.lit(BAR_COLUMNS.index("close"))))
    rows, bad = accepted(read_lines(files).select(
        "path", "line_no", "error", F.coalesce(F.when(width != len(BAR_COLUMNS), F.concat(F.lit("columns: "), width.cast("string"))), no_number(close)).alias("wrong"),
        symbol.alias("perp_symbol"), day.try_cast("date").alias("date"), F.struct("line_no", number(close).alias("basis")).alias("bar"),
    ), "basis")
    return rows.groupBy("perp_symbol", "date").agg(F.max("bar").alias("bar")).select("perp_symbol", "date", F.col("bar.basis").alias("basis")), bad


def read_ticks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((symbol, date, price, quantity, is_buyer_maker), bad records) of zipped trades, one file per symbol and day."""
    symbol, _, day = archive_key("path")
    maker = F.col("is_buyer_maker").try_cast("boolean")
    return accepted(read_archive(files, TICK_COLUMNS).select(
        "path", "line_no", "error", F.coalesce(no_number("price", "quantity"), F.when(maker.isNull(), "no side")).alias("wrong"),
        symbol.alias("symbol"), day.try_cast("date").alias("date"), number("price").alias("price"), number("quantity").alias("quantity"), maker.alias("is_buyer_maker"),
    ), "ticks")


def sample_manifest(files: DataFrame, pairs: Sequence[str], start: str, end: str) -> DataFrame:
    """Per pair the present dates inside the window and their bytes. Sizes come from the listing, contents stay unread."""
    symbol, _, day = archive_key("path")
    inside = files.select(symbol.alias("pair"), day.try_cast("date").alias("date"), "length").filter(
        F.col("pair").isin(*pairs) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    return inside.groupBy("pair").agg(
        F.array_sort(F.collect_set("date")).alias("present_dates"), F.countDistinct("date").alias("days"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.sum("length").alias("total_bytes"),
    )


def checksum_check(files: DataFrame, published: DataFrame) -> DataFrame:
    """(path, status) with status ok, mismatch, or unvalidated where no hash was published; case does not matter."""
    actual = files.select("path", F.sha2("content", 256).alias("_actual"))
    status = F.when(F.col("sha256").isNull(), "unvalidated").when(F.lower("sha256") == F.col("_actual"), "ok").otherwise("mismatch")
    return actual.join(published.select("path", "sha256"), "path", "left").select("path", status.alias("status"))
