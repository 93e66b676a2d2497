"""Archive decoding, files, and streams against batch results."""
import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.layout import fresh_path
from panelspark.operators import aggregates as ag, joins
from panelspark.sources import archives as ar, parameters, tables as tb
from panelspark.streaming import jobs
from tests.conftest import SMALL, day, rows

BAR = "{t},1.0,2.0,0.5,1.5,{v},0,30.0,7,4.0,8.0,0"


def put(folder, name, members):
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / name, "w") as z:
        for n, text in members.items():
            z.writestr(n, text)


def test_daily_bars_from_zips(spark, tmp_path):
    k = tmp_path / "spot/daily/klines/ABC/1d"
    put(k, "ABC-1d-2024-12-31.zip", {"a.csv": BAR.format(t=1735603200000, v=20.0)})
    put(k, "ABC-1d-2025-01-01.zip", {"a.csv": ",".join(ar.BAR_COLUMNS) + "\n" + BAR.format(t=1735689600000000, v=0.0) + "\n"})
    put(k, "ABC-1d-2025-01-02.zip", {"a.csv": BAR.format(t=1735689600000000, v=1.0)})
    put(k, "ABC-1d-2025-01-03.zip", {"a.csv": BAR.format(t=1, v=1), "b.csv": "x"})
    put(k, "ABC-1d-2025-01-04.zip", {"a.csv": ""})
    put(k, "ABC-1d-2025-01-05.zip", {"a.csv": BAR.format(t=1736035200000, v=1) + "\n" + BAR.format(t=1736035200000, v=1)})
    (k / "ABC-1d-2025-01-06.zip").write_bytes(b"not a zip")
    bars, bad = ar.read_daily_bars(ar.archive_files(spark, str(tmp_path)))
    assert rows(bars.select("instrument", "date", "vwap", "trades"), "date") == [("ABC", dt.date(2024, 12, 31), 1.5, 7.0), ("ABC", dt.date(2025, 1, 1), 1.5, 7.0)]
    reasons = [r["reason"] for r in bad.orderBy("path").collect()]
    assert reasons[0].startswith("date differs") and "2" in reasons[1] and "no data" in reasons[2] and reasons[3] == "expected 1 row, got 2" and "zip" in reasons[4]


def test_funding_mapping_does_not_bleed(spark, tmp_path):
    head = "calc_time,funding_interval_hours,last_funding_rate\n"
    ms = lambda d, h: int(dt.datetime(2024, 9, d, h, tzinfo=dt.timezone.utc).timestamp() * 1000) + 5
    put(tmp_path / "f", "OLDUSDT-fundingRate-2024-09.zip", {"a.csv": head + "\n".join(f"{ms(d, h)},8,0.001" for d in (10, 11, 13) for h in (0, 8, 16))})
    put(tmp_path / "f", "NEWUSDT-fundingRate-2024-09.zip", {"a.csv": "\n".join(f"{ms(d, h)},4,0.002" for d in (10, 13) for h in (0, 4, 8, 12, 16, 20))})

    daily = ag.daily_funding(ar.read_funding(ar.archive_files(spark, str(tmp_path)))[0])
    mapping = spark.createDataFrame(
        [("NEWUSDT", "OLDUSDT", None, dt.date(2024, 9, 10)), ("NEWUSDT", "NEWUSDT", dt.date(2024, 9, 13), None)], "instrument string, perp string, valid_from date, valid_to date")
    cells = joins.perp_symbols(spark.createDataFrame([("NEWUSDT", dt.date(2024, 9, d)) for d in (10, 11, 12, 13)], "instrument string, date date"), mapping)
    got = [r["funding"] for r in ag.mapped_fields(cells, daily, ["funding"]).orderBy("date").collect()]
    assert got[0] == pytest.approx(0.003) and got[1:3] == [None, None] and got[3] == pytest.approx(0.012)


def test_metrics_by_header_name(spark, tmp_path):
    names = ["symbol", "create_time", *ar.METRIC_FIELDS.values()]
    body = "ABC,2024-01-01 00:05:00,1,2,3,4,5\nABC,2024-01-01 23:55:00,10,20,30,40,n/a\n"
    put(tmp_path / "m", "ABC-metrics-2024-01-01.zip", {"a.csv": ",".join(names) + "\n" + body})
    put(tmp_path / "m", "ODD-metrics-2024-01-01.zip", {"a.csv": ",".join(names) + "\n" + body.replace("n/a", "oops")})
    put(tmp_path / "m", "BAD-metrics-2024-01-01.zip", {"a.csv": "symbol,create_time\nBAD,2024-01-01 00:05:00\n"})
    found, bad = ar.read_metrics(ar.archive_files(spark, str(tmp_path)))
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert reasons["BAD-metrics-2024-01-01.zip"].startswith("missing columns") and reasons["ODD-metrics-2024-01-01.zip"] == "not a number: oops" and len(reasons) == 2
    m = ag.last_of_day(found, list(ar.METRIC_FIELDS), "perp_symbol")
    assert rows(m, "date") == [("ABC", dt.date(2024, 1, 1), 10.0, 20.0, 30.0, 40.0, None)]


def test_registers_panels_and_lists(spark):
    path = fresh_path(spark, "none")
    assert tb.read_trials(spark, path).count() == 0
    p = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 2.0), ("B", dt.date(2021, 5, 1), 3.0, 4.0)], "instrument string, date date, close double, volume double")
    where = fresh_path(spark, "panel")
    tb.write_panel(p, where)
    tb.write_panel(p.filter("instrument = 'B'").withColumn("close", F.lit(9.0)), where)
    assert rows(tb.read_panel(spark, where, fields=["close"]), "instrument") == [("A", dt.date(2020, 1, 1), 1.0), ("B", dt.date(2021, 5, 1), 9.0)]
    plan = tb.read_panel(spark, where, ["A"], ["close"], "2020-01-01", "2020-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "volume" not in plan
    lines = spark.createDataFrame([(1, " btc "), (2, ""), (3, "eth"), (4, "BTC")], "line_no int, value string")
    assert rows(tb.symbols_from_text(lines), "first_line") == [("BTC", 1), ("ETH", 3)]
    with pytest.raises(ValueError):
        tb.require_symbols(lines.filter("line_no = 2").transform(tb.symbols_from_text))
    listing = spark.createDataFrame([("BTC", "B", "U", None)], "symbol string, base string, quote string, status string")
    with pytest.raises(ValueError, match="ETH"):
        tb.require_known(tb.validate_symbols(tb.symbols_from_text(lines), listing))


def test_streams_equal_batch(spark):
    batch = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["event_type"], r["d"]): r["t"] for r in batch.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.sum("value").alias("t")).collect()}
    out = jobs.run_available(jobs.daily_sums(jobs.event_stream(spark, SMALL), "event_type", "value"), "test", ("window", "event_type")).collect()
    assert len(out) == len(want) and all(abs(r["total"] - want[(r["event_type"], r["window"]["start"].date())]) < 1e-6 for r in out)
    closed = jobs.run_available(jobs.daily_sums(jobs.event_stream(spark, SMALL), "event_type", "value"), "test", mode="append")
    assert 0 < closed.count() < len(want)


def test_damaged_archives_give_no_rows(spark, tmp_path, monkeypatch):
    """Whatever is wrong with an archive, not one of its lines is accepted and the file is named."""
    from panelspark.queries.fixtures import DAMAGES, packed

    monkeypatch.setattr(ar, "BLOCK_BYTES", 512)  # lines cross blocks
    day_lines = "\n".join(BAR.format(t=1735603200000 + n * 60_000, v=n) for n in range(400)).encode()
    for n, damage in enumerate([None, *DAMAGES]):
        (tmp_path / f"S{n}-1h-2024-12-31.zip").write_bytes(packed("a.csv", day_lines, damage))
    (tmp_path / "S6-1h-2024-12-31.zip").write_bytes(packed("a.csv", day_lines.replace(b"0.5", b"half", 1)))
    (tmp_path / "S7-1h-2024-12-31.zip").write_bytes(packed("a.csv", b"\xff" + day_lines))
    whole = packed("a.csv", day_lines)
    for n in range(8, 48):  # a byte of the packed stream changed
        damaged = bytearray(whole)
        damaged[60 + (n - 8) * (len(whole) - 200) // 40] ^= 0x5A
        (tmp_path / f"S{n}-1h-2024-12-31.zip").write_bytes(bytes(damaged))
    bars, bad = ar.read_hourly_bars(ar.archive_files(spark, str(tmp_path)))
    assert rows(bars.groupBy("symbol").count(), "symbol") == [("S0", 400)]
    assert bad.count() == 46 and bad.filter("reason is null or reason = ''").count() == 0


def test_packing_holds_one_archive_and_grows_with_its_lines():
    """S7: damaged members of long texts stay about as long as the text, and archives leave the task as their lines arrive."""
    import io

    import pyarrow as pa

    from panelspark.queries.fixtures import DAMAGES, packed, zip_lines

    long = b"1,2.5,3\n" * 400_000
    for damage in DAMAGES:
        assert len(packed("a.csv", long, damage)) < 1.1 * len(long)
    read = []

    def batches():
        for n in range(40):
            read.append(n)
            line = "".join(chr(33 + (n * 7919 + i * i * 31) % 90) for i in range(300_000))
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"x/A-1d-{n}.zip"] * 2), "line": pa.array([line, str(n)]), "damage": pa.array(["checksum"] * 2, pa.string())})

    out, seen = [], []
    for batch in zip_lines(batches(), "h"):
        seen.append(len(read))
        out += batch.to_pylist()
    assert len(seen) > 3 and seen[0] < 15 and [r["path"] for r in out] == [f"x/A-1d-{n}.zip" for n in range(40)]
    whole = list(zip_lines(iter([pa.RecordBatch.from_pydict({"path": ["A", "A", "B"], "line": ["1", "2", "ß"], "damage": pa.array([None] * 3, pa.string())})]), "h"))
    texts = [zipfile.ZipFile(io.BytesIO(c)).read(zipfile.ZipFile(io.BytesIO(c)).namelist()[0]).decode() for c in whole[0].column(1).to_pylist()]
    assert texts == ["h\n1\n2", "h\nß"]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after three slices and started again on the others: the same table as in one go, late and replayed rows included."""
    from panelspark.queries import source_queries as sq

    job = lambda stream: jobs.tick_bars(stream.withColumn("quantity", F.lit(1.0)), "event_type", "value", "quantity", "event_id")
    keys, folder, state = ("window", "event_type"), str(tmp_path / "in"), str(tmp_path / "out")
    # a run that has drained its source moves the watermark on by an empty micro-batch; a run that was cut off does not
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    jobs.run_available(job(sq.event_slices(spark, SMALL, folder, range(3), True)), "half", keys, root=state)
    twice = jobs.run_available(job(sq.event_slices(spark, SMALL, folder, range(3, sq.SLICES), True)), "half", keys, root=state)
    once = jobs.run_available(job(sq.event_slices(spark, SMALL, replays=True)), "whole", keys)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect())) and once.count() > 100
    every = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert 0 < once.agg(F.sum("trades")).first()[0] < every  # rows beyond the watermark are dropped, replayed ones count once


def test_shipped_parameter_tables(spark):
    days = [dt.date(2024, 9, d) for d in (10, 11, 12, 13)]
    cells = spark.createDataFrame([(s, d) for s in ("POLUSDT", "PEPEUSDT", "BTCUSDT") for d in days], "instrument string, date date")
    got = {(r.instrument, r.date): r.perp_symbol for r in joins.perp_symbols(cells, parameters.perp_mapping(spark)).collect()}
    assert [got["POLUSDT", d] for d in days] == ["MATICUSDT", None, None, "POLUSDT"]
    assert {got["PEPEUSDT", d] for d in days} == {"1000PEPEUSDT"} and {got["BTCUSDT", d] for d in days} == {"BTCUSDT"}
    bars = spark.createDataFrame([("BTCUSDT", 1.0, 0.5, 0.2), ("PEPEUSDT", 3.0, 0.5, 0.4), ("XUSDT", 5.0, 0.5, 0.6)], "symbol string, impact double, fill_rate double, spread double")
    tiers = {r.tier: r.impact for r in ag.calibrate_costs(bars, parameters.cost_tiers(spark)).collect()}
    assert tiers == {"deep": 1.0, "thin": 3.0, "mid": 5.0, "overall": 3.0}  # an unlisted symbol is mid
