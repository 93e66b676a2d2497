"""Archives packed from tables, sound and damaged, for the queries and tests of the archive readers."""
from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAMAGES = ("checksum", "cut", "two members", "empty member")
SWOLLEN_BYTES = 1 << 20  # up to here a damaged member is made long by repeating its text
BATCH_BYTES = 4 << 20
BROKEN_SQL = "(({day} - DATE '1995-01-01') % 37 + 37) % 37 BETWEEN 1 AND 4"


def damage_on(day: Column) -> Column:
    """One damage each on four of every 37 days."""
    return F.get(F.array(*[F.lit(d) for d in DAMAGES]), F.pmod(F.datediff(day, F.lit("1995-01-01").cast("date")), F.lit(37)) - 1)


def cut_deflate(name: str, data: bytes) -> bytes:
    """A zip whose directory is whole but whose deflate stream ends half way."""
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    stream = packed.compress(data) + packed.flush()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr(name, stream[: len(stream) // 2])
    out = bytearray(buffer.getvalue())
    central = out.index(b"PK\x01\x02")
    for method, crc, size in ((8, 14, 22), (central + 10, central + 16, central + 24)):
        struct.pack_into("<H", out, method, 8)
        struct.pack_into("<I", out, crc, zlib.crc32(data))
        struct.pack_into("<I", out, size, len(data))
    return bytes(out)


def swollen(data: bytes, times: int) -> bytes:
    """The whole text up to ``times`` times, but once only where more would take it beyond ``SWOLLEN_BYTES``."""
    return data * max(1, min(times, SWOLLEN_BYTES // max(1, len(data))))


def packed(name: str, data: bytes, damage: str | None = None) -> bytes:
    if damage == "cut":
        return cut_deflate(name, swollen(data, 50))
    buffer = io.BytesIO()
    # stored, so that a flipped byte is a text that only the checksum tells from the true one
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED if damage == "checksum" else zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, b"" if damage == "empty member" else swollen(data + b"\n", 200) if damage == "checksum" else data)
        if damage == "two members":
            z.writestr("more.csv", data)
    out = bytearray(buffer.getvalue())
    if damage == "checksum":
        at = out.rindex(b"\n", 0, out.index(b"PK\x01\x02")) - 2
        out[at] = ord("7") if out[at] != ord("7") else ord("8")
    return bytes(out)


def zip_lines(batches: Iterator[pa.RecordBatch], header: str | None) -> Iterator[pa.RecordBatch]:
    """(path, content) of (path, line, damage) rows that are sorted by path; holds one archive's text and ``BATCH_BYTES`` of archives."""
    first = b"" if header is None else header.encode() + b"\n"
    now, broken, text, paths, contents = None, None, [], [], []

    def close() -> None:
        if now is not None:
            paths.append(now)
            contents.append(packed(now.rsplit("/", 1)[-1].replace(".zip", ".csv"), first + b"\n".join(text), broken))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for rows in batches:
        for path, line, damage in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), rows.column(2).to_pylist()):
            if path != now:
                close()
                now, broken, text = path, damage, []
                if sum(map(len, contents)) > BATCH_BYTES or len(paths) > 1000:
                    yield batch()
                    paths, contents = [], []
            text.append(line)
    close()
    if paths:
        yield batch()


def pack_archives(lines: DataFrame, header: str | None = None, damage: Column | None = None) -> DataFrame:
    """(path, line_no, line) rows to zipped archives (path, length, content); ``damage`` names what is wrong with a path's archive.

    Lines are sorted by Spark and zipped as they come, so a task never holds more than one archive's lines.
    """
    named = lines.select("path", "line_no", "line", (F.lit(None).cast("string") if damage is None else damage).alias("_damage"))
    ordered = named.repartition("path").sortWithinPartitions("path", "line_no", "line").select("path", "line", "_damage")
    zipped = ordered.mapInArrow(lambda batches: zip_lines(batches, header), "path string, content binary")
    return zipped.select("path", F.length("content").cast("long").alias("length"), "content")
