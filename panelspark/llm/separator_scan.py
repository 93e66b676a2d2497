"""Token counts: documents in flat token files are found by a separator scan.

A token file is a bare run of fixed-width ids; documents end with an end-of-document id and nothing records where. The files
are cut into blocks of equal size, each block is searched for the id with one vectorised comparison, and lengths of documents
that cross blocks come from a prefix scan over the block summaries (last separator so far, separators so far).
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import attempt_name, new_folder, open_store, small_batches

BLOCK_TOKENS = 4 << 20
BLOCKS_A_GROUP = 1024  # blocks of a file that one window of the scan orders
FILE_BYTES = 256 << 20
EOD = 50256


def hashed_words(text: bytes) -> np.ndarray:
    """Ids of a hashing vocabulary: CRC-32 of each word modulo ``EOD``, so the separator stays free."""
    parts = text.split()
    return np.fromiter(map(zlib.crc32, parts), np.uint32, len(parts)) % EOD


def write_token_files(
    docs: DataFrame, *, encode: Callable[[bytes], np.ndarray] = hashed_words, eod: int = EOD, dtype: str = "<u2", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the ids of (doc_id, text) to flat files; returns (file, ordinal, doc_id): which document is which in a file.

    NULL and empty texts are documents without tokens. Each task writes files of its own name to the shared store; a file
    counts only if the task that wrote it finished, so a lost executor leaves nothing that is read.
    """
    folder = new_folder(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        end = np.array([eod], dtype).tobytes()
        out, name, size, ordinal = None, "", 0, 0
        for batch in small_batches(batches, 1):
            files, ordinals = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size, ordinal = attempt_name(folder, "part", ".bin"), 0, 0
                    out = store.open_output_stream(open_store(name)[1])
                ids = encode(text or b"")
                if len(ids) and (ids == eod).any():
                    raise ValueError("a document holds the end-of-document id")
                out.write(ids.astype(dtype).tobytes() + end)
                size += (len(ids) + 1) * len(end)
                files.append(name)
                ordinals.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(named.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def scan_token_files(files: DataFrame, *, eod: int = EOD, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the files that column ``file`` names.

    ``start`` is the document's first token in the file. Tokens after the last separator are a document with
    ``terminated`` false; an empty file has none. A file that is no whole number of ids is refused.
    """
    spark = files.sparkSession
    width = np.dtype(dtype).itemsize

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                size = store.get_file_info(path).size
                if size is None or size % width:
                    raise ValueError(f"{name}: no whole number of {width}-byte ids ({size} bytes)")
                at = np.arange(0, size // width, block_tokens)
                for some in np.array_split(at, max(1, len(at) // 10_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some), pa.string()), pa.array(some // block_tokens), pa.array(some), pa.array(np.minimum(block_tokens, size // width - some))],
                        ["file", "block", "start", "tokens"],
                    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as handle:
                    handle.seek(row["start"] * width)
                    ids = np.frombuffer(handle.read(row["tokens"] * width), dtype)
                ends = np.flatnonzero(ids == eod) + row["start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([row["tokens"]]), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"]
                )

    blocks = settle(files.select("file").distinct().mapInArrow(plan, "file string, block long, start long, tokens long"), "token-blocks")
    # block rows are tiny but each stands for megabytes: a stated count keeps them from being merged into one task
    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // 16))
    found = settle(blocks.repartition(tasks, "file", "block").mapInArrow(scan, "file string, block long, tokens long, ends array<long>"), "token-ends")

    group = F.floor(F.col("block") / F.lit(BLOCKS_A_GROUP)).alias("group")
    brief = found.select("file", "block", group, F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inner = before("file", "group").orderBy("block")
    brief = brief.withColumns({"_n": F.sum("n").over(inner), "_last": F.max("last").over(inner)})
    outer = before("file").orderBy("group")
    groups = brief.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "group", F.sum("n").over(outer).alias("g_n"), F.max("last").over(outer).alias("g_last"))
    zero = F.lit(0).cast("long")
    carried = brief.join(groups, ["file", "group"]).select(
        "file", "block",
        (F.coalesce("_n", zero) + F.coalesce("g_n", zero)).alias("base"),
        (F.coalesce("_last", "g_last", F.lit(-1).cast("long")) + 1).alias("opened"),
    )
    ends = found.select("file", "block", "ends").filter(F.size("ends") > 0).join(carried, ["file", "block"])
    ends = ends.select("file", "base", "opened", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    whole = ends.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = found.groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("ordinal"),
        (F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))), F.lit(-1).cast("long")) + 1).alias("start"),
        F.sum("tokens").alias("_total"),
    )
    tails = tails.select("file", "ordinal", "start", (F.col("_total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated")).filter("n_tokens > 0")
    return whole.unionByName(tails)


def token_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens) by way of flat token files: written, scanned, and matched by place in the file."""
    order = write_token_files(docs)
    return order.join(scan_token_files(order, **options), ["file", "ordinal"]).select("doc_id", "n_tokens")
