"""Small helpers shared by the operators: words, tables, files in the shared folder, ranks, components."""
from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.layout import fresh_path, settle

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in order; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """(whole, doc_id, text): each row as one struct beside what operators look at, so further columns of any name do no harm."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def open_store(uri: str):
    """(file system, path) of a folder or file in the shared store, local or remote; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared store for files that tasks write themselves."""
    uri = fresh_path(spark, label)
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    return uri


def attempt_name(folder: str, stem: str, suffix: str) -> str:
    """A name no other task attempt uses: only files that a finished attempt reported are ever read."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in column number ``text``, a row at least: what a worker holds as Python objects at a time."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.column(text).nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 2) -> Iterator[pa.Table]:
    """Groups of at least ``least`` rows from batches whose rows are sorted by integer ``keys``; holds one batch and one group."""
    held: pa.Table | None = None

    def cut(part: pa.Table) -> np.ndarray:
        change = np.zeros(max(part.num_rows - 1, 0), bool)
        for key in keys:
            column = part[key].combine_chunks().to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1, [part.num_rows]))

    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        if held is not None:
            part = pa.concat_tables([held, part]).combine_chunks()
        at = cut(part)
        full = np.flatnonzero(np.diff(at)[:-1] >= least)
        for g in full:
            yield part.slice(at[g], at[g + 1] - at[g])
        held = part.slice(at[-2])
    if held is not None and held.num_rows >= least:
        yield held


def pair_blocks(df: DataFrame, keys: Sequence[str], node: str, most: int) -> DataFrame:
    """Keep rows of groups with two or more members and give them a block, so that a block holds few rows of a group.

    A group of up to ``most`` rows is one block (0, 0). A larger one is cut into chunks by a hash of ``node``; each pair of
    chunks (c1 <= c2) is a block that holds both, so every pair of members meets in a block and no task holds a large group.
    Columns added: ``c1``, ``c2`` (the block) and ``c`` (the row's own chunk).

    ``df`` is often exploded. Spark gives an explode the size of its input, so neither side of the join may be broadcast by that size.
    """
    keys = list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = df.hint("merge").join(counted, keys).withColumn("_k", F.ceil(F.col("_n") / F.lit(most)).cast("long"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64(node), F.col("_k")))
    other = F.explode(F.when(F.col("_k") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    rows = rows.withColumn("_o", other)
    return rows.withColumns({"c1": F.least("c", "_o"), "c2": F.greatest("c", "_o")}).drop("_n", "_k", "_o")


def block_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row number reachable in a symmetric boolean matrix, for each row."""
    n = len(linked)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = start
    return root


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable.

    Columns ``a``, ``b`` (long). Alternating large-star and small-star rounds, each written to the shared folder; only a count
    and a checksum come back to the driver. Minima are combined before the shuffle; the joins are plain equi-joins, which
    adaptive execution splits at hubs.
    """
    spark = edges.sparkSession
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: then both sides of a join are plain shuffles, which can be split at hubs
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), label)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large, label)
        # a node's smaller neighbours and the node itself all point to the smallest
        floor = settle(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = settle(small.select("e.a", "e.b").filter("a <> b").distinct(), label)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
