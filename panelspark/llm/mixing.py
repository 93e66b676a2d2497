"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, read twice over at most. A queued copy has the virtual finish time
(words of its source up to and with it) / (target of its source). All copies are put in order of finish time and taken until the
total budget is spent, so at any point of the mix, and at its end, every source has had its share.
"""
from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import packed, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
CHUNK_ROWS = 512
SEED = "mix"


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to targets: ``share`` of all words by repeating ``weights``, none above ``epochs`` x its size.

    Sources are ordered by code point, NULL last. Re-sharing an excess by weight until none is above ends at
    min(limit, level x weight) with one level for all; it is read off the sources in the order limit / weight. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"))
    rows = rows.withColumn("top", F.col("source_size") * F.lit(float(epochs)))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "_budget": F.sum("source_size").over(every) * F.lit(float(share)),
        "_below": F.coalesce(F.sum("top").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the level if this source and all later ones stay below their limits; the first such source, which has the highest, fixes it
    level = (F.col("_budget") - F.col("_below")) / F.col("_left")
    rows = rows.withColumn("_level", F.max(F.when(level <= F.col("top") / F.col("weight"), level)).over(every))
    target = F.when(F.col("_level").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("_level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def share_of(draw: Column) -> Column:
    """The hexadecimal draw as a number from 0 to 1."""
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _running(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` by (chunk, order) in each group; a chunk is one task's window, chunk sums carry over."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    past = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_past", F.coalesce(F.sum("_sum").over(past), F.lit(0).cast("long"))).drop("_sum")
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in [*keys, chunk]], "_past")
    joined = df.join(sums, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, chunk]])).select(*df.columns, "_past")
    return joined.withColumn(out, F.sum(value).over(inside) + F.col("_past")).drop("_past")


def schedule(docs: DataFrame, *, size: Column | None = None, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and epoch in the mix's order: (doc_id, source, size, source_size, target, place, epoch, finish, taken).

    ``size`` defaults to the number of words. ``place`` identifies the row within its source, so repeated ids stay apart.
    ``taken`` is what the mix takes of the copy: its size, or the rest of the budget at the cut, or 0 beyond it. Documents
    without words take nothing. The shuffle is an MD5 of seed and doc_id, so reruns agree. ``keep`` names further columns to carry.
    """
    named = docs.select("doc_id", F.col("source").cast("string").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"), *keep)
    named = settle(named.withColumn("draw", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))), "mix-queue")
    sizes = named.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights=weights, share=share, epochs=epochs)
    rows = named.count()
    # slices of a few rows; on very many rows they grow with their number, so that neither a slice nor the list of slices is large
    pieces = max(1, math.ceil(min(rows / CHUNK_ROWS, 16 * math.sqrt(rows))))
    # equal slices of the draw: a source is shuffled, so its slices are even however large it is
    slice_of = F.floor(share_of(F.col("draw")) * F.lit(pieces)).cast("long")
    queued = named.withColumn("chunk", slice_of).withColumn("one", F.lit(1).cast("long"))
    queued = _running(queued, ["source"], "chunk", ["draw", F.col("doc_id"), F.col("size")], "size", "upto")
    queued = _running(queued, ["source"], "chunk", ["draw", F.col("doc_id"), F.col("size"), F.col("upto")], "one", "place")
    queued = queued.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s", "chunk", "one", "weight")
    queued = settle(queued, "mix-places")
    copies = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    # a source without any words has target 0; its documents take nothing wherever they stand
    finish = F.when(F.col("target") > 0, (F.col("source_size") * F.col("epoch") + F.col("upto")) / F.col("target")).otherwise(share_of(F.col("draw")))
    copies = copies.withColumn("finish", finish)
    # all sources are served at a steady rate, so equal slices of virtual time hold about equal numbers of words
    copies = copies.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(float(epochs) + 1)) * F.lit(pieces)).cast("long")).withColumn("all", F.lit(0))
    budget = sizes.agg(F.floor(F.sum("source_size") * F.lit(float(share))).cast("long").alias("budget")).first()[0] or 0
    ordered = _running(copies, ["all"], "slot", ["finish", F.col("source").asc_nulls_last(), "epoch", "place"], "size", "served")
    left = F.lit(budget) - (F.col("served") - F.col("size"))
    return ordered.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))).drop("slot", "all", "upto")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document; ``taken`` counts repeats."""
    copies = schedule(docs, **options)
    same = ["source", "place", "doc_id", "size", "source_size", "target"]
    return copies.groupBy(*same).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, once for each time that it takes them.

    The document at the cut is whole if the budget covers half of it or more. Documents without words are not taken. Wholly
    repeated rows keep their number of turns each.
    """
    named = packed(docs).withColumn("source", F.col("whole").getField("source").cast("string"))
    keyed = named.withColumn("key", F.xxhash64("doc_id", "text", "source"))
    turn = ((F.col("size") > 0) & (F.col("taken") * 2 >= F.col("size"))).cast("int")
    turns = schedule(keyed, keep=("key",), **options).groupBy("key", "source", "place").agg(F.sum(turn).alias("turns"))
    turns = turns.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list("turns"), asc=False).alias("turns"))  # one number a repeated row
    number = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    out = keyed.join(turns, F.col("key") == F.col("_key")).withColumn("turn", F.get("turns", number - 1)).filter("turn > 0")
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turn")))).select("whole.*")
