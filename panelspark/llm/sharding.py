"""Sharding by balanced label propagation.

Documents start in shards dealt by hash. In each round every linked document looks at the shards of its group and wants to move to
the one that holds most of it; shards admit as many linked documents as they have room for, and full shards exchange equal numbers.
Rounds end when nothing moves.
Last, documents without links fill the shards up, so that the numbers of rows differ by one at most.
"""
from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import settle

SHARDS = 16
IDLE = 4  # rounds without a move, each with ties drawn anew, after which no gain is left
CHUNK_ROWS = 512


def pieces_for(rows: int) -> int:
    """Chunks that an order over ``rows`` rows is cut into."""
    return max(1, math.ceil(min(rows / CHUNK_ROWS, 16 * math.sqrt(rows))))


def fraction(*of: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def ranked(df: DataFrame, key: str, first: Column, draw: Column, pieces: int, out: str) -> DataFrame:
    """Gapless rank from 0 within ``key``, rows with ``first`` ahead, then by ``draw`` (a number in [0, 1)).

    A key's rows are cut into chunks along the order; each chunk is one small window and the chunks' sizes carry over, so a
    key with any number of rows is many tasks. Equal draws are ordered by doc_id and size.
    """
    cut = df.withColumn("_draw", draw).withColumn("_chunk", (F.when(first, 0).otherwise(pieces) + F.floor(F.col("_draw") * F.lit(pieces))).cast("int"))
    past = Window.partitionBy("_key").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_key", "_c", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_past"))
    inside = Window.partitionBy(key, "_chunk").orderBy("_draw", "doc_id", "size")
    placed = cut.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    return placed.withColumn(out, (F.col("_past") + F.col("_in")).cast("long")).drop("_draw", "_chunk", "_key", "_c", "_past", "_in")


def exchange(linked: DataFrame, capacity: list[int], n: int) -> tuple[DataFrame | None, bool]:
    """One round of swaps over (group, ..., shard), None if there are none, and whether any member wants to move; loads stay as they are.

    Members want to the shard with most of their group that the group does not fill yet; equal counts are settled by a hash that
    differs by round ``n``. Of an ordered pair of shards as many go as want to come back, chosen by rank; one count per pair is collected.
    """
    shards = len(capacity)
    parts = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("held"))
    worth = F.struct("held", F.xxhash64("group", "shard", F.lit(n)).alias("tie"), "shard")
    unfilled = F.col("held") < F.get(F.array(*[F.lit(int(c)).cast("long") for c in capacity]), F.col("shard"))
    best = parts.groupBy("group").agg(F.max(F.when(unfilled, worth)).alias("best")).filter("best is not null")
    own = parts.select(F.col("group").alias("_g"), F.col("shard").alias("_s"), worth.alias("own"))
    pair = (F.col("_s") * shards + F.col("best.shard")).cast("int").alias("pair")
    moves = settle(own.join(best, F.col("_g") == F.col("group")).filter("best > own").select("_g", "_s", F.col("own.held").alias("held"), pair), f"shard-wish-{n}")
    flow = {r["pair"]: r["n"] for r in moves.groupBy("pair").agg(F.sum("held").alias("n")).collect()}  # one row a pair of shards
    swaps = [min(flow.get(a * shards + b, 0), flow.get(b * shards + a, 0)) for a in range(shards) for b in range(shards)]
    if not any(swaps):
        return None, bool(flow)
    quota = F.get(F.array(*[F.lit(int(v)).cast("long") for v in swaps]), F.col("pair"))
    wishes = linked.join(moves.filter(quota > 0).drop("held"), (F.col("group") == F.col("_g")) & (F.col("shard") == F.col("_s")), "left").drop("_g", "_s")
    wishes = settle(wishes, f"shard-wishes-{n}")
    draw = fraction("doc_id", "size", "group", F.lit(n))
    placed = ranked(wishes.filter("pair is not null"), "pair", F.lit(False), draw, pieces_for(max(flow.values())), "rank")
    placed = placed.withColumn("shard", F.when(F.col("rank") < quota, F.col("pair") % shards).otherwise(F.col("shard")).cast("int"))
    return settle(wishes.filter("pair is null").select(linked.columns).unionByName(placed.select(linked.columns)), f"shard-swap-{n}"), True


def propagate(linked: DataFrame, capacity: list[int], *, rounds: int | None = None) -> DataFrame:
    """Rounds over (group, ..., shard): members move towards the shard that holds most of their group.

    Each round first fills free room, then lets members of full shards change places (``exchange``). In the first part equal counts
    are settled by a hash of group and shard, so all members of a group want the same; of those who want into a shard, a hash
    admits the share that fits, and who is left looks among the shards with room in the next round. Every move leads to a part
    of the group that is as full or fuller, so the sum of squared parts only grows and rounds end: after ``IDLE`` rounds without a
    move, at once if nothing wants to move, or after ``rounds``. Each round is written to the shared folder; only counts per shard or pair of shards come back.
    """
    shards = len(capacity)
    loads = lambda df: {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  one row a shard
    table_of = lambda values: F.array(*[F.lit(float(v)) for v in values])

    def fill(linked: DataFrame, n: int) -> tuple[DataFrame | None, bool]:
        """The linked rows after moves into free room, None without any, and whether all who asked had room."""
        load = loads(linked)
        room = [max(0, capacity[s] - load.get(s, 0)) for s in range(shards)]
        if not any(r > 0 for r in room):
            return None, False
        parts = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("held"))
        open_ = F.get(table_of([r > 0 for r in room]), F.col("shard")) > 0
        # members leave a full part for an open one of equal size, for the others cannot come to them
        worth = F.struct("held", F.when(open_, F.xxhash64("group", "shard")).otherwise(F.lit(-(1 << 63))).alias("tie"), "shard")
        # the group's best shard may be full; its own members stay, the others choose among those with room
        best = parts.groupBy("group").agg(F.max(F.when(open_, worth)).alias("best")).filter("best is not null")
        own = parts.select(F.col("group").alias("_g"), F.col("shard").alias("_s"), worth.alias("own"))
        moves = own.join(best, F.col("_g") == F.col("group")).filter("best > own").select("_g", "_s", F.col("best.shard").alias("to"), F.col("own.held").alias("held"))
        asked = {r["to"]: r["n"] for r in moves.groupBy("to").agg(F.sum("held").alias("n")).collect()}
        if not asked:
            return None, False
        # a hash admits about as many as it should: two deviations are kept free, so that hardly a shard takes too many
        fits = [r - 2 * math.sqrt(r) if r >= 16 else r for r in room]
        share = [0.0 if not asked.get(s) else 1.0 if asked[s] <= room[s] else max(0.0, fits[s] / asked[s]) for s in range(shards)]
        admitted = F.col("to").isNotNull() & (fraction("doc_id", "size", "group", F.lit(n)) < F.get(table_of(share), F.col("to")))
        linked = linked.join(moves.select("_g", "_s", "to"), (F.col("group") == F.col("_g")) & (F.col("shard") == F.col("_s")), "left")
        linked = linked.withColumn("shard", F.when(admitted, F.col("to")).otherwise(F.col("shard"))).drop("_g", "_s", "to")
        return settle(linked, f"shard-round-{n}"), min(share[s] for s in asked) == 1.0

    idle = 0
    for n in itertools.count() if rounds is None else range(rounds):
        filled, fits_all = fill(linked, n)
        linked = linked if filled is None else filled
        if fits_all:
            continue
        swapped, wanted = exchange(linked, capacity, n)
        linked = linked if swapped is None else swapped
        if not wanted:
            break
        idle = idle + 1 if filled is None and swapped is None else 0
        if idle == IDLE:
            break
    return linked


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row, under the law ``rows``.

    ``size`` is the text's UTF-8 bytes (NULL: none) plus 1. Documents with equal texts are linked (NULL and empty texts are equal).
    Shards hold floor or ceiling of rows / shards. ``slot`` counts a shard's rows from 0 without gaps, linked ones first.
    A group larger than a shard is spread over as few shards as it fills; repeated ids are rows of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    data = text.cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("group"), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
    )
    rows = settle(rows, "shard-rows")
    total = rows.count()
    pieces = pieces_for(total)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    # written, so that the join's two sides are plain shuffles and a group of very many rows can be split
    groups = settle(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.lit(True).alias("linked")), "shard-groups")
    marked = settle(rows.join(groups, "group", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-linked")
    moved = propagate(marked.filter("linked"), quota, rounds=rounds)
    every = settle(marked.filter(~F.col("linked")).unionByName(moved), "shard-moved")

    # rows beyond a shard's quota, those without links first, go to the shards that lack some, in equal order
    draw = fraction("doc_id", "group", F.lit("place"))
    load = {r["shard"]: r["n"] for r in every.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    numbers = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    before = lambda values: [sum(values[:s]) for s in range(shards)]
    extra = [max(0, load.get(s, 0) - quota[s]) for s in range(shards)]
    lack = [max(0, quota[s] - load.get(s, 0)) for s in range(shards)]
    placed = ranked(every, "shard", F.col("linked"), draw, pieces, "rank")
    over = F.col("rank") - F.get(numbers(quota), F.col("shard"))
    number = F.get(numbers(before(extra)), F.col("shard")) + over
    # slots behind those of the rows a shard has kept
    starts, held = before(lack), [min(load.get(s, 0), quota[s]) for s in range(shards)]
    to = F.array_max(F.array(*[F.when((number >= starts[s]) & (F.lit(lack[s]) > 0), F.lit(s)).otherwise(F.lit(0 if s == 0 else -1)) for s in range(shards)]))
    goes = over >= 0
    final = placed.withColumn("_to", F.when(goes, to).otherwise(F.col("shard")).cast("int"))
    slot = F.when(goes, F.get(numbers(held), F.col("_to")) + number - F.get(numbers(starts), F.col("_to"))).otherwise(F.col("rank"))
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_to").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
