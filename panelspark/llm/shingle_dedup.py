"""Near-duplicates by exact similarity of word shingles.

Two texts are linked where their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Candidates come from SimHash, by
operator 6's index of fingerprints within three bits, and each is compared with the smallest of its SimHash class on the whole sets. At 0.8
two 64-bit fingerprints differ in 10 bits on average, so further candidates are needed for the rest: 28 bands of 6 independently seeded
minima each (MinHash), compared in the same way. A pair at similarity j shares a band with probability 1 - (1 - j^6)^28, which is 0.9998
at 0.8 and more above.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import block_roots, connected_components, pair_blocks, small_batches, sorted_groups
from panelspark.llm.simhash import SEED, fingerprint_of, keep_best, links, row_hash, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
BAND_ROWS = 6
BLOCK_ROWS = 128
STEP = 2048
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_MIX[1] |= np.uint64(1)


def shingle_set(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles; a text of fewer words is one shingle, a word-free one has none."""
    return np.unique(shingle_hashes(text, shingle)) if text else np.zeros(0, np.uint64)


def band_keys(values: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; equal in both of two sets with probability (similarity) ^ BAND_ROWS. The empty set has none."""
    from xxhash import xxh64_intdigest

    if not len(values):
        return []
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(values), STEP):
        np.minimum(least, ((values[None, start : start + STEP] ^ _MIX[0]) * _MIX[1]).min(axis=1), out=least)
    keys = [xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, fp, keys): hash of id and text, hash of the shingle set (equal sets are one node), the set's SimHash and its bands."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            nodes, prints, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                values = shingle_set(text)
                nodes.append(xxh64_intdigest(values.tobytes(), SEED))
                prints.append(fingerprint_of(values))
                keys.append(band_keys(values))
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, fp, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "node", "fp", "keys"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return named.mapInArrow(run, "doc_id long, row long, node long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the documents whose ``row`` is in ``wanted`` (node, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            sets = [shingle_set(text).view(np.int64) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    texts = docs.select(row_hash().alias("row"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, "row").dropDuplicates(["row"]).select("node", "text").mapInArrow(run, "node long, set array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common / (F.size("x") + F.size("y") - common) >= SIMILARITY).select("a", "b")


def block_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) among the members of each bucket (key, node): every pair is compared in a block, which returns stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "c1", "c2"]):
            node, lists = group["node"].combine_chunks().to_numpy(), group["set"].combine_chunks()
            size = lists.value_lengths().to_numpy()
            distinct, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            of, start = np.repeat(np.arange(len(size)), size), np.concatenate(([0], np.cumsum(size)))
            near = np.zeros((len(size), len(size)), bool)
            for i in range(len(size)):
                mine = np.zeros(len(distinct), bool)
                mine[code[start[i] : start[i + 1]]] = True
                common = np.bincount(of[mine[code]], minlength=len(size))
                near[i] = common / (size[i] + size - common) >= SIMILARITY
            root = block_roots(near)
            far = np.flatnonzero(root != np.arange(len(size)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    # a row stands in as many blocks as its bucket has chunks, which Spark's size of the blocks leaves out: they are never broadcast
    blocks = pair_blocks(buckets, ["key"], "node", BLOCK_ROWS).select("node", "key", "c1", "c2").hint("merge").join(sets, "node")
    return blocks.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2").select("key", "c1", "c2", "node", "set").mapInArrow(run, "a long, b long")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, row_a, row_b): each node (node, fp, row) of a SimHash class beside the class's smallest; as many pairs as members."""
    prints = settle(nodes.select("node", "fp", "row"), "shingle-prints")
    roots = connected_components(links(prints.select("fp").distinct()), "simhash-links").withColumnRenamed("node", "_fp")
    named = prints.join(roots, F.col("fp") == F.col("_fp"), "left").select(F.coalesce("root", "fp").alias("root"), "node", "row")
    centres = named.groupBy("root").agg(F.min(F.struct("node", "row")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "c")
    return named.join(centres, "root").filter("node <> c.node").select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("row").alias("row_a"), F.col("c.row").alias("row_b"))


def classes(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are linked to another one.

    First every member of a SimHash class or bucket of bands is compared with its smallest node, as many pairs as members. That settles buckets of
    two and groups of near copies; only buckets of three and more members in different components are then compared pair by pair.
    """
    nodes = marked.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp"), F.min("row").alias("row"))
    near = settle(simhash_pairs(nodes), "shingle-simhash")
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("row_a").alias("row")), F.struct(F.col("b").alias("node"), F.col("row_b").alias("row")))).alias("e")).select("e.*")
    every = settle(nodes.select(F.explode("keys").alias("key"), "node", "row"), "shingle-keys")
    centres = settle(every.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shingle-centres")
    buckets = settle(every.join(centres, "key"), "shingle-buckets")
    sets = settle(sets_of(docs, buckets.select("node", "row").unionByName(ends).distinct()), "shingle-sets")
    pairs = settle(buckets.filter("node <> b").select(F.col("node").alias("a"), "b").unionByName(near.select("a", "b")).distinct(), "shingle-pairs")
    stars = settle(similar(pairs, sets), "shingle-stars")
    first = connected_components(stars, "shingle-links")
    named = buckets.filter("n > 2").join(first.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    named = settle(named, "shingle-named")
    mixed = settle(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key"), "shingle-mixed")
    rest = settle(block_links(named.join(mixed, "key").select("key", "node"), sets), "shingle-rest")
    return connected_components(stars.unionByName(rest), "shingle-links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one of smallest doc_id (NULL last), of a repeated id that with the
    smallest row hash; of wholly repeated rows one stays. Word-free and NULL texts are one component."""
    marked = settle(marks(docs), "shingle")
    roots = classes(docs, marked).withColumnRenamed("node", "_node")
    named = marked.select("doc_id", "row", "node").join(roots, F.col("node") == F.col("_node"), "left")
    return keep_best(docs, named.select("doc_id", "row", F.coalesce("root", "node").alias("root")))
