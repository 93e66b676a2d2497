"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised, projected on Gaussian directions and cut into steps of one width; the steps of ``PROJECTIONS`` directions
make one bucket key, and ``TABLES`` independent keys make it likely that two near vectors share a bucket. Members of a bucket
are compared by cosine in double precision. Two unit vectors of cosine c are sqrt(2 - 2c) apart; with the parameters here a pair
at cosine 0.93 shares a bucket with probability 0.92, one at 0.95 with 0.98, one at 0.975 with over 0.999.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import block_roots, connected_components, pair_blocks, sorted_groups

COSINE = 0.93
WIDTH = 2.0
PROJECTIONS = 16
TABLES = 32
BLOCK_ROWS = 512
SEED = 20250


def bucket_keys(vectors: np.ndarray, *, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """(rows, tables) 64-bit keys of normalised rows; directions and offsets depend on seed and dimension only."""
    draw = np.random.default_rng([seed, vectors.shape[1]])
    directions = draw.standard_normal((vectors.shape[1], tables * projections))
    offsets = draw.uniform(0, width, tables * projections)
    odd = draw.integers(0, 1 << 63, (tables, projections), dtype=np.int64) * 2 + 1
    steps = np.floor((vectors @ directions + offsets) / width).astype(np.int64).reshape(len(vectors), tables, projections)
    mixed = (steps * odd).sum(axis=2)
    return mixed ^ (mixed >> 29)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def near_links(nodes: DataFrame, *, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """Partial sums over blocks: (node, partners, root). ``nodes``: node, label, vec (distinct valid vectors), copies.

    ``partners`` is how many vectors, copies counted, the node met in the block for the first time: a pair is counted in the
    first table that both share. ``root`` is the smallest node of its connected set in the block. A block returns one row per
    member with a link, never its pairs.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):  # vectors of different length never link
                some = batch.filter(pa.array(sizes == dim))
                found = bucket_keys(_unit(_matrix(some.column(2))), tables=tables)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([int(dim)] * some.num_rows, pa.int32()), some.column(2), some.column(3), pa.array(list(found), pa.list_(pa.int64()))],
                    ["node", "label", "dim", "vec", "copies", "keys"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["label", "dim", "t", "key", "c1", "c2"]):
            t, cross = group["t"][0].as_py(), group["c1"][0].as_py() != group["c2"][0].as_py()
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            rows = _unit(_matrix(group["vec"]))
            near = rows @ rows.T >= cosine
            np.fill_diagonal(near, False)
            if cross:
                chunk = group["c"].to_numpy()
                near &= chunk[:, None] != chunk[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            fresh = np.ones(len(i), bool)
            if t:
                mine = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
                for earlier in range(t):
                    fresh &= mine[i, earlier] != mine[j, earlier]
            partners = np.bincount(i[fresh], copies[j[fresh]], len(node)).astype(np.int64)
            root = node[block_roots(near)]
            met = near.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(partners[met]), pa.array(root[met])], ["node", "partners", "root"])

    keyed = settle(nodes.select("node", "label", "vec", "copies").mapInArrow(keys, "node long, label int, dim int, vec array<double>, copies long, keys array<long>"), "lsh-nodes")
    entries = keyed.select("node", "label", "dim", F.posexplode("keys").alias("t", "key"))
    blocks = pair_blocks(entries, ["label", "dim", "t", "key"], "node", BLOCK_ROWS)
    full = blocks.hint("merge").join(keyed.select("node", "vec", "copies", "keys"), "node")  # blocks are exploded, as in pair_blocks
    order = ["label", "dim", "t", "key", "c1", "c2"]
    # vectors of one node come in one order, so sums and roots do not depend on the order of arrival
    return full.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(compare, "node long, partners long, root long")


def embedding_components(vectors: DataFrame, *, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row of (vec_id, embedding, label).

    Equal vectors of a label are one node with a number of copies, so large groups of copies cost no pairs. Vectors that are NULL,
    empty, zero or hold NULL or non-finite components, and rows without a label, link with nothing: their component is their
    own id. Vectors of unlike length never link. ``vec_id`` identifies a vector; repeated rows count as further vectors.
    """
    vec = F.col("embedding").cast("array<double>")
    sound = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    # scaled by its largest component, so that no square overflows or vanishes; zero of either sign is one value
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), vec.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"))
    usable = rows.filter(F.col("sound") & F.col("label").isNotNull()).withColumn("vec", F.transform("vec", lambda x: x / largest + F.lit(0.0)))
    usable = usable.withColumn("node", F.xxhash64("label", "vec"))
    nodes = settle(usable.groupBy("node", "label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")), "lsh-distinct")
    met = settle(near_links(nodes, cosine=cosine, tables=tables), "lsh-met")
    roots = connected_components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "lsh-links")
    sums = met.groupBy("node").agg(F.sum("partners").alias("partners"))
    named = nodes.select("node", "copies", "first").join(sums, "node", "left").join(roots.withColumnRenamed("root", "_root"), "node", "left")
    named = named.select("node", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "first", F.coalesce("_root", "node").alias("root"))
    classes = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "n_links", "component_id")
    linked = usable.select("vec_id", "node").join(classes, "node").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("sound") | F.col("label").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
