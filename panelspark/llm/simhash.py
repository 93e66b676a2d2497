"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints are linked at three or fewer differing bits. A fingerprint is cut into two segments, so one of them differs by
at most one bit. Each segment is indexed by its 32 one-wildcard variants (the segment with one bit removed); an equality join on
(segment, wildcard, rest) brings every possible pair together and the full distance verifies it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import block_roots, connected_components, packed, pair_blocks, small_batches, sorted_groups

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENT_BITS = 32
BLOCK_ROWS = 1024
UPPER_TO_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: row (byte column, byte value) to the eight bits of that byte, highest first
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text in order; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = (text.encode() if isinstance(text, str) else text).translate(UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    if len(words) > shingle:
        start, stop = start[: 1 - shingle], stop[shingle - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    return np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(start.tolist(), stop.tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text from the XXH64 hashes of its word shingles."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes: a bit is set if it is set in over half of them; of none it is 0."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ BYTE_BITS).ravel() * 2 > len(hashes)).tobytes(), "big")


def row_hash():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, row): fingerprint as a signed long, and a hash of id and text that tells rows with one id apart.

    NULL, empty and word-free texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            values = [fingerprint(t, shingle) if t else 0 for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), batch.column(2)], ["doc_id", "fp", "row"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    return named.mapInArrow(run, "doc_id long, fp long, row long")


def wildcard_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): 2 x 32 rows a fingerprint; a key names segment and wildcard and holds the other 31 bits."""
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(mask).alias("bits")) for s in (0, 1)]))
    wild = F.explode(F.array(*[F.lit(i) for i in range(SEGMENT_BITS)]))
    cut = fps.select("fp", parts.alias("p")).select("fp", "p.s", "p.bits", wild.alias("i"))
    cleared = F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)")))
    key = F.expr("shiftleft(cast(s * 32 + i as bigint), 32)").bitwiseOR(cleared)
    return cut.select(key.alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to join all that links at three or fewer bits would.

    A block compares all its members, or two chunks of a large group with each other, and returns a star per connected set: as
    many rows as it has members at most, never its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, ["key", "c1", "c2"]):
            fp = group["fp"].combine_chunks().to_numpy().view(np.uint64)
            if len(fp) == 2:
                if int(np.bitwise_count(fp[0] ^ fp[1])) <= MOST_BITS:
                    a.append(fp[1:])
                    b.append(fp[:1])
            else:
                near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= MOST_BITS
                root = block_roots(near)
                far = root != np.arange(len(fp))
                a.append(fp[far])
                b.append(fp[root[far]])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    blocks = pair_blocks(wildcard_keys(fps), ["key"], "fp", BLOCK_ROWS)
    spread = blocks.select("key", "c1", "c2", "fp").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
    return spread.mapInArrow(run, "a long, b long")


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id, root) of written fingerprints: the smallest doc_id and the class over links, one row per fingerprint."""
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(fps.select("fp")), "simhash-links")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(firsts, "root").select("fp", "component_id", "root")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the hexadecimal fingerprint and the smallest doc_id reachable over links.

    One row per input row; repeated texts and ids are allowed. A NULL doc_id takes part but is never a component's name unless
    all its members are NULL. Word-free texts all have fingerprint zero and are linked like any other.
    """
    marked = settle(fingerprints(docs), "simhash")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(classes(marked), "fp").select("doc_id", digits, "component_id")


def keep_best(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The best document of each root in ``rooted`` (doc_id, row, root), with all columns of ``docs``."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")
    named = rooted.groupBy("root").agg(best).select(F.col("best.row").alias("_row"), F.col("best.doc_id").alias("_id"))
    kept = packed(docs).withColumn("key", row_hash()).join(named, (F.col("key") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    first = Window.partitionBy("key").orderBy("doc_id")
    return kept.withColumn("n", F.row_number().over(first)).filter("n = 1").select("whole.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one of smallest doc_id (NULL last), of a repeated id that with the
    smallest row hash; of wholly repeated rows one stays."""
    marked = settle(fingerprints(docs), "simhash")
    return keep_best(docs, marked.join(classes(marked), "fp"))
