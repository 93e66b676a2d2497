"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once; the top bits of the hash choose one of 256 bins and each bin keeps its smallest hash. An empty
bin takes the value of a non-empty one that a hash of the bin chooses. Only the low four bits of each bin are stored, so a
fingerprint is 16 longs (1,024 bits), and the likeness of two corrects for bins that agree by chance. All of it is built-in column
expressions inside one row: no shuffle, no Python.
"""
from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import words

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
PROBES = 6
BUCKET_ROWS = 512
CELLS = 1024  # quantiles at which ids are cut at most
GROUP = 32
FEW_WORDS = 1500  # texts with fewer words may have many empty bins; for them the occupied bins are listed first
_VALUE = (1 << (64 - BIN_BITS)) - 1  # a value of all ones marks an empty bin


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _probe_rule() -> tuple[list[list[int]], list[int], list[int]]:
    """Per bin j an order of all bins, (offset + step x bin) mod BINS ascending with odd step: the first probes, offsets, steps."""
    draw = random.Random(1)
    offset = [draw.randrange(BINS) for _ in range(BINS)]
    step = [draw.randrange(BINS) | 1 for _ in range(BINS)]
    inverse = [pow(s, -1, BINS) for s in step]
    return [[(a - offset[j]) * inverse[j] % BINS for j in range(BINS)] for a in range(PROBES)], offset, step


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """A long per shingle of consecutive words; fewer words are one shingle, and so is a text without words (NULL too)."""
    def of_words(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            run = lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, shingle)])
            return F.transform(F.slice(h, F.lit(1), F.size(h) - (shingle - 1)), run)

        return F.when(F.size(w) < shingle, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))

    return let(words(text), of_words)


def pack(hashes: Column) -> Column:
    """Fingerprint (array of 16 longs) of an array of at least one hash."""
    probes, offset, step = _probe_rule()
    # one all-ones value per bin joins the hashes, so after sorting every bin has a first value and it is all ones if the bin is empty
    marks = _numbers([((b << (64 - BIN_BITS)) | _VALUE) - (1 << 63) for b in range(BINS)])
    value = F.lit(_VALUE)
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    filled = lambda x: x.bitwiseAND(value) != value

    def densify(first: Column, listed: Column) -> Column:
        at = lambda table, j: F.get(_numbers(table), j)
        taken = lambda p: F.when(filled(F.get(first, p)), F.get(first, p))

        def by_rank(j: Column) -> Column:
            # beyond the first probes: the occupied bin that is first in the bin's order
            rank = lambda b: (at(offset, j) + b * at(step, j)).bitwiseAND(F.lit(BINS - 1)) * BINS + b
            best = F.array_min(F.transform(listed, lambda b: F.when(filled(F.get(first, b)), rank(b))))
            return F.get(first, best.bitwiseAND(F.lit(BINS - 1)))

        # a borrowed value is hashed with its bin, so that the stored bits of its many borrowers tell more than those of one
        borrowed = lambda j: F.xxhash64(F.coalesce(*[taken(at(p, j)) for p in probes], by_rank(j)), j)
        return F.transform(first, lambda x, j: F.when(filled(x), x).otherwise(borrowed(j)).bitwiseAND(F.lit((1 << BITS) - 1)))

    def of_sorted(z: Column) -> Column:
        return let(F.filter(z, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(z, i - 1)))), of_first)

    def of_first(first: Column) -> Column:
        every = _numbers(list(range(BINS)))
        few = F.size(hashes) < FEW_WORDS
        listed = F.when(few, F.filter(every, lambda b: filled(F.get(first, b)))).otherwise(every)
        return let(let(listed, lambda o: densify(first, o)), packed)

    def packed(low: Column) -> Column:
        each = 64 // BITS
        word = lambda k: F.aggregate(F.slice(low, k * each + 1, F.lit(each)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))
        return F.transform(_numbers(list(range(BINS // each))), word)

    return let(F.sort_array(F.concat(hashes, marks)), of_sorted)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text's word shingles; equal texts have equal ones."""
    return let(shingle_hashes(text), pack)


def to_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal bins less what four random bits agree by chance."""
    def unlike(x: Column, y: Column) -> Column:
        # a digit of 4 bits differs if any of its bits does
        return let(x.bitwiseXOR(y), lambda d: let(d.bitwiseOR(F.shiftrightunsigned(d, 1)), lambda e: F.bit_count(e.bitwiseOR(F.shiftrightunsigned(e, 2)).bitwiseAND(F.lit(0x1111111111111111)))))

    differing = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, n: s + n)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (F.lit(1.0) - differing / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance))


def bucket_of(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[Column, int]:
    """(number of the bucket of ``doc_id``, ascending with it and NULL without an id; their count). Buckets hold about equally many rows.

    Ids are cut at up to ``CELLS`` approximate quantiles, so far or clustered ids cost no more than others; where more buckets are
    needed, cells are cut further at equal id width. Equal ids share a bucket.
    """
    n = docs.count()
    buckets = max(1, math.ceil(min(n / bucket_rows, 4 * math.sqrt(n))))
    cells = min(CELLS, buckets)
    shares = ", ".join(f"{k / cells!r}D" for k in range(1, cells))
    cuts = f"percentile_approx(CAST(doc_id AS BIGINT), array({shares}), {4 * CELLS})" if cells > 1 else "CAST(array() AS array<bigint>)"
    found = docs.select(F.expr(cuts), F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    if found[1] is None:
        return F.lit(None).cast("long"), buckets
    marks = sorted(set(found[0]) - {found[1]})
    doc_id, number = F.col("doc_id").cast("long"), lambda values: F.expr(f"array({', '.join(f'CAST({v} AS BIGINT)' for v in values)})")
    upto = lambda values: F.size(F.filter(values, lambda m: m <= doc_id))
    if not marks:
        cell = F.lit(0)
    else:
        # two levels of comparisons: the group of marks, then the mark
        groups = [marks[k : k + GROUP] for k in range(0, len(marks), GROUP)]
        cell = let(upto(number([g[0] for g in groups])), lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * GROUP + upto(F.get(F.array(*[number(g) for g in groups]), c - 1))))
    inner = math.ceil(buckets / cells)
    if inner == 1:
        return F.when(doc_id.isNotNull(), cell.cast("long")), buckets
    bounds = F.array(*[F.lit(float(v)) for v in [found[1], *marks, found[2]]])

    def inside(c: Column) -> Column:
        low = F.get(bounds, c)
        width = F.greatest(F.lit(1.0), (F.get(bounds, c + 1) - low) / F.lit(float(inner)))
        return (c * inner + F.least(F.floor((doc_id.cast("double") - low) / width), F.lit(inner - 1))).cast("long")

    return F.when(doc_id.isNotNull(), let(cell, inside)), buckets


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each document beside the next by ascending doc_id, the last beside the first.

    NULL ids come first, dealt to buckets by their text; equal ids are ordered by text. Rows are dealt to buckets of about equally many rows,
    so each window is small. The last row of a bucket takes the first row of the next bucket that has rows.
    """
    place, buckets = bucket_of(docs, bucket_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.coalesce(place, F.pmod(F.xxhash64(text), F.lit(buckets)) - buckets)
    place = F.coalesce(place.cast("long"), F.lit(0).cast("long"))  # never NULL, so no join adds a filter and all branches share one shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), place.alias("bucket")).withColumn("print", fingerprint(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_print": F.lead("print").over(w), "before": F.lag(F.lit(1)).over(w)})
    heads = rows.filter("before is null").select(F.col("bucket").alias("_bucket"), F.col("text").alias("_text"), F.col("print").alias("_print"))
    # one row a bucket: at most 4 x sqrt(rows) of them are put in order
    order = Window.orderBy("bucket")
    follow = docs.select(place.alias("bucket")).distinct()
    follow = follow.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("_bucket"))
    out = ["doc_id", "text", "print", "next_text", "next_print"]
    lasts = rows.filter("next_text is null").drop("next_text", "next_print").join(follow, "bucket").join(heads, "_bucket")
    lasts = lasts.withColumnsRenamed({"_text": "next_text", "_print": "next_print"})
    return rows.filter("next_text is not null").select(*out).unionByName(lasts.select(*out))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter of code points is replaced by the start of the next.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. NULL text is empty; an empty
    text has the fingerprint of one empty shingle, so two empty texts are alike (1.0). A lone document follows itself.
    """
    n = F.length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), to_hex(F.col("print")).alias("fingerprint"), to_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
