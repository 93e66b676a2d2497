"""Importance resampling towards a target distribution by segment deduplication.

Texts are cut into lines at newlines. Every distinct line is kept once with its number of occurrences; the hashed n-grams inside it are
found once and count as often as the line stands there. N-grams that reach over a newline are found per text and added separately.
Bucket counts of corpus and target give a gain per bucket; a text's weight is the sum over its lines (joined back by line) and
its reaching n-grams, and Gumbel noise on top makes the highest scores a draw in proportion to the weights.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.layout import CHUNK_ROWS, CHUNKS, quantile_marks, settle
from panelspark.llm.minhash import let

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
COPIES = 4096  # repeated rows that one row stands for when they are written out


def lower_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; digits, letters and everything beyond ASCII belong to words."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(small, GAP), "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def runs(words: Column, ngrams: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``ngrams`` consecutive words; the words are found once, not once per run."""

    def found(words: Column) -> Column:
        per_length = [F.transform(words, lambda w: bucket(w, buckets))]
        for n in range(2, ngrams + 1):
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
            per_length.append(F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " "), buckets)))
        return F.concat(*per_length)

    return let(words, found)


def reaching_runs(text: Column, ngrams: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to ``ngrams`` words whose first and last word stand in different lines.

    Of every line only the outer ``ngrams`` - 1 words at either end can take part; what lies between them is cut out.
    """
    edge = ngrams - 1
    if not edge:
        return F.array().cast("array<int>")

    def ends(words: Column, line: Column) -> Column:
        place = lambda w, i: F.struct(w.alias("w"), line.alias("line"), i.alias("i"))
        return F.filter(F.transform(words, place), lambda p: (p["i"] < edge) | (p["i"] >= F.size(words) - edge))

    def follows(p: Column, after: Column) -> Column:
        # where the middle of a line is cut out, its ends do not follow each other
        return (after["line"] > p["line"]) | (after["i"] == p["i"] + 1)

    def found(outer: Column) -> Column:
        per_length = []
        for n in range(2, ngrams + 1):
            starts = F.when(F.size(outer) >= n, F.sequence(F.lit(1), F.size(outer) - n + 1)).otherwise(F.array().cast("array<int>"))
            some = F.transform(starts, lambda i: F.slice(outer, i, n))
            at = lambda run, j: F.get(run, F.lit(j))
            some = F.filter(some, lambda run: at(run, 0)["line"] < at(run, n - 1)["line"])
            for j in range(1, n):
                some = F.filter(some, lambda run: follows(at(run, j - 1), at(run, j)))
            per_length.append(F.transform(some, lambda run: bucket(F.array_join(F.transform(run, lambda p: p["w"]), " "), buckets)))
        return F.concat(*per_length)

    lines = F.transform(text_lines(text), lambda line, k: let(lower_words(line), lambda words: ends(words, k)))
    return let(F.flatten(lines), found)


def _keys(of: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits that stand for a text or line."""
    return [F.xxhash64(of).alias(names[0]), F.xxhash64(F.lit(1), of).alias(names[1])]


def distinct_lines(texts: DataFrame, *, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(l1, l2, occurrences, n_words, features) of every distinct line with words; ``features`` are the buckets of its runs."""
    lines = texts.select(F.explode(text_lines(F.col("text"))).alias("line")).filter("line <> ''")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    worded = counted.select(*_keys(F.col("line"), ("l1", "l2")), "occurrences", lower_words(F.col("line")).alias("words"))
    full = worded.select("l1", "l2", "occurrences", F.size("words").cast("long").alias("n_words"), runs(F.col("words"), ngrams, buckets).alias("features"))
    return settle(full.filter("n_words > 0"), "lines")


def bucket_counts(texts: DataFrame, lines: DataFrame, *, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, from their distinct lines times occurrences and the runs that reach over newlines."""
    inside = lines.select(F.explode("features").alias("bucket"), "occurrences")
    if ngrams > 1:
        inside = inside.unionByName(texts.select(F.explode(reaching_runs(F.col("text"), ngrams, buckets)).alias("bucket"), F.lit(1).cast("long").alias("occurrences")))
    return inside.groupBy("bucket").agg(F.sum("occurrences").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target; one number a bucket comes to the driver."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    share = lambda own, of: (F.col(own).cast("double") + 1.0, F.lit(float(of)) + float(buckets))
    (t1, t_all), (s1, s_all) = share("t", total.T), share("s", total.S)
    gains = both.select("bucket", F.floor(1000.0 * F.log(t1 * s_all / (s1 * t_all))).cast("long").alias("gain"))
    return [gain for _, gain in sorted(map(tuple, gains.collect()))]


def _summed(features: Column, gains: Column) -> Column:
    return F.aggregate(features, F.lit(0).cast("long"), lambda acc, b: acc + F.get(gains, b))


def weigh(docs: DataFrame, lines: DataFrame, gains: list[int], *, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, d1, d2, rows, n_words, n_features, weight): one row per distinct document; ``rows`` is how often it is repeated."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal
    weighed = lines.select("l1", "l2", "n_words", F.size("features").cast("long").alias("n_features"), _summed(F.col("features"), table).alias("weight"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_keys(text, ("d1", "d2")))
    filled = F.filter(text_lines(F.col("text")), lambda line: line != "")
    parts = named.select("doc_id", "d1", "d2", F.posexplode(F.when(F.size(filled) > 0, filled).otherwise(F.array(F.lit("")))).alias("pos", "line"))
    parts = parts.select("doc_id", "d1", "d2", (F.col("pos") == 0).cast("long").alias("head"), *_keys(F.col("line"), ("l1", "l2")))
    sums = parts.join(weighed, ["l1", "l2"], "left").groupBy("doc_id", "d1", "d2").agg(
        F.sum("head").alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_words", "n_features", "weight")]
    )
    # the lines of a repeated row were summed as often as it stands there
    once = sums.select("doc_id", "d1", "d2", "rows", *[F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")])
    if ngrams == 1:
        return once
    reaching = named.withColumn("found", reaching_runs(F.col("text"), ngrams, buckets)).filter(F.size("found") > 0)
    reaching = reaching.groupBy("doc_id", "d1", "d2").agg(F.max(F.size("found")).cast("long").alias("_n"), F.max(_summed(F.col("found"), table)).alias("_w"))
    on = once["doc_id"].eqNullSafe(reaching["doc_id"]) & (once["d1"] == reaching["d1"]) & (once["d2"] == reaching["d2"])
    return once.join(reaching, on, "left").select(
        once["doc_id"], once["d1"], once["d2"], "rows", "n_words", (F.col("n_features") + F.coalesce("_n", F.lit(0))).alias("n_features"), (F.col("weight") + F.coalesce("_w", F.lit(0))).alias("weight")
    )


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 x Gumbel) drawn by the SHA-256 of seed and id; a NULL id draws as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def first_places(rows: DataFrame, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``before``: how many rows, repeats counted, come earlier by score (highest first), then id (NULL last) and text.

    The order is cut at approximate quantiles of the score into chunks of about ``chunk_rows``; chunk totals carry over.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), quantile_marks("score", CHUNKS).alias("marks")).first()
    step = max(1, CHUNKS // max(1, -(-facts.n // chunk_rows)))
    cuts = sorted(set((facts.marks or [])[step - 1 :: step]), reverse=True)
    chunk = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("score") < c)) if cuts else F.lit(0)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "d1", "d2"]
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    split = rows.withColumn("_chunk", chunk)
    totals = split.groupBy("_chunk").agg(F.sum("rows").alias("_rows"))  # at most CHUNKS rows
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    placed = split.withColumn("_inside", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(totals, "_chunk")
    return placed.withColumn("before", F.col("_offset") + F.col("_inside")).drop("_chunk", "_offset", "_inside")


def resample(
    docs: DataFrame, target: DataFrame, *, ngrams: int = 1, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(doc_id, d1, d2, n_words, n_features, weight, score, rank), one row per row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the documents with ``least_words`` words or more, floor(``percent`` % of them) with the highest scores are drawn; ``rank``
    counts them from 1, ties go to the smaller doc_id, and it is NULL for all others. (d1, d2) stand for the text. NULL and
    empty texts have no words and weight 0. Repeated rows have one score and each its own rank. An empty table gives an empty
    one; an empty target makes rare words the likelier ones. Other columns of any name are not looked at.
    """
    lines = distinct_lines(docs, ngrams=ngrams, buckets=buckets)
    counts = [bucket_counts(docs, lines, ngrams=ngrams, buckets=buckets), bucket_counts(target, distinct_lines(target, ngrams=ngrams, buckets=buckets), ngrams=ngrams, buckets=buckets)]
    gains = bucket_gains(*counts, buckets=buckets)
    weighed = weigh(docs, lines, gains, ngrams=ngrams, buckets=buckets)
    scored = settle(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = (able.agg(F.sum("rows")).first()[0] or 0) * percent // 100
    placed = first_places(able, chunk_rows=chunk_rows).unionByName(scored.filter(F.col("n_words") < least_words), allowMissingColumns=True)
    # rows repeated often are written out by several tasks
    parts = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {COPIES}")))).repartition("doc_id", "_part")
    each = parts.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES, F.least(F.col("rows"), (F.col("_part") + 1) * COPIES) - 1)))
    place = F.col("before") + F.col("_copy") + 1
    return each.select("doc_id", "d1", "d2", "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, as often as they were drawn; of rows that share id and text one stands for all."""
    ranked = resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs["doc_id"].cast("long").alias("id"), *_keys(text, ("d1", "d2")))
    whole = whole.dropDuplicates(["id", "d1", "d2"])
    on = whole["id"].eqNullSafe(ranked["_id"]) & (whole["d1"] == ranked["_d1"]) & (whole["d2"] == ranked["_d2"])
    return whole.join(ranked, on).select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
