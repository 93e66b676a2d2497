"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table in the shared store, knows
which rule versions have seen which blob and what they found. A scan looks only at pairs of blob and rule version that the
ledger lacks, appends them, and joins findings back to all paths that hold the blob. Everything is built-in column expressions.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.layout import fresh_path
from panelspark.llm.common import packed
from panelspark.llm.minhash import let


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    A text without ``literal`` (if given) cannot match. A change of the rule needs a new ``version``, which is then scanned anew.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    literal: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds and patterns of the base rules, in this order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    # runs of these classes are maximal, so a least length in the pattern keeps the same matches as dropping short ones
    Rule("access", r"AKIA[A-Z0-9]{16,}", literal="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literal="_"),
    # no group is repeated in any rule: Java's matcher recurses once per repeat of a group
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literal="PRIVATE KEY-----", version=2),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def running(values: Column, fold, chunk: int = 256) -> Column:
    """Inclusive prefix folds (sums, maxima) of an array of whole numbers.

    Appending to an array copies it, so chunks of ``chunk`` elements are folded by themselves and the chunks' last folds carry over.
    """
    def prefix(some: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.size(acc) > 0, fold(F.get(acc, F.size(acc) - 1), x)).otherwise(x)))

        return F.aggregate(some, F.array().cast("array<int>"), step)

    def carried(parts: Column) -> Column:
        def joined(tops: Column) -> Column:
            return F.flatten(F.transform(parts, lambda part, c: F.when(c == 0, part).otherwise(F.transform(part, lambda e: fold(F.get(tops, c - 1), e)))))

        return let(prefix(F.transform(parts, lambda part: F.get(part, F.size(part) - 1))), joined)

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(whole), F.lit(chunk))
        return F.when(F.size(whole) > 0, let(F.transform(starts, lambda at: prefix(F.slice(whole, at, chunk))), carried)).otherwise(F.array().cast("array<int>"))

    return let(values, cut)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of one rule as (start, rank, kind, end) in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths give the places.
    """
    def places(found: Column) -> Column:
        def ends(parts: Column) -> Column:
            return running(F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m)), lambda a, b: a + b)

        def kept(end: Column) -> Column:
            size = lambda i: F.length(F.get(found, i))
            group = lambda i: F.length(F.regexp_extract(F.get(found, i), rule.pattern, rule.group))
            every = F.transform(end, lambda e, i: F.struct((e - size(i)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), e.alias("end"), (group(i) >= rule.least).alias("kept")))
            return F.transform(F.filter(every, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))

        return F.when(F.size(found) > 0, let(let(F.split(text, rule.pattern, -1), ends), kept)).otherwise(F.array().cast(SPAN))

    hits = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), places)
    return hits if rule.literal is None else F.when(F.contains(text, F.lit(rule.literal)), hits).otherwise(F.array().cast(SPAN))


class Ledger:
    """The table (blob, rules, spans): one row per blob and scan, with the rule versions that were applied and what they found."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "blob-ledger")
        self.schema = f"blob string, rules array<string>, spans {SPAN}"

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def scan(self, versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan what is new in ``versions`` (column ``path``, text) and return (path, blob, spans), one row per input row.

        NULL text is empty. Equal contents are one blob, scanned once, at the smallest path that holds it; texts meet their path
        again by path, so a large group of copies is never gathered in a task. ``spans`` is sorted by start, then rule order.
        """
        content = F.coalesce(F.col("text").cast("string"), F.lit(""))
        blob = F.sha2(content.cast("binary"), 256).alias("blob")
        named = versions.select(F.col(path).alias("path"), blob)
        wanted = F.array(*[F.lit(r.key) for r in rules])
        seen = self.read().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        fresh = named.groupBy("blob").agg(F.min("path").alias("rep")).join(seen, "blob", "left")
        fresh = fresh.select("blob", "rep", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
        texts = versions.select(F.col(path).alias("path"), content.alias("text")).withColumn("_blob", F.sha2(F.col("text").cast("binary"), 256))
        texts = texts.join(fresh, F.col("path").eqNullSafe(F.col("rep")) & (F.col("_blob") == F.col("blob"))).select("blob", "todo", "text")
        found = [F.when(F.array_contains("todo", r.key), spans(F.col("text"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
        texts.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans")).write.mode("append").parquet(self.path)
        return self.findings(named, rules)

    def hits(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, spans) of the blobs in which the given rule versions have found something."""
        kinds = {r.kind: (r.key, i) for i, r in enumerate(rules)}
        current = lambda x: F.array_contains("rules", F.element_at(F.create_map(*[F.lit(v) for k, (key, _) in kinds.items() for v in (k, key)]), x["kind"]))
        hits = self.read().select("blob", F.filter("spans", current).alias("spans")).filter(F.size("spans") > 0)
        sorted_ = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        # a repeated path and content was scanned as often as it stands there: equal spans are one, and they are neighbours
        return sorted_.select("blob", F.filter("spans", lambda s, i: (i == 0) | (s != F.get("spans", i - 1))).alias("spans"))

    def findings(self, named: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(path, blob, spans) for rows of (path, blob): what the given rule versions have found in the blob so far."""
        return named.join(self.hits(rules), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(findings: DataFrame, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans) of findings whose path is doc_id; the digest covers the base rules."""
    kinds = [r.kind for r in rules]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter("spans", lambda s: s["kind"].isin(kinds)))
    return findings.select(F.col("path").alias("doc_id"), *[count(k) for k in kinds], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: Column, found: Column, mark: str = "[REDACTED]", block: int = 4096) -> Column:
    """The text with every span replaced by ``mark``; spans that overlap are replaced by one.

    Texts are cut out of blocks of ``block`` characters, so the cost of a span does not depend on how far inside the text it lies.
    """
    def cleaned(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            one, last = F.floor(start / block).cast("int"), F.floor(end / block).cast("int")
            at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
            inside = F.substring(at(one), start % block + 1, end - start)
            over = F.concat(F.substring(at(one), start % block + 1, F.lit(block)), F.array_join(F.slice(blocks, one + 2, last - one - 1), ""), F.substring(at(last), F.lit(1), end % block))
            return F.when(end <= start, F.lit("")).when(one == last, inside).otherwise(over)

        def joined_up(reached: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reached, i - 1), F.lit(0))
            gap = lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), F.lit(mark))).otherwise(F.lit(""))
            return F.concat(F.array_join(F.transform(found, gap), ""), piece(F.get(reached, F.size(reached) - 1), F.length(text)))

        return let(running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined_up)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(found) > 0, let(cut, cleaned)).otherwise(text)


def redact_documents(docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Documents with every secret in ``text`` replaced and ``n_chars`` counted anew; all rows and columns stay.

    New blobs are scanned into the ledger first; documents meet its findings by content. NULL text stays NULL.
    """
    ledger.scan(docs.select("doc_id", "text"), "doc_id", rules)
    named = packed(docs).withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = named.join(ledger.hits(rules), F.col("_blob") == F.col("blob"), "left")
    clean = found.withColumn("clean", F.when(F.col("spans").isNotNull(), redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
    return clean.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])
