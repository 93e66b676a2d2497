"""Registered queries of the pipeline's operators on the given tables, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import byte_bpe, embedding_lsh, importance, langid, license_scan, minhash, mixing, secret_scan, separator_scan, sharding, simhash, warc, whitening
from panelspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query(f"SELECT doc_id, CAST({WORDS_SQL} AS BIGINT) AS n_tokens FROM documents")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as 16-bit ids in flat files, found again by the separator scan."""
    return separator_scan.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size, md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(top, coalesce(max(CASE WHEN level <= top / weight THEN level END) OVER () * weight, top)) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER o AS upto, row_number() OVER o AS place FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT q.*, epoch, CASE WHEN target > 0 THEN CAST(source_size * epoch + upto AS DOUBLE) / target ELSE 0 END AS finish FROM q, (VALUES (0), (1)) e(epoch)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served FROM c),
b AS (SELECT CAST(floor(sum(source_size) * 1.5) AS BIGINT) AS budget FROM s)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, budget - (served - size)))) AS BIGINT) AS taken
FROM r, b GROUP BY source, place, doc_id, size, source_size, target"""


@query(MIX_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.embedding_components(table(spark, sf_dir, "embeddings"))


_DIGITS = "('0x' || substr(hex, 5 * j + 1, 5))::INT"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_DIGITS} >> {s}) & 31), 1)" for s in (15, 10, 5, 0))


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(8), lambda j: {_LETTERS}), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
 true AS block_ok, CASE WHEN page_id = first THEN true END AS payload_ok FROM f""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query()
def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _span_sql(rule: secret_scan.Rule, rank: int) -> str:
    """Matches of a rule with places from alternating pieces, as a list of structs."""
    pattern = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(len(m_{rule.kind})), lambda i: {{
 'start': list_sum(list_transform(p_{rule.kind}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m_{rule.kind}[1:i], lambda x: length(x))), 0),
 'rank': {rank}, 'kind': '{rule.kind}', 'end': list_sum(list_transform(p_{rule.kind}[1:i + 1], lambda x: length(x))) + list_sum(list_transform(m_{rule.kind}[1:i + 1], lambda x: length(x)))}}),
 lambda s: length(regexp_extract(m_{rule.kind}[list_position(list_transform(range(len(m_{rule.kind})), lambda i: list_sum(list_transform(p_{rule.kind}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m_{rule.kind}[1:i], lambda x: length(x))), 0)), s.start)], '{pattern}', {rule.group})) >= {rule.least})"""


_MATCHES = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{r.kind}, regexp_split_to_array(t, '{p}') AS p_{r.kind}" for r in secret_scan.RULES for p in [r.pattern.replace("'", "''")])
_JOIN = "coalesce(list_aggregate(list_transform(list_sort({0}), lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.end AS BIGINT)), 'string_agg', ','), '')"
_BASE = " || ".join(_span_sql(r, i) for i, r in enumerate(secret_scan.BASE_RULES))
_MORE = " || ".join(_span_sql(r, i) for i, r in enumerate(secret_scan.RULES) if i >= len(secret_scan.BASE_RULES))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {_MATCHES} FROM d),
s AS (SELECT doc_id, {_BASE} AS base, {_MORE} AS more FROM m)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(base, lambda s: s.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
 sha256({_JOIN.format('base')}) AS base_sha256, {_JOIN.format('base || more')} AS spans FROM s""")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_scan.Ledger(spark)
    return secret_scan.digest(ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


@query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def license_regex(template: license_scan.Template) -> str:
    """A template as a regular expression over words that each follow a blank."""
    out = []
    for part in re.split(r"(<<[^<>]*>>)", template.markup):
        size = re.search(r"\{\d+,\d+\}", part)
        if part.startswith("<<"):
            out.append("(?:" if "beginOptional" in part else ")?" if "endOptional" in part else f"(?: [^ ]+){size[0]}")
        else:
            out += [f" {word}" for word in part.split()]
    return "".join(out) + " "


def _license_sql() -> str:
    phrase = lambda t: " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(t.markup.split(), 1))
    base = license_scan.BASE_TEMPLATES
    places = ", ".join(f"list_filter(range(len(w)), lambda i: {phrase(t)}) AS p{k}" for k, t in enumerate(base))
    has = [f"len(p{k}) > 0" for k, _ in enumerate(base)] + [f"regexp_matches(j, '{license_regex(t)}')" for t in license_scan.MORE_TEMPLATES]
    size = [len(re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>|<<var[^<>]*>>", " ", re.sub(r"\s+", " ", t.markup)).split()) for t in license_scan.TEMPLATES]
    size[[t.label for t in license_scan.TEMPLATES].index("gpl-notice")] = 4  # its optional regions are nested
    named = lambda some: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {has[k]} THEN '{license_scan.TEMPLATES[k].label}' END" for k in some) + "], lambda x: x IS NOT NULL)), ',')"
    most = "greatest(0, " + ", ".join(f"CASE WHEN {h} THEN {n} ELSE 0 END" for h, n in zip(has, size)) + ")"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {places} FROM d),
a AS (SELECT *, list_concat(list_concat(p0, p1), p2) AS starts, {most} AS m, {named(range(len(base)))} AS base_labels, {named(range(len(has)))} AS labels FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
 base_labels, labels, CAST(m AS DOUBLE) / (m + 2) AS score FROM a"""


@query(_license_sql())
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.license_matches(table(spark, sf_dir, "documents").select("doc_id", "text")))


# CRC-32 by its rule: 256 table entries from eight steps each, then one step per byte, once per distinct word
_CRC_SQL = """t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS table_ FROM range(256) r(i)),
f AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)),
  lambda c, b: xor(c // 256, table_[1 + xor(c % 256, b)])), 4294967295) % 10000 AS bucket FROM f, t)"""
_LOW_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""WITH dw AS (SELECT doc_id, unnest({_LOW_WORDS}) AS w FROM documents), bw AS (SELECT unnest({_LOW_WORDS}) AS w FROM benchmark),
{_CRC_SQL},
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket), b AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS ss, (SELECT count(*) FROM bw)::DOUBLE AS tt),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN b ON b.bucket = i, n),
d AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM a),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM c LEFT JOIN r USING (doc_id)""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
