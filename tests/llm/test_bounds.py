"""Bounds of memory and time on texts made to break them, and samples that keep rare languages."""
import random
import re
import time

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, langid, secret_scan
from panelspark.llm.secret_scan import Rule


def test_spaceless_texts_are_not_remembered(spark):
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = byte_bpe.Codec(byte_bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    know = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(4)
    letters = "的一是不了人我在有他这中大来上国漢字かな🙂abcXYZ019+/"
    for _ in range(50):
        texts = ["".join(draw.choices(letters, k=400)) for _ in range(200)]
        got = codec.encode(texts)
        held = sum(len(k.encode()) + len(v) + byte_bpe.ENTRY_BYTES for known in (codec.first, codec.known) for k, v in known.items())
        assert held <= 2 * byte_bpe.CACHE_BYTES and all(len(k) <= byte_bpe.CACHE_CHARS for k in (*codec.first, *codec.known))
    assert [list(map(int, ids.split())) for ids in got] == [know.encode_ordinary(t) for t in texts]


def test_memory_is_emptied_at_its_bound(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = byte_bpe.Codec(byte_bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    know = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for start in range(0, 2000, 40):
        texts = [" ".join(f"w{i}x{i % 7}" for i in range(start, start + 60)), "x" * 500 + " " + "y" * 300]
        assert [list(map(int, ids.split())) for ids in codec.encode(texts)] == [know.encode_ordinary(t) for t in texts]
        assert codec.held <= 20_000


def found(spark, text, rules=secret_scan.RULES):
    ledger = secret_scan.Ledger(spark)
    return ledger.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", rules).first()["spans"]


def test_long_inner_parts_of_every_rule(spark):
    n = 100_000
    parts = {
        "-----BEGIN " + "A " * n + " no PRIVATE KEY-----": [], "-----BEGIN " + "AB " * n + "PRIVATE KEY-----": ["pem"],
        "token" + " " * n + "=" + " " * n + "x" * n: ["assign"], "AKIA" + "A" * n: ["access"], "0a" * n: ["hex"], "ghp_" + "z" * n: ["github"],
    }
    for text, kinds in parts.items():
        start = time.time()
        spans = [(s["kind"], s["start"], s["end"]) for s in found(spark, text)]
        assert [k for k, _, _ in spans] == kinds and all((a, b) == (0, len(text)) for _, a, b in spans)
        assert time.time() - start < 30


def test_very_many_matches_in_one_text(spark):
    n = 100_000
    text = "é token=abc123 " * n
    start = time.time()
    spans = found(spark, text)
    assert [(s["start"], s["end"]) for s in spans] == [(15 * i + 2, 15 * i + 14) for i in range(n)]
    clean = spark.createDataFrame([(text,)], "text string").select(
        secret_scan.redact(F.col("text"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 15 + 2).alias("start"), (i * 15 + 14).alias("end")))).alias("t")
    ).first()["t"]
    assert clean == "é [REDACTED] " * n
    assert time.time() - start < 120


def test_redaction_over_block_edges(spark):
    draw = random.Random(9)
    for _ in range(4):
        text = "".join(draw.choices("ab 🙂é", k=60))
        spans = sorted((a, min(60, a + draw.randrange(1, 20))) for a in draw.sample(range(59), 6))
        want, at = "", 0
        for a, b in spans:
            if a >= at:
                want += text[at:a] + "#"
            at = max(at, b)
        want += text[at:]
        marks = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
        for block in (1, 3, 7, 100):
            assert spark.createDataFrame([(text,)], "text string").select(secret_scan.redact(F.col("text"), marks, "#", block)).first()[0] == want


def test_no_rule_repeats_a_group():
    for rule in secret_scan.RULES:
        assert not re.search(r"\)[*+{]", rule.pattern)
    assert Rule("x", "a").key == "x@1"


def test_rare_languages_are_learned(spark):
    rows = [(i, f"der hund und die katze {i}" * 3, "de") for i in range(6000)] + [(10_000 + i, "zq xv zq kj wv zq xx " * 3, "rare") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample_docs=100)
    assert set(model.langs) == {"de", "rare"}
    got = langid.predict(docs.filter("doc_id >= 10000"), model).groupBy("lang_pred").count().collect()
    assert [r.lang_pred for r in got] == ["rare"]
    assert set(langid.train(docs, sample_bytes=4000).langs) == {"de", "rare"}
