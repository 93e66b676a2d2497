"""WARC files, embeddings and the whole pipeline."""
import base64
import gzip
import hashlib
import io
import math

import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import embedding_lsh, queries, warc
from panelspark.llm.common import block_roots
from tests.check_oracle import compare, connect

SCALE = "/root/testdata/sf0.01"


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip(spark):
    big = "x" * 3_000_000 + "é"
    pages = [(5, "http://a/ b\n", "same"), (3, None, "same"), (9, "u", "same"), (4, "u", None), (2, "u", ""), (7, "u", big), (8, "u", big), (1, "u", "WARC/1.1\r\n\r\n"), (9, "u", "same"), (None, "u", "alone"), (None, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url AS first", "url AS digest", "url AS file")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        body, lead = (h or "").encode(), first.get(h or "")
        again = lead is not None and i != lead
        want.append((i, len(body), sha(body), "revisit" if again else "response", lead if again else None, True, None if again else True))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def plain_record(kind, block, content_type=None, digest=None):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x-page:9>", b"Content-Length: %d" % len(block)]
    head += [b"Content-Type: " + content_type] if content_type else []
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode()] if digest else []
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_only_http_records_have_an_http_header():
    """Blocks of other records are their payload, also large ones without a blank line and ones that hold a blank line."""
    large, split = b"x" * (3 << 20), b"a: 1\r\n\r\nrest"
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    cases = [
        (b"resource", large, b"text/plain", large), (b"metadata", split, b"application/warc-fields", split), (b"conversion", b"", b"text/plain", b""), (b"resource", b"short", None, b"short"),
        (b"warcinfo", b"software: x\r\n", b"application/warc-fields", b"software: x\r\n"), (b"response", http, b"application/http; msgtype=response", b"body"), (b"response", http, None, b"body"),
        (b"response", b"HTTP/1.1 204 No Content\r\n", b"application/http", b""),
    ]
    data = b"".join(plain_record(kind, block, type_, warc.b32_sha1(payload)) for kind, block, type_, payload in cases)
    for step in (1 << 10, 1 << 16):
        got = list(warc.read_records(io.BytesIO(data), step))
        assert [(r[1].encode(), r[4], r[7]) for r in got] == [(kind, len(payload), True) for kind, _, _, payload in cases]


def test_warc_files_are_plain_gzip_members_and_damage_is_refused():
    members = [warc.record("1", "u", b"body", None), warc.record("2", "u", b"body", "1"), warc.record("3", "u", b"", None)]
    data = b"".join(members)
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    for step in (1, 7, 1 << 18):
        assert [r[:2] for r in warc.read_records(io.BytesIO(data), step)] == [("urn:x-page:1", "response"), ("urn:x-page:2", "revisit"), ("urn:x-page:3", "response")]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    flipped = bytearray(data)
    flipped[len(members[0]) // 2] ^= 0xFF
    for bad in (data[:-3], data + b"junk", bytes(flipped), gzip.compress(b"no record"), gzip.compress(gzip.decompress(members[0])[:-6])):
        with pytest.raises(warc.Corrupt):
            list(warc.read_records(io.BytesIO(bad)))
    wrong = gzip.compress(gzip.decompress(members[0]).replace(b"body", b"bodi"))
    assert [r[6:] for r in warc.read_records(io.BytesIO(wrong))] == [(False, False)]


def vectors_by_hand(rows, cosine=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if ok else None)
    n = len(rows)
    near = np.array([[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine for j in range(n)] for i in range(n)])
    return near.sum(1), block_roots(near)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_lsh, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((3, 16))
    rows = [(i, (centre[i % 3] + 0.05 * rng.standard_normal(16)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(400 + i, [x * 3 for x in rows[8][1]], rows[8][2]) for i in range(3)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [-0.0, 1.0] + [0.0] * 14, [0.0, 1.0] + [0.0] * 14, [1.0, 1.0], [1e-30] * 16]
    rows += [(500 + i, v, 1) for i, v in enumerate(odd)] + [(600, rows[0][1], None), (601, rows[0][1], None)]
    got = {r.vec_id: r for r in embedding_lsh.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]
    links, root = vectors_by_hand(single)
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[k], rows[root[k]][0], rows[root[k]][0] == i)
    assert embedding_lsh.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_at_the_threshold():
    """Pairs at cosine 0.93 exactly share a bucket as often as the parameters promise."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    assert (embedding_lsh.bucket_keys(a) == embedding_lsh.bucket_keys(b)).any(axis=1).mean() > 0.9


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    ok, text, _ = compare(spark, connect(SCALE), name, queries.QUERIES[name], queries.ORACLES.get(name), SCALE)
    assert ok, text


def test_pipeline(spark, docs, none):
    for table in (docs, none):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, corpus_pipeline.settle(stage(spark, now, SCALE), name)
            if name != "byte_bpe":
                assert now.columns == table.columns
            if name in ("secret_scan", "byte_bpe"):
                assert now.count() == before.count()
            elif name != "source_mix":
                assert now.count() <= before.count()
    rows = corpus_pipeline.run(spark, SCALE)
    assert rows.count() > 1000 and "n_tokens" in rows.columns
