"""License scans, importance resampling and whitening against brute force and hand-made cases."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from panelspark.layout import fresh_path
from panelspark.llm import importance, license_scan, queries, whitening
from panelspark.llm.license_scan import Template

WORD = re.compile(license_scan.WORD)
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def lists_of(markup):
    """Every way to read a template as a list of words and gaps: nested lists of choices written out."""
    parts = re.split(r"(<<[^<>]*>>)", markup)

    def read(i, depth):
        ways = [[]]
        while i < len(parts):
            if "beginOptional" in parts[i]:
                inner, i = read(i + 1, depth + 1)
                ways = [w + x for w in ways for x in [[], *inner]]
            elif "endOptional" in parts[i]:
                return ways, i
            elif parts[i].startswith("<<var"):
                low, high = map(int, re.search(r"\{(\d+),(\d+)\}", parts[i]).groups())
                ways = [w + [None] * k for w in ways for k in range(low, high + 1)]
            else:
                ways = [w + parts[i].split() for w in ways]
            i += 1
        return ways, i

    return read(0, 0)[0]


def places_by_hand(text, template):
    w = words(text)
    found = {}
    for way in lists_of(template.markup):
        for i in range(len(w) - len(way) + 1):
            if all(a is None or a == b for a, b in zip(way, w[i:])):
                found.setdefault(i + len(way), set()).add(i)
    return found  # end: starts


MARKUPS = [
    "a b", "a <<beginOptional>>b<<endOptional>> c", 'a <<var;name="x";match="{0,3}">> c', "<<beginOptional>>a <<beginOptional>>b<<endOptional>><<endOptional>> c",
    'b <<beginOptional>><<var;match="{1,2}">> a<<endOptional>> c', '<<var;match="{1,2}">> a c', 'a <<var;match="{2,2}">>', "a a a",
]


def test_automaton_equals_all_readings_of_the_markup(monkeypatch):
    rng = np.random.default_rng(5)
    templates = [Template(f"t{i}", m) for i, m in enumerate(MARKUPS)]
    together = license_scan.Automaton(templates)
    for most in (1 << 20, 7):
        monkeypatch.setattr(license_scan.text_slices, "__defaults__", (most,))
        for _ in range(150):
            text = " ".join(rng.choice(list("abcd"), rng.integers(0, 25)))
            n, found = together.scan(text.upper())
            assert n == len(words(text))
            for k, t in enumerate(templates):
                want = places_by_hand(text, t)
                got = [(start, end) for (i, start), end in found.items() if i == k]
                assert bool(got) == bool(want)
                for start, end in got:
                    assert start in want[end]
                # the latest start of every end is reported, if no later end hides it
                for end, starts in want.items():
                    assert any(s == max(starts) and e >= end for s, e in got)


def test_mandatory_wording_must_match_exactly():
    scan = license_scan.Automaton(license_scan.TEMPLATES)
    label = lambda text: {scan.templates[k].label for k, _ in scan.scan(text)[1]}
    mit = re.sub(r"\s+", " ", re.sub(r"<<[^<>]*>>", " ", next(t.markup for t in license_scan.TEMPLATES if t.label == "mit-text"))).strip()
    mit = mit.replace("portions of software", "portions of the Software")
    assert label("Copyright 2020\n" + mit.capitalize() + ".") == {"mit-text"}
    assert label(mit.replace("the software to deal", "to deal")) == {"mit-text"}  # optional wording left out
    assert label(mit.replace("sublicense", "relicense")) == set()  # mandatory wording changed
    assert label(mit.replace("merge ", "")) == set()
    assert label("Released under the MIT License.") == {"mit", "mit-notice"}
    assert label("GNU General Public License, version 3") == {"gpl", "gpl-notice"} and label("SPDX-License-Identifier: BSD-3-Clause") == {"spdx-tag"}
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "a <<var;name=x>>", "a <<other>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton([Template("bad", bad)])
    with pytest.raises(ValueError):
        license_scan.Automaton([Template("nothing", "<<beginOptional>>a<<endOptional>>")])


def test_license_scan_of_odd_documents(spark, docs, none):
    long = "mit license " * 200_000 + "General-Public_License"
    more = spark.createDataFrame([(1000, "MIT\tLicense mit LICENSE"), (1001, long), (1002, "mit licenses"), (1003, "ömit license")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "source").unionByName(more.selectExpr("*", "text AS source")).selectExpr("*", "source AS n_words", "source AS matches", "source AS label")
    texts = [r.text for r in both.collect()]
    got = license_scan.license_digest(license_scan.license_matches(both)).collect()
    assert len(got) == len(texts)
    want = []
    for t in texts:
        w = words(t)
        at = {t.label: [i for i in range(len(w)) if w[i : i + len(t.markup.split())] == t.markup.split()] for t in license_scan.BASE_TEMPLATES}
        every = [i for p in at.values() for i in p]
        want.append((len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(k for k, p in at.items() if p))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[1:6]) for r in got)
    big = next(r for r in got if r.doc_id == 1001)
    assert (big.n_words, big.n_base, big.base_labels) == (400_003, 200_001, "gpl,mit") and all(0 <= r.score < 1 for r in got)
    assert "label" in license_scan.license_matches(both).columns and license_scan.license_matches(none).count() == 0


def features_by_hand(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled_by_hand(rows, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: np.bincount([bucket(f) for t in texts for f in features_by_hand(t, n)], minlength=buckets)
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1.0) * (float(s.sum()) + buckets) / ((int(s[b]) + 1.0) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        feats = features_by_hand(x, n)
        weight = sum(gain[bucket(f)] for f in feats)
        out.append([i, len(words(x)), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    return out


@pytest.mark.parametrize(("ngrams", "buckets", "chunk_rows"), [(1, 10_000, 200_000), (2, 500, 5), (4, 97, 3)])
def test_importance_resampling(spark, docs, none, monkeypatch, ngrams, buckets, chunk_rows):
    monkeypatch.setattr(importance, "COPIES", 3)
    rng = np.random.default_rng(ngrams)
    some = [" ".join(rng.choice(["alpha", "Beta", "gamma\n", "\n", "delta\n\nx", "é", "7"], rng.integers(0, 60))) for _ in range(60)]
    made = [(2000 + i, t) for i, t in enumerate(some)] + [(2003, some[3])] * 7 + [(None, some[5])] * 9
    more = spark.createDataFrame(made, "doc_id long, text string")
    table = docs.select("doc_id", "text", "source", "row", "size").unionByName(more, allowMissingColumns=True).selectExpr("*", "source AS rows", "row AS line", "size AS weight")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    target = [None, "", "alpha beta\ngamma", "é é 7\n\n7 delta"] + some[:3]
    got = importance.resample(
        table, spark.createDataFrame([(t,) for t in target], "text string"), ngrams=ngrams, buckets=buckets, percent=40, least_words=5, chunk_rows=chunk_rows
    ).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, resampled_by_hand(rows, target, ngrams, buckets, 5, 40)))
    assert importance.resample(none, more).count() == 0
    assert importance.resample(more, none).filter("rank IS NOT NULL").count() > 0


def test_drawn_documents_come_whole_and_as_often_as_drawn(spark, docs):
    target = spark.createDataFrame([("brown fox owls",)], "text string")
    options = {"percent": 60, "least_words": 5}
    drawn = importance.drawn_documents(docs, target, **options)
    ranked = importance.resample(docs, target, **options).filter("rank IS NOT NULL")
    assert drawn.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in drawn.collect()))) == sorted(map(str, (r.doc_id for r in ranked.collect())))


def test_a_line_is_counted_once_however_often_it_stands(spark):
    lines = importance.distinct_lines(spark.createDataFrame([("same line\nother\nsame line",), ("same line",), ("\n\n",)], "text string"))
    assert sorted((r.occurrences, r.n_words) for r in lines.collect()) == [(1, 1), (3, 2)]


def whitened_by_hand(rows, k=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    apart = x * n - total
    centred = apart.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {i: int((a * a).sum()) for (i, _), a in zip(rows, apart)}, e, centred @ v / np.sqrt(e), (centred**2).sum() / n


@pytest.mark.parametrize(("dim", "fan_in"), [(12, 16), (40, 2), (1, 16)])
def test_whitening(spark, dim, fan_in, monkeypatch):
    monkeypatch.setattr(whitening.triangle, "__kwdefaults__", {"fan_in": fan_in})
    rng = np.random.default_rng(dim)
    mix = rng.standard_normal((dim, dim))
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(dim) @ mix)]) for i in range(300)]
    rows += [rows[3]] * 5
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [nan] * dim), (903, [inf] * dim), (904, [None] * dim), (905, [1e300] * dim)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS component", "embedding AS x", "1 AS n").repartition(7)
    got = whitening.whiten(table).toPandas()
    deviation, e, w, trace = whitened_by_hand(rows)
    k = min(dim, 32)
    assert len(got) == len(rows) * k and set(got["vec_id"]) == {i for i, _ in rows}
    assert (got["n"] == len(rows)).all() and all(deviation[r.vec_id] == r.deviation for r in got.itertuples())
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c in range(k):
        mine = got[got["component"] == c + 1].sort_values("vec_id")
        theirs = w[np.argsort([i for i, _ in rows], kind="stable"), c]
        assert np.allclose(mine["explained"], e[c] / trace, rtol=1e-9)
        assert min(np.abs(mine["whitened"] - theirs).max(), np.abs(mine["whitened"] + theirs).max()) < 1e-6


def test_whitening_of_flat_odd_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [2.0, 2.0, 0.0]), (4, [1.0]), (5, [2.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id", "component").collect()
    three = [r for r in got if r.vec_id <= 3]
    assert [r.component for r in three] == [1, 2, 3] * 3 and [r.whitened is None for r in three] == [False, True, True] * 3
    assert [r.explained for r in three[:3]] == pytest.approx([1.0, 0.0, 0.0]) and three[0].deviation == (3 * 64 * 1) ** 2
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got if r.vec_id > 3] == [(4, 1, 1, 0, None, None), (5, 1, 1, 0, None, None), (5, 2, 1, 0, None, None)]
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [2.0**54]), (2, [-(2.0**54)])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in huge] == [None, None] and sorted(round(r.whitened, 9) for r in huge) == [-1, 1]


@pytest.mark.parametrize("case", ["plain", "graded", "equal", "near", "short", "zero"])
def test_bidiagonal_qd_solver(case):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    a = {
        "plain": rng.standard_normal((200, 24)), "graded": rng.standard_normal((200, 24)) * np.logspace(0, -6, 24), "equal": np.concatenate([np.eye(24), -np.eye(24)]) @ turn,
        "near": np.concatenate([np.eye(24) * (1 + 1e-9 * np.arange(24)), -np.eye(24)]) @ turn, "short": rng.standard_normal((9, 24)), "zero": np.zeros((5, 24)),
    }[case]
    r = np.linalg.qr(np.concatenate([a, np.zeros((24, 24))]), mode="r")
    fit = whitening.solve(r, len(a), [0] * 24, 24)
    live = len(fit.vectors)
    want = np.linalg.svd(a, compute_uv=False) ** 2 / len(a)
    assert live == {"short": 9, "zero": 0}.get(case, 24)
    assert np.allclose(fit.values[:live], want[:live], rtol=1e-8) and np.abs(fit.vectors @ fit.vectors.T - np.eye(live)).max(initial=0) < 1e-9
    assert np.abs((a.T @ a / len(a)) @ fit.vectors.T - fit.vectors.T * fit.values[:live]).max(initial=0) <= 1e-13 * max(1.0, want[0])


def test_new_queries_are_registered(spark):
    assert {"op11_importance_resampling", "op12_embedding_whitening", "op13_license_scan"} <= set(queries.QUERIES) and fresh_path(spark, "x")
