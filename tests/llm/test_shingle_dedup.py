"""The pipeline's near-duplicate stage against brute force over 5-word shingles."""
import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import shingle_dedup


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Smallest id of each component of texts at similarity 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, y in enumerate(sets) if x == y or (x | y and len(x & y) / len(x | y) >= 0.8)] for x in sets]
    comp = list(range(len(rows)))
    while (now := [min(comp[j] for j in near[i]) for i in range(len(rows))]) != comp:
        comp = now
    return sorted({min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}), near


@pytest.mark.parametrize("block", [4, 128])
def test_stage_links_every_pair_at_four_fifths(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, " "), (3, "a b c"), (4, "A b  c"), (5, "a b"), (6, "one two three four five"), (7, "one two three four five six")]
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for edits in (0, 2, 3, 4, 5, 6, 8):  # each edit in the middle changes five shingles of 196
            text = list(words)
            for at in rng.choice(range(5, 195), edits, replace=False):
                text[at] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows) + 10, " ".join(text)))
    chain = [f"c{x}" for x in range(100)]  # neighbours are near, ends are not
    rows += [(len(rows) + 10 + i, " ".join(chain[i * 4 :] + [f"d{x}" for x in range(i * 4)])) for i in range(12)]
    want, near = survivors(rows)
    assert sum(len(x) > 1 for x in near) > 200
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_simhash_gives_candidates(spark, monkeypatch):
    """The stage's named method: with the bands of minima switched off, pairs within three bits of SimHash still find each other."""
    monkeypatch.setattr(shingle_dedup, "band_keys", lambda values: [])
    words = [f"w{x}" for x in range(4000)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words, "more"])]
    rows = list(enumerate([*near, " ".join(words[:2000]), None, "", "a b c"]))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 6] == survivors(rows)[0]


def test_blocks_are_never_broadcast(spark, monkeypatch):
    """A row of a large bucket stands in many blocks, which Spark's size of the blocks leaves out."""
    monkeypatch.setattr(shingle_dedup, "BLOCK_ROWS", 4)
    buckets = spark.createDataFrame([(key, node) for key in (1, 2) for node in range(40)], "key long, node long")
    sets = spark.createDataFrame([(node, [node // 2 * 10 + i for i in range(5)]) for node in range(40)], "node long, set array<long>")
    found = shingle_dedup.block_links(buckets, sets)
    assert {(r.a, r.b) for r in found.collect()} == {(i + 1, i) for i in range(0, 40, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
