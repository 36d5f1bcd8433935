"""The pipeline's near-dedup goes through fingerprints and through shingle sets."""

from __future__ import annotations

import corpus_pipeline as P

from casefile.llm import simhash


def pair(spark, a, b):
    return spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")


def test_fingerprints_link(spark):
    """Repeats count in a fingerprint and not in a set: equal fingerprints, similarity below 0.6."""
    phrase = " ".join(f"w{i}" for i in range(9))
    texts = [" ".join([phrase] * 80), " ".join([*[phrase] * 80, "one two three four five"])]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert bin((prints[0] ^ prints[1]) & (1 << 64) - 1).count("1") <= 2
    assert [r.doc_id for r in P.near_dedup(spark, pair(spark, *texts), "").collect()] == [1]


def test_links_of_both_kinds_connect(spark):
    """1 and 2 have like fingerprints, 2 and 3 like sets: all are one group, and a text like none of them stays."""
    phrase = " ".join(f"w{i}" for i in range(9))
    tail = [f"t{i}" for i in range(60)]
    first, second = " ".join([phrase] * 800), " ".join([*[phrase] * 800, *tail])
    third = " ".join([phrase, *tail])
    rows = [(1, first), (2, second), (3, third), (4, " ".join(f"z{i}" for i in range(60)))]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 4]
