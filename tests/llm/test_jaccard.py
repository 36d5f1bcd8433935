from __future__ import annotations

import random
from itertools import combinations

from casefile.llm import jaccard, simhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow(docs, similarity=0.8):
    """doc_ids that stay: brute force over all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            root[find(i)] = find(j)
    best: dict = {}
    for i, (d, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d), d)
    return set(best.values())


def corpus():
    """Texts with copies in which some words are replaced, chains of them, and a family around one text."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return words

    for n in (3, 8, 50, 60, 100, 200, 300, 500):
        for _ in range(12):
            words = draw.choices(vocabulary, k=n)
            docs += [words, edited(words, 1), edited(words, n // 50), edited(words, n // 12)]
            docs.append(edited(docs[-2], n // 60))
    centre = draw.choices(vocabulary, k=150)
    docs += [edited(centre, draw.choice([1, 2, 3])) for _ in range(120)]
    draw.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE ")]


def test_against_brute_force(spark):
    docs = corpus()
    found = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    want = slow(docs)
    assert {r.doc_id for r in found.collect()} == want
    assert len(want) < 0.7 * len(docs)


def test_one_changed_word(spark):
    """Similarity 0.91 in 100 words; the fingerprints differ in more than two bits."""
    words = [f"x{i}" for i in range(100)]
    pair = [(1, " ".join(words)), (2, " ".join(["other" if i == 50 else w for i, w in enumerate(words)]))]
    assert bin((simhash.fingerprint(pair[0][1].encode(), 5) ^ simhash.fingerprint(pair[1][1].encode(), 5)) & (1 << 64) - 1).count("1") > 2
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(pair, "doc_id long, text string")).collect()] == [1]


def test_bands():
    for s in (0.5, 0.8, 0.9):
        n = jaccard.bands(s, 1e-6)
        assert (1 - s**jaccard.ROWS) ** n < 1e-6 <= (1 - s**jaccard.ROWS) ** (n - 1)
