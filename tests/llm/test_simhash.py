from __future__ import annotations

import random

import xxhash

from casefile.llm import simhash


def slow_print(text: str | None, k: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints: list[int], bits: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_documents(spark):
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 5, 60, 900]))) for _ in range(40)]
    texts = [*base, *(b + " tail" for b in base), *base[:10], "", None, " \n\t", "ÉCOLE école É É"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame.select("doc_id", "text")).collect()}
    prints = [slow_print(t, 3) for t in texts]
    assert [rows[i].fingerprint & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [rows[i].component_id for i in range(len(texts))] == slow_groups(prints, 2)


def test_crowded_cells_and_chains(spark):
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    family = {centre}
    while len(family) < 400:  # walks away from the centre, within few bits
        family.add(draw.choice(sorted(family)) ^ 1 << draw.randrange(12) ^ 1 << draw.randrange(12))
    prints = sorted(family | {draw.getrandbits(64) for _ in range(200)})
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    for bits in (0, 1, 2):
        found = simhash.components(simhash.links(frame, bits)).collect()
        want = slow_groups(prints, bits)
        got = {r.node & (1 << 64) - 1: r.component for r in found}
        by: dict = {}
        for p, g in zip(prints, want):
            by.setdefault(g, set()).add(got.get(p, ("alone", p)))
        assert all(len(s) == 1 for s in by.values())
        assert len({next(iter(s)) for s in by.values()}) == len(by)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    rows = simhash.near_duplicates(twice).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
