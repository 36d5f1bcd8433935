"""Serial claims settled in rounds, against a walk in order."""

from __future__ import annotations

import random

import pytest

from casefile.operators import matching

EDGE = "matter_id int, provisional_number long, source_seq long, score int, explicit boolean"
K = ["matter_id"]


def walk(edges):
    """The rule itself, one candidate after the other."""
    out, claimed = {}, set()
    for matter, number in sorted({(e[0], e[1]) for e in edges}):
        mine = [e for e in edges if e[:2] == (matter, number) and (matter, e[2]) not in claimed]
        named = [e[2] for e in mine if e[4]]
        ranked = sorted(((-e[3], e[2]) for e in mine if not e[4]))
        if len(named) == 1:
            found = (named[0], 99, "explicit")
        elif not ranked or -ranked[0][0] < 45:
            continue
        elif len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 8:
            found = (None, -ranked[0][0], "ambiguous")
        else:
            found = (ranked[0][1], -ranked[0][0], "matched")
        out[matter, number] = found
        if found[0] is not None:
            claimed.add((matter, found[0]))
    return out


def drawn(seed, candidates, sources, explicit):
    draw, edges = random.Random(seed), []
    for matter in range(6):
        for number in range(1, candidates + 1):
            for source in draw.sample(range(sources), draw.randrange(sources // 2 + 1)):
                edges.append((matter, number, source, draw.randrange(38, 89), False))
            if draw.random() < explicit:
                edges += [(matter, number, s, 99, True) for s in draw.sample(range(sources), draw.choice([1, 1, 2, 3]))]
    return edges


def decided(spark, edges, **how):
    rows = matching.assign_edges(spark.createDataFrame(edges, EDGE), K, **how).collect()
    found = {(r.matter_id, r.provisional_number): (r.source_seq, r.confidence, r.decision) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("rounds", [0, 1, 3, matching.ROUNDS])
@pytest.mark.parametrize("explicit", [0.0, 0.4])
def test_rounds_equal_the_walk(spark, rounds, explicit):
    edges = drawn(23 + (rounds % 2), 25, 12, explicit)
    assert decided(spark, edges, rounds=rounds) == walk(edges)


def test_chain_longer_than_the_rounds(spark):
    """Each candidate loses its first source to the one before: nothing settles early."""
    edges = [(1, n, s, p, False) for n in range(60) for s, p in ((n, 60), (n + 1, 80))]
    edges += [(1, 0, 1, 99, True)]
    got = decided(spark, edges, rounds=2)
    assert got == walk(edges) and {d for _, _, d in got.values()} == {"explicit", "matched"}


def test_large_matter(spark, monkeypatch):
    """50,000 candidates over the same sources settle in rounds; none is left to fold."""
    monkeypatch.setattr(matching, "_decide", None)
    scores = [(1, 88), (2, 78), (3, 70), (4, 61), (5, 53), (6, 45), (7, 44)]
    numbers = spark.range(1, 50_001).selectExpr("1 matter_id", "id provisional_number")
    edges = numbers.crossJoin(spark.createDataFrame(scores, "source_seq long, score int")).selectExpr(*[c.split()[0] for c in EDGE.split(", ")[:4]], "false explicit")
    got = {r.provisional_number: tuple(r)[2:] for r in matching.assign_edges(edges, K).collect()}
    first = {1: (1, 88, "matched"), 2: (2, 78, "matched"), 3: (3, 70, "matched"), 4: (4, 61, "matched"), 5: (5, 53, "matched")}
    assert got == first | {n: (None, 45, "ambiguous") for n in range(6, 50_001)}


def test_no_edges(spark):
    assert decided(spark, []) == {}
