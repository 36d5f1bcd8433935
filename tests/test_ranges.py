"""Ranges as aligned intervals, against comparisons of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casefile.operators import sheets

RANGE = "sheet_id int, left_col int, top_row int, right_col int, bottom_row int"


def test_overlaps(spark):
    draw = random.Random(2)

    def ranges(n, longest):
        out = []
        for _ in range(n):
            top, left = draw.choice([draw.randrange(0, 50), draw.randrange(0, 1 << 21)]), draw.randrange(1, 6)
            out.append((draw.randrange(2), left, top, left + draw.randrange(3), top + draw.randrange(longest)))
        return out

    left = ranges(60, 40) + ranges(20, 3_000_000) + [(0, 1, 0, 9, (1 << 20) - 1), (1, 1, 5, 1, 5)]
    right = ranges(60, 40) + ranges(20, 3_000_000) + [(0, 1, 0, 9, (1 << 20) - 1), (1, 1, 5, 1, 5), (0, 3, 1 << 20, 3, 1 << 20)]
    found = sheets.range_overlaps(spark.createDataFrame(left, RANGE), spark.createDataFrame(right, RANGE))
    want = []
    for a in left:
        for b in right:
            if a[0] == b[0] and a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]:
                want.append((*a, *b[1:], b[1] < a[1] or b[2] < a[2] or b[3] > a[3] or b[4] > a[4]))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_intervals(spark):
    """They cover the range, each row once, and are few."""
    draw = random.Random(3)
    spans = [(0, (1 << 20) - 1), (1, (1 << 20) - 2), (0, 0), (7, 6), (5, 5), (0, (1 << 22) + 4)] + [(a, a + draw.randrange(1 << 16)) for a in (draw.randrange(1 << 20) for _ in range(40))]
    packed, parts = sheets.aligned_intervals(F.col("a"), F.col("b"))
    for row in spark.createDataFrame(spans, "a int, b int").withColumn("_rows", packed).select("a", "b", parts.alias("p")).collect():
        pieces = sorted((n.node << n.level, (n.node + 1) << n.level) for n in row.p)
        assert [x for x, _ in pieces] == [row.a, *[y for _, y in pieces[:-1]]][: len(pieces)]
        assert (pieces[-1][1] == row.b + 1) if pieces else row.b < row.a
        assert len(pieces) <= 2 * sheets.LEVELS + ((row.b - row.a) >> sheets.LEVELS) + 1


def closed(start, cells):
    """The rule itself: again and again over all cells until nothing changes."""
    a = list(start)
    while True:
        before = list(a)
        for left, top, right, bottom in cells:
            if a[0] <= right and a[2] >= left and a[1] <= bottom and a[3] >= top:
                a = [min(a[0], left), min(a[1], top), max(a[2], right), max(a[3], bottom)]
        if a == before:
            return tuple(a)


def expanded(spark, starts, merged):
    rows = sheets.expand_ranges(spark.createDataFrame(starts, RANGE), spark.createDataFrame(merged, RANGE)).collect()
    return sorted(tuple(r[c.split()[0]] for c in RANGE.split(", ")) for r in rows)


@pytest.mark.parametrize("single", [0, sheets.SINGLE])
def test_expansion(spark, monkeypatch, single):
    monkeypatch.setattr(sheets, "SINGLE", single)
    draw, starts, merged = random.Random(5), [], []
    for sheet in range(40):
        size = draw.choice([12, 40, 9000])
        left, top = draw.randrange(1, size), draw.randrange(1, size)
        starts.append((sheet, left, top, left + draw.randrange(4), top + draw.randrange(4)))
        for _ in range(draw.choice([0, 3, 30])):
            left, top = draw.randrange(1, size), draw.randrange(1, size)
            merged.append((sheet, left, top, left + draw.randrange(max(2, size // 8)), top + draw.randrange(max(2, size // 8))))
    merged += merged[:20] + [(99, 1, 1, 2, 2), (3, None, 1, 2, 2)]
    want = [(s[0], *closed(s[1:], [m[1:] for m in merged if m[0] == s[0] and m[1] is not None])) for s in starts]
    assert expanded(spark, starts, merged) == sorted(want)
    assert expanded(spark, [], merged) == [] and expanded(spark, starts, []) == sorted(starts)


def test_long_chain(spark, monkeypatch):
    """10,000 cells, each reached through the one before, up, down and aside, in few sweeps."""
    sweeps, real = [], sheets._swept
    monkeypatch.setattr(sheets, "_swept", lambda *given: sweeps.append(1) or real(*given))
    start = (1, 2, 30_000, 4, 30_000)
    merged = [(1, 2 + 2 * (k % 2), 30_000 + k, 2 + 2 * (k % 2), 30_001 + k) for k in range(5000)]
    merged += [(1, 2 + 2 * (k % 2), 29_999 - k, 2 + 2 * (k % 2), 30_000 - k) for k in range(5000)]
    merged += [(1, 4 + k, 35_000 + 2 * (k % 2), 5 + k, 35_000 + 2 * (k % 2)) for k in range(100)] + [(1, 2, 40_000, 3, 40_001)]
    assert expanded(spark, [start], merged) == [(1, *closed(start[1:], [m[1:] for m in sorted(merged, key=lambda m: abs(m[2] - 30_000))]))]
    assert len(sweeps) <= 6
