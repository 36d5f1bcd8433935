"""Next-fit packing by a scan over chunks, against one loop over the rows."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from casefile.functions import scan
from casefile.operators import planning
from casefile.operators.planning import _transfer


def slow(weights, capacity):
    out, number, fill = [], 0, None
    for first, later in weights:
        if fill is None or fill + later > capacity + 1e-9:
            number, fill = number + 1, first
        else:
            fill += later
        out.append(number)
    return out


def condensed(weights, capacity):
    return _transfer(pd.DataFrame(weights, columns=["opening", "added"]), capacity).iloc[0]


@pytest.mark.parametrize("seed", range(12))
def test_composition(seed):
    """Composed functions equal that of the joined chunk, wherever it is entered."""
    draw = random.Random(seed)
    capacity = draw.choice([10, 25, 60])
    parts = [[(draw.randrange(1, 40 if draw.random() < 0.1 else 9), draw.randrange(1, 9)) for _ in range(draw.randrange(1, 30))] for _ in range(4)]
    got, whole = condensed(parts[0], capacity), list(parts[0])
    for part in parts[1:]:
        got, whole = pd.Series(scan.composed(got, condensed(part, capacity))), whole + part
        want = condensed(whole, capacity)
        for fill in [None, *[x / 2 for x in range(0, 2 * capacity + 80)]]:
            assert scan.evaluate(got, fill) == scan.evaluate(want, fill)
        assert len(got["upto"]) <= 2 * len(want["upto"]) + 1


def test_associative():
    draw = random.Random(99)
    a, b, c = ([condensed([(draw.randrange(1, 8),) * 2 for _ in range(20)], 30)] for _ in range(3))
    left = scan.composed(pd.Series(scan.composed(a[0], b[0])), c[0])
    right = scan.composed(a[0], pd.Series(scan.composed(b[0], c[0])))
    assert [scan.evaluate(pd.Series(left), x / 4) for x in range(160)] == [scan.evaluate(pd.Series(right), x / 4) for x in range(160)]


@pytest.mark.parametrize("fan", [2, 64])
def test_levels(spark, fan):
    """One matter with thousands of chunks beside small ones: several levels of functions, none of them long."""
    draw = random.Random(1)
    matters = {1: 6000, 2: 1, 3: 64, 4: 129}
    weights = {m: [(draw.randrange(1, 30), draw.randrange(1, 12)) for _ in range(n)] for m, n in matters.items()}
    rows = [(m, i + 1, *w) for m, ws in weights.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "m long, position long, first long, later long").repartition(5)
    size = 4 if fan == 64 else 100
    got = planning.next_fit(df, ["m"], "position", "first", "later", 40, size=size, fan=fan).collect()
    assert len(got) == len(rows)
    for m, ws in weights.items():
        assert [r.container for r in sorted((r for r in got if r.m == m), key=lambda r: r.position)] == slow(ws, 40)


def test_capacity_of_each_key(spark):
    df = spark.createDataFrame([(m, i, 3) for m in (1, 2) for i in range(1, 41)], "m long, position long, w long")
    df = df.selectExpr("*", "CASE m WHEN 1 THEN 6 ELSE 10 END AS room")
    got = planning.next_fit(df, ["m"], "position", "w", "w", "room", size=7)
    assert {(r.m, r.n) for r in got.groupBy("m").agg({"container": "max"}).toDF("m", "n").collect()} == {(1, 20), (2, 14)}


def test_pieces_are_few():
    """As many as the first container has items at most, whatever the length of the chunk."""
    draw = random.Random(3)
    step = condensed([(draw.randrange(1, 6),) * 2 for _ in range(20_000)], 50)
    assert len(step["upto"]) <= 51


def planned(spark, pages, height, page_height, **options):
    """``converged_plan`` of one matter with unheaded exhibits of so many pages."""
    items = spark.createDataFrame([(1, i + 1, f"e{i + 1}", n, 0, n) for i, n in enumerate(pages)], "m long, position long, item_id string, physical_pages int, optional_pages int, content_pages int")
    nodes = spark.createDataFrame([(1, i + 1, None, None, None, f"e{i + 1}") for i in range(len(pages))], "m long, pos long, section_id string, heading string, inner_pos long, exhibit_id string")
    details = items.selectExpr("m", "item_id", "position AS exhibit_number", "'letter' AS description", "'1 May 2020' AS date_text")
    plan, problems = planning.converged_plan(items, nodes, details, ["m"], height, page_height, **options)
    return sorted(map(tuple, plan.select("item_id", "volume", "index_pages", "passes").collect())), [r.problem for r in problems.collect()]


def test_converged(spark):
    """Eight rows of 30 on pages of 100 are three pages; volumes are planned around these."""
    from pyspark.sql import functions as F

    plan, problems = planned(spark, [2] * 8, F.lit(30.0), 100.0, page_limit=10)
    assert problems == [] and plan == [(f"e{i + 1}", i // 3 + 1, 3, 2) for i in range(8)]
    assert planned(spark, [2] * 8, F.lit(30.0), 1000.0, page_limit=10)[0] == [(f"e{i + 1}", i // 4 + 1, 1, 1) for i in range(8)]


def test_not_converged(spark):
    """Labels of several volumes take no room and those of one take much: the count swings. A row above the page never fits."""
    from pyspark.sql import functions as F

    swing = F.when(F.col("page_label").startswith("Vol."), 10.0).otherwise(60.0)
    assert planned(spark, [1] * 4, swing, 100.0, page_limit=7) == ([], [planning.NOT_STABLE])
    assert planned(spark, [1] * 4, swing, 100.0, page_limit=7, passes=1) == ([], [planning.TOO_MANY_PASSES])
    assert planned(spark, [1] * 4, F.lit(130.0), 100.0, page_limit=9) == ([], ["ROW_TOO_TALL"])
