"""Messages given as parent links."""

from __future__ import annotations

from casefile.operators import attachments


def found(spark, rows):
    frame = spark.createDataFrame(rows, "m int, message_id int, parent_id int, place int")
    return {(r.m, r.message_id): (r.ordinal, r.depth, r.issue) for r in attachments.message_ordinals(frame, ["m"]).collect()}


def test_deep_chain(spark):
    """Depth 1,000 in about ten rounds, beside a second one in another group."""
    got = found(spark, [(1, i, i - 1 if i else None, i % 9 + 1) for i in range(1000)] + [(2, i, i + 1 if i < 4 else None, i) for i in range(5)])
    for i in (0, 1, 500, 999):
        assert got[1, i] == (".".join(str(j % 9 + 1) for j in range(i + 1)), i + 1, None)
    assert got[2, 0] == ("4.3.2.1.0", 5, None) and len(got) == 1005


def test_odd_links(spark):
    """Circles, what hangs on them, unknown parents, an id twice, no rows."""
    links = [(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 3), (7, 99), (8, 7), (9, 9), (10, 2), (11, 1), (11, 2), (12, 11)]
    got = found(spark, [(1, m, p, 1) for m, p in links])
    good = {1: ("1", 1, None), 2: ("1.1", 2, None), 10: ("1.1.1", 3, None)}
    issue = {3: attachments.CIRCLE, 7: attachments.LOST, 8: attachments.LOST, 11: attachments.TWICE, 12: attachments.LOST}
    assert got == {(1, m): good.get(m, (None, None, issue.get(m, attachments.CIRCLE))) for m, _ in links}
    assert found(spark, []) == {}
