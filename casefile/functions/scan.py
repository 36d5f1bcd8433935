"""Associative scan over step functions: what a long ordered fold does, chunk by chunk in parallel.

A chunk of rows is condensed to a function of the fill it is entered with. Such functions compose, and composition is
associative, so the entries of all chunks follow from an up-sweep (``FAN`` neighbours become one function, level by
level) and a down-sweep (an entry is handed to the ``FAN`` children of a node). No group has more than ``FAN`` functions.

A function is a row: ``upto``, ``opened``, ``fill`` (its steps, see ``evaluate``), and ``whole_count``, ``whole_fill``,
its result where nothing is open yet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.session import cut_lineage

FAN = 64
STEPS = "upto array<double>, opened array<long>, fill array<double>, whole_count long, whole_fill double"


def evaluate(step, fill: float | None) -> tuple[int, float]:
    """(containers opened, fill at the end) for a fill on entry; None: no container is open.

    Up to ``upto[0]`` everything fits: ``fill[0]`` is added. Beyond, piece i holds up to ``upto[i]`` and its result does
    not depend on the entry.
    """
    if fill is None or fill != fill:
        return int(step.whole_count), float(step.whole_fill)
    i = min(int(np.searchsorted(np.asarray(step.upto), fill, side="left")), len(step.upto) - 1)
    return (0, fill + float(step.fill[0])) if i == 0 else (int(step.opened[i]), float(step.fill[i]))


def shortened(upto: list[float], opened: list[int], fill: list[float]) -> dict[str, list]:
    """Pieces that no fill reaches (fills are not negative) left out, neighbours of one result joined."""
    rows = [(upto[0], 0, fill[0])]
    for u, n, f in zip(upto[1:], opened[1:], fill[1:]):
        if u <= rows[-1][0] or u < 0:
            continue
        if len(rows) > 1 and rows[-1][1:] == (n, f):
            rows[-1] = (u, n, f)
        else:
            rows.append((u, n, f))
    return {"upto": [r[0] for r in rows], "opened": [int(r[1]) for r in rows], "fill": [float(r[2]) for r in rows]}


def composed(first, second) -> dict:
    """``second`` after ``first``, with as few pieces as they need."""
    added = float(first.fill[0])
    through = min(float(first.upto[0]), float(second.upto[0]) - added)
    upto, opened, fill = [through], [0], [added + float(second.fill[0])]
    for u, n, f in zip(second.upto[1:], second.opened[1:], second.fill[1:]):  # all of the first chunk fits
        upto.append(min(float(u) - added, float(first.upto[0])))
        opened.append(int(n))
        fill.append(float(f))
    for u, n, f in zip(first.upto[1:], first.opened[1:], first.fill[1:]):
        more, end = evaluate(second, float(f))
        upto.append(float(u))
        opened.append(int(n) + more)
        fill.append(end)
    more, end = evaluate(second, float(first.whole_fill))
    return shortened(upto, opened, fill) | {"whole_count": int(first.whole_count) + more, "whole_fill": end}


def entries(steps: DataFrame, keys: Sequence[str], node: str, fan: int = FAN) -> DataFrame:
    """Rows (keys, ``node``, entered, before): the fill each chunk is entered with (null: nothing open) and the containers opened by then.

    ``steps`` has one function per chunk, numbered by ``node`` from 0 without gaps in each key group.
    """
    keys = list(keys)
    types = dict(steps.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    level = cut_lineage(steps.select(*keys, F.col(node).cast("long").alias("_node"), "upto", "opened", "fill", "whole_count", "whole_fill"))
    last = level.agg(F.max("_node")).first()[0]
    if last is None:
        return level.select(*keys, F.col("_node").alias(node), F.lit(None).cast("double").alias("entered"), F.lit(0).cast("long").alias("before"))
    levels = [level]

    def join_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(frame.sort_values("_node").itertuples(index=False))
        out = rows[0]._asdict()
        for row in rows[1:]:
            out = composed(pd.Series(out), row)
        return pd.DataFrame([{**dict(zip(keys, key)), "_node": key[-1], **{c: out[c] for c in ("upto", "opened", "fill", "whole_count", "whole_fill")}}])

    def hand_down(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = list(frame.sort_values("_node").itertuples(index=False))
        fill, before, out = ordered[0].entered, int(ordered[0].before), []
        for row in ordered:
            out.append((*key[:-1], row[len(keys)], fill, before))  # the node stands behind the keys
            more, fill = evaluate(row, fill)
            before += more
        return pd.DataFrame(out, columns=[*keys, "_node", "entered", "before"])

    while last >= fan:
        last //= fan
        up = levels[-1].withColumn("_up", F.floor(F.col("_node") / fan).cast("long"))
        levels.append(cut_lineage(up.groupBy(*keys, "_up").applyInPandas(join_up, f"{named}, _node long, {STEPS}")))
    roots = levels[-1].select(*keys).distinct()
    known = roots.select(*keys, F.lit(0).cast("long").alias("_up"), F.lit(None).cast("double").alias("entered"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels):
        below = level.withColumn("_up", F.floor(F.col("_node") / fan).cast("long")).join(known, [*keys, "_up"])
        columns = [*keys, "_node", "upto", "opened", "fill", "whole_count", "whole_fill", "entered", "before", "_up"]
        handed = below.select(*columns).groupBy(*keys, "_up").applyInPandas(hand_down, f"{named}, _node long, entered double, before long")
        known = handed.withColumnRenamed("_node", "_up")
        if level is not levels[0]:
            known = cut_lineage(known)
    return known.withColumnRenamed("_up", node)
