"""Ordered computations that do not put a whole key group into one task.

A plain ``sum() OVER (PARTITION BY matter ORDER BY seq)`` sorts all rows of a matter in one
task. When one matter holds a large share of the table that task never ends. The functions
here split a group into *order-preserving chunks*, work inside the chunks in parallel and
combine the chunk totals, which are few. Groups of at most ``CHUNK`` rows, which are nearly
all, stay whole: there a plain window is cheaper than totals, their joins and their files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.session import cut_lineage

CHUNK = 65_536
"""Rows per chunk when rows carry a dense position."""


def chunk_of(position: Column | str, size: int = CHUNK) -> Column:
    """Chunk number of a dense 1-based position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor((column - 1) / F.lit(size)).cast("long")


def large_groups(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame | None:
    """Keys of the groups of more than ``size`` rows, at most one for each ``size`` rows; None where there is none."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0]
    return None if most is None or most <= size else cut_lineage(sizes.filter(F.col("_n") > size).select(*keys))


def by_size(df: DataFrame, keys: Sequence[str], large: DataFrame, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(rows, chunked)`` for the rows of other and of ``large`` groups; a null key counts like any other."""
    names = {k: f"__large_{k}" for k in keys}
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    large = large.select(*[F.col(k).alias(n) for k, n in names.items()])
    # kept: no join is planned above a union whose parts may still change their partitions
    return cut_lineage(work(df.join(large, same, "left_anti"), False).unionByName(work(df.join(large, same, "left_semi"), True)))


def join_null_safe(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on ``columns`` in which null equals null."""
    names = {c: f"__other_{c}" for c in columns}
    other = other.select(*[F.col(c).alias(names.get(c, c)) for c in other.columns])
    return df.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])).drop(*names.values())


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column | str,
    out: str,
    levels: Sequence[str] = (),
    exclusive: bool = False,
) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order``.

    ``levels`` names columns, coarse to fine, each of which never decreases along ``order``
    inside a key group. In groups of more than ``CHUNK`` rows, rows are summed inside (keys, levels)
    first; the totals of the finest level are summed the same way over the remaining levels and joined back.
    """
    keys, levels = list(keys), list(levels)
    if levels:
        large = large_groups(df, keys, CHUNK)
        if large is None:
            levels = []
        elif keys:
            return by_size(df, keys, large, lambda rows, chunked: _running_sum(rows, keys, order, value, out, levels if chunked else [], exclusive))
    return _running_sum(df, keys, order, value, out, levels, exclusive)


def _running_sum(
    df: DataFrame, keys: list[str], order: Sequence[str], value: Column | str, out: str, levels: list[str], exclusive: bool
) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("__value", value)
    local = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__local", F.sum("__value").over(local))
    if levels:
        # few rows; kept, so that plans built on this one do not multiply
        totals = cut_lineage(df.groupBy(*keys, *levels).agg(F.sum("__value").alias("_total")))
        offsets = running_sum(totals, keys, levels[-1:], "_total", "__base", levels[:-1], exclusive=True)
        offsets = offsets.select(*keys, *levels, "__base")
        summed = join_null_safe(summed, offsets, [*keys, *levels])
    else:
        summed = summed.withColumn("__base", F.lit(0))
    result = F.col("__local") + F.col("__base")
    if exclusive:
        result = result - F.col("__value")
    kept = [c for c in summed.columns if c not in ("__value", "__local", "__base", out)]
    return summed.select(*kept, result.alias(out))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, levels: Sequence[str] = ()
) -> DataFrame:
    """Dense 1-based position of each row in its key group (a total ``order`` is required)."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, levels)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str, out: str, levels: Sequence[str] = ()
) -> DataFrame:
    """Largest ``value`` of the rows *before* each row; null where there is none. Levels as in ``running_sum``."""
    keys, levels = list(keys), list(levels)
    if levels:
        large = large_groups(df, keys, CHUNK)
        if large is None:
            levels = []
        elif keys:
            return by_size(df, keys, large, lambda rows, chunked: _running_max(rows, keys, order, value, out, levels if chunked else []))
    return _running_max(df, keys, order, value, out, levels)


def _running_max(df: DataFrame, keys: list[str], order: Sequence[str], value: Column | str, out: str, levels: list[str]) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("__value", value)
    local = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__local", F.max("__value").over(local))
    if levels:
        peaks = cut_lineage(df.groupBy(*keys, *levels).agg(F.max("__value").alias("_peak")))
        earlier = running_max(peaks, keys, levels[-1:], "_peak", "__base", levels[:-1]).select(*keys, *levels, "__base")
        rows = join_null_safe(rows, earlier, [*keys, *levels])
    else:
        rows = rows.withColumn("__base", F.lit(None))
    kept = [c for c in rows.columns if c not in ("__value", "__local", "__base", out)]
    return rows.select(*kept, F.greatest("__local", "__base").alias(out))


def neighbours(
    df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], size: int = CHUNK
) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>`` for rows with a dense 1-based ``position``.

    Border rows of a chunk are repeated in the chunk next to it, so that one shuffle on
    (keys, chunk) serves every chunk without looking at the whole group.
    """
    keys = list(keys)
    position_col = F.col(position)
    home = chunk_of(position_col, size)
    first, last = (position_col - 1) % size == 0, position_col % size == 0
    copies = F.array(
        F.struct(home.alias("chunk"), F.lit(True).alias("own")),
        F.when(first & (home > 0), F.struct((home - 1).alias("chunk"), F.lit(False).alias("own"))),
        F.when(last, F.struct((home + 1).alias("chunk"), F.lit(False).alias("own"))),
    )
    spread = df.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    spread = spread.withColumn("_chunk", F.col("_copy.chunk")).withColumn("_own", F.col("_copy.own"))
    window = Window.partitionBy(*keys, "_chunk").orderBy(position)
    for name in columns:
        spread = spread.withColumn(f"prev_{name}", F.lag(name).over(window))
        spread = spread.withColumn(f"next_{name}", F.lead(name).over(window))
    return spread.filter("_own").drop("_copy", "_chunk", "_own")


def cluster_sorted(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Rows of a key group in one partition, next to each other and in order, for ``mapInPandas``.

    The shuffle is on a hash of the keys: a plain ``repartition(keys)`` above a join on the
    same keys is dropped as redundant, and adaptive execution may then change that join so
    that the groups are split.
    """
    hashed = df.withColumn("__group", F.xxhash64(*keys)).repartition("__group")
    return hashed.sortWithinPartitions("__group", *keys, *order)


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key group, the first in ``order``: a partial aggregate, not a sort."""
    rest = [c for c in columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
