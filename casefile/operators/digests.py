"""Digest trees over the rows of a matter: equal for equal rows, and telling which rows differ.

Rows are placed by a hash of their identifier, two hexadecimal digits a level, so no matter is sorted or put into one
task: a leaf holds the few rows whose hashes share the first digits, and every other node at most 256 children. A changed
row changes the digests on its path only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from casefile.session import cut_lineage

STEP = 2
"""Hexadecimal digits a level."""
DEPTH = 2
"""Levels below the root: 65,536 leaves, so a leaf of a matter with five million rows has some eighty."""


def _ordered(value: Column, kind: DataType) -> Column:
    """The value with fields of structs by name and entries of maps by key, at any depth."""
    if isinstance(kind, StructType):
        fields = [_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    return value


def canonical(df: DataFrame, leave_out: list[str]) -> Column:
    """A row as JSON text, its fields by name; null fields are left out, and so are the columns ``leave_out``."""
    fields = sorted((f for f in df.schema.fields if f.name not in leave_out), key=lambda f: f.name)
    return F.to_json(F.struct(*[_ordered(df[f.name], f.dataType).alias(f.name) for f in fields]))


def _path(row_id: str, depth: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(row_id).cast("string"), F.lit("\u0000")), 256), 1, STEP * depth)


def digest_tree(rows: DataFrame, keys: list[str], row_id: str, depth: int = DEPTH) -> DataFrame:
    """Nodes (keys, path, rows, digest) of each matter's tree; the root has the empty path.

    All columns count. A leaf is the digest of its rows' digests in order, so equal rows count each; another node is that
    of its children's paths and digests in path order. A matter without rows has no nodes.
    """
    leaves = rows.select(*keys, _path(row_id, depth).alias("path"), F.sha2(canonical(rows, keys), 256).alias("_d"))
    joined = F.array_join(F.array_sort(F.collect_list("_d")), ",")
    level = cut_lineage(leaves.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("rows"), F.sha2(joined, 256).alias("digest")))
    levels = [level]
    for up in range(depth - 1, -1, -1):
        child = F.concat_ws(":", "path", "digest").alias("_c")  # paths are of one length: this is their order
        rise = level.select(*keys, F.substring("path", 1, STEP * up).alias("path"), "rows", child)
        joined = F.array_join(F.array_sort(F.collect_list("_c")), ",")  # at most 256
        level = rise.groupBy(*keys, "path").agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


def roots(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and digest of each matter."""
    return tree.filter("path = ''").select(*keys, "rows", "digest")


def root_pairs(prev_tree: DataFrame, cur_tree: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, previous, current): root digests of two builds, as ``compare_builds`` takes them."""
    left = roots(prev_tree, keys).select(*keys, F.col("digest").alias("previous"))
    return left.join(roots(cur_tree, keys).select(*keys, F.col("digest").alias("current")), keys, "full")


def changed_leaves(prev_tree: DataFrame, cur_tree: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """(keys, path) of the leaves that differ, from the roots down: below equal nodes nothing is compared."""
    found = None
    for level in range(depth + 1):
        here = F.length("path") == STEP * level
        left, right = prev_tree.filter(here), cur_tree.filter(here)
        if found is not None:
            above = found.withColumnRenamed("path", "_up")
            left, right = (t.withColumn("_up", F.substring("path", 1, STEP * (level - 1))).join(above, [*keys, "_up"], "left_semi") for t in (left, right))
        left = left.select(*keys, "path", F.col("digest").alias("_p"))
        right = right.select(*keys, "path", F.col("digest").alias("_c"))
        found = cut_lineage(left.join(right, [*keys, "path"], "full").filter("NOT (_p <=> _c)").select(*keys, "path"))
    return found


def changed_rows(
    prev: DataFrame, cur: DataFrame, keys: list[str], row_id: str, prev_tree: DataFrame, cur_tree: DataFrame, depth: int = DEPTH
) -> DataFrame:
    """(keys, row_id, change) of the rows that were ``added``, ``removed`` or ``changed``. Only rows of leaves that differ
    are compared. ``row_id`` is unique in a matter and not null."""
    leaves = changed_leaves(prev_tree, cur_tree, keys, depth)

    def of(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(*keys, row_id, canonical(rows, keys).alias(name)).withColumn("path", _path(row_id, depth))
        return rows.join(leaves, [*keys, "path"], "left_semi").drop("path")

    both = of(prev, "_p").join(of(cur, "_c"), [*keys, row_id], "full").filter("NOT (_p <=> _c)")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").otherwise("changed")
    return both.select(*keys, row_id, change.alias("change"))
