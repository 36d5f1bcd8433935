"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed set of reference fingerprints (pivots): all zeros, one
mask per segment of ``SEGMENT`` bits, and some random ones. The segment distances, taken relative to the zero pivot, are
coordinates of which a pair that differs in ``bits`` places changes at most ``bits``. So of ``groups`` coordinate groups
at least ``groups - bits`` agree: fingerprints meet in tables keyed by so many whole groups. By the triangle inequality
no distance of a linked pair differs by more than ``bits``; pairs are discarded by their largest difference over all
pivots and the survivors compared bit by bit.

A table cell with many fingerprints (a family of near copies) is not compared pair by pair. Two fingerprints differ in
two bits or less exactly if some point lies within one bit of both, so each crowded fingerprint hands in its 65 points
and those that share a point are linked to the smallest of them: exact, and linear in the family.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import components, cut
from casefile.llm.jaccard import shingle_hashes, similar_groups

SEGMENT = 2
CROWD = 64
"""Fingerprints of a table cell up to which it is compared pair by pair."""


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(extra: int = 15, seed: int = 7) -> list[int]:
    """The zero fingerprint, one mask per segment, and ``extra`` random fingerprints."""
    draw = random.Random(seed)
    masks = [((1 << SEGMENT) - 1) << i for i in range(0, 64, SEGMENT)]
    return [signed(x) for x in [0, *masks, *(draw.getrandbits(64) for _ in range(extra))]]


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the UTF-8 text: word shingles, repeats included, XXH64 with seed 42. No words: zero.

    Works through the hashes in chunks, so a text of any length needs the memory of its words only.
    """
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (``keep`` columns, fingerprint long). Null and blank texts have the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(len(keep)).cast(pa.large_binary())
            found = pa.array([fingerprint(t.as_py() or b"", words) for t in body], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "fingerprint"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "fingerprint bigint"])
    return source.mapInArrow(run, schema)


def distance_table(prints: DataFrame, references: list[int]) -> DataFrame:
    """Adds ``distances``: the Hamming distance of ``fingerprint`` to each reference, in order."""
    each = [F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(p))).cast("tinyint") for p in references]
    return prints.withColumn("distances", F.array(*each))


def cells(table: DataFrame, bits: int, groups: int) -> DataFrame:
    """Rows (cell, fingerprint, distances), one per fingerprint and table."""
    segments = 64 // SEGMENT
    own = lambda i: F.get("distances", F.lit(0)) - F.get("distances", F.lit(i + 1))  # noqa: E731  follows the bits of segment i only
    parts = [[own(i).cast("tinyint") for i in range(segments) if i % groups == g] for g in range(groups)]
    keys = [F.xxhash64(F.lit(k), *[c for g in chosen for c in parts[g]]) for k, chosen in enumerate(combinations(range(groups), groups - bits))]
    return table.select("fingerprint", "distances", F.explode(F.array(*keys)).alias("cell"))


def links(prints: DataFrame, bits: int = 2, groups: int = 5) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that span the same groups as all pairs within ``bits`` (at most 2) do.

    Pairs of cells with at most ``CROWD`` members are all there; crowded ones are linked through shared points.
    """
    if not 0 <= bits <= 2 < groups:
        raise ValueError("bits is 0, 1 or 2, and groups larger")
    # dealt anew: the distinct fingerprints are small, their cells are not
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = distance_table(prints.select("fingerprint").filter("fingerprint is not null").distinct().repartition(parts, "fingerprint"), pivots())
    spread = cells(table, bits, groups)
    sizes = cut(spread.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1"))
    shared = cut(spread.join(sizes, "cell"))
    few = shared.filter(F.col("size") <= CROWD)
    left, right = few.select("cell", F.col("fingerprint").alias("a"), F.col("distances").alias("da")), few.select("cell", F.col("fingerprint").alias("b"), F.col("distances").alias("db"))
    apart = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = left.join(right, "cell").filter(F.col("a") < F.col("b")).filter(apart <= bits).filter(near).select("a", "b")
    crowded = shared.filter(F.col("size") > CROWD).select("fingerprint").distinct()
    return pairs.union(through_points(crowded, bits)).distinct()


def through_points(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``bits`` of each other, through the points they share."""
    flips = [1 << i for i in range(64)] if bits == 2 else []
    own = F.col("fingerprint")
    points = F.array(own, *[own.bitwiseXOR(F.lit(signed(x))) for x in flips])
    each = prints.select(own, F.explode(points).alias("point"))
    if bits == 1:  # neighbours by one flip: the upper end is the point
        upper = F.array(own, *[own.bitwiseOR(F.lit(signed(1 << i))) for i in range(64)])
        each = prints.select(own, F.explode(F.array_distinct(upper)).alias("point"))
        each = each.join(prints.select(own.alias("point")), "point", "left_semi")
    least = each.groupBy("point").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return each.join(least, "point").filter("fingerprint <> a").select("a", F.col("fingerprint").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, groups: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document (``keep`` columns, fingerprint long, component_id, links, root). ``root`` is the component's smallest fingerprint.

    Two documents are linked if their fingerprints differ in at most ``bits`` bits; ``component_id`` is the smallest
    doc_id that can be reached, ``links`` the number of other documents with the same fingerprint plus the kept links to
    other fingerprints. Rows with a null doc_id take part; a component of such rows only has a null id. Repeated rows stay
    rows. Copies share a fingerprint and never meet pair by pair.
    """
    rows = cut(fingerprints(docs, words, keep=keep))
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    joined = cut(links(distinct, bits, groups))
    grouped = components(joined).withColumnRenamed("node", "fingerprint")
    degree = joined.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("others"))
    named = distinct.join(grouped, "fingerprint", "left").join(degree, "fingerprint", "left")
    named = cut(named.select("fingerprint", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "fingerprint").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fingerprint", "component_id", "links", "root")
    return rows.join(named, "fingerprint").select(*keep, "fingerprint", "component_id", "links", "root")


def near_groups(docs: DataFrame, words: int, bits: int, similarity: float) -> DataFrame:
    """Rows (doc_id, _hash, root), one per row of ``docs`` (doc_id, _hash, text); the rows of a group share ``root``.

    Groups are connected by both kinds of links: fingerprints that differ in ``bits`` or less, met in the tables, and
    shingle sets of a Jaccard ``similarity`` or more, see ``jaccard``. Each kind's groups are nodes here, and a text links
    the two that it is in.
    """
    prints = near_duplicates(docs, words, bits, keep=("doc_id", "_hash")).select("doc_id", "_hash", F.xxhash64(F.lit("print"), "root").alias("a"))
    sets = similar_groups(docs, words, similarity).select(F.col("doc_id").alias("_d"), F.col("_hash").alias("_t"), F.xxhash64(F.lit("set"), "root").alias("b"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t"))
    both = cut(prints.join(sets.distinct(), same).select("doc_id", "_hash", "a", "b"))
    group = components(both.select("a", "b").distinct())
    return both.join(group, F.col("a") == F.col("node")).select("doc_id", "_hash", F.col("component").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """One row of each group of near duplicates: the smallest by (doc_id, text hash), a null doc_id last; all columns.

    Near duplicates have fingerprints of word shingles that differ in ``bits`` or less, or a Jaccard similarity of
    ``similarity`` or more: texts so similar differ in about ten bits, too many for tables of agreeing groups.
    Texts meet the table of chosen rows only; of a chosen row that is there more than once one copy stays.
    """
    rows = near_groups(docs.withColumn("_hash", F.xxhash64("text")).select("doc_id", "_hash", "text"), words, bits, similarity)
    each = rows.groupBy("root", "doc_id", "_hash").agg(F.count("*").alias("n"))
    chosen = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "n")).alias("c"))
    chosen = cut(chosen.select(F.col("c.doc_id").alias("_d"), F.col("c._hash").alias("_t"), "c.n"))
    same = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t"))
    once = docs.join(chosen.filter("n = 1"), same, "left_semi")
    more = docs.join(chosen.filter("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(more)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
