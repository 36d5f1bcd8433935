"""Near duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets verify them.

Texts with the same set of shingles are one from the start. Every set gets as many bands of ``ROWS`` hashes as make a
pair of the asked similarity meet in none with a probability below ``miss``; more similar pairs are missed more rarely.
Candidates are compared by all their shingles, so no pair below the similarity is linked.

The members of a cell (sets that agree in a band) first meet its smallest set. Members that are connected with it need
not meet each other; the others meet the whole cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import components, cut, stored

ROWS = 5
CHUNK = 1 << 16
BLOCK = 1 << 10
"""Hashes that meet all hash functions at once."""
BROADCAST_ROWS = 2_000_000


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, repeats included, in chunks; a shorter text is one shingle."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype="<u8")


def set_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 1)).view(np.int64))


def bands(similarity: float, miss: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of ``count`` hash functions, as columns."""
    draw = np.random.Generator(np.random.PCG64(11))
    return draw.integers(0, 1 << 64, (count, 1), dtype=np.uint64), draw.integers(0, 1 << 64, (count, 1), dtype=np.uint64) | np.uint64(1)


def signature(found: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> list[int]:
    """One hash per band of ``ROWS`` least values; none for an empty set."""
    if not len(found):
        return []
    least = np.full(len(masks), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK] ^ masks) * factors).min(axis=1), out=least)
    each = [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, len(least), ROWS)]
    return np.array(each, dtype=np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int, similarity: float, miss: float) -> DataFrame:
    """Rows (doc_id, _hash, key, size, bands); ``key`` stands for the set of shingles, ``size`` counts it."""
    count = bands(similarity, miss) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, factors = functions(count)
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", words) for t in batch.column(2).cast(pa.large_binary())]
            added = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, masks, factors) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], names=["doc_id", "_hash", "key", "size", "bands"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, _hash bigint, key bigint, size bigint, bands array<bigint>"
    return docs.select("doc_id", "_hash", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the sets ``wanted`` (doc_id, _hash): 8 bytes a shingle, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", words) for t in batch.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    places = wanted.select(F.col("doc_id").alias("_d"), F.col("_hash").alias("_t"))
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    found = docs.join(places, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["_hash"] == F.col("_t")), "left_semi")
    return found.select("text").mapInArrow(run, "key bigint, shingles binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    df = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("_b")), "b")
    return df.select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, distinct: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of keys that connect what all similar pairs that meet in a cell would."""
    spread = distinct.select("key", "size", F.explode("bands").alias("cell"))
    reps = spread.groupBy("cell").agg(F.count("*").alias("members"), F.min(F.struct("key", "size")).alias("rep")).filter("members > 1")
    shared = stored(spread.join(reps, "cell").select("cell", "members", "rep", "key", "size"), "cells")
    sets = stored(shingle_sets(docs, distinct.join(shared.select("key").distinct(), "key", "left_semi"), words), "sets")
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9
    with_rep = shared.filter(F.col("key") != F.col("rep.key")).filter(near(F.col("size"), F.col("rep.size")))
    tried = stored(with_rep.select(F.col("rep.key").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    first = stored(verified(tried, sets, similarity), "links")
    group = components(first)
    of = lambda key, name: group.select(F.col("node").alias(key), F.col("component").alias(name))
    crowd = shared.filter("members > 2").select("cell", "key", "size", F.col("rep.key").alias("_rep"))
    crowd = crowd.join(of("key", "_g"), "key", "left").join(of("_rep", "_h"), "_rep", "left")
    crowd = stored(crowd.select("cell", "key", "size", "_rep", F.coalesce("_g", "key").alias("_g"), F.coalesce("_h", "_rep").alias("_h")), "crowd")
    loose = crowd.filter("_g <> _h").select("cell", F.col("key").alias("_k"), F.col("size").alias("_s"), F.col("_g").alias("_o"))
    met = loose.join(crowd.filter("key <> _rep"), "cell").filter("_g <> _o").filter(near(F.col("size"), F.col("_s")))
    met = met.select(F.least("key", "_k").alias("a"), F.greatest("key", "_k").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return first.union(verified(met, sets, similarity))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """Rows (doc_id, _hash, root), one per row of ``docs`` (doc_id, _hash, text); the rows of a group share ``root``.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of ``similarity`` or more. Null and
    blank texts have no shingle and are one group.
    """
    rows = stored(sketches(docs, words, similarity, miss), "sketches")
    each = F.min_by(F.struct("doc_id", "_hash", "size", "bands"), F.struct("doc_id", "_hash"))
    distinct = stored(rows.groupBy("key").agg(each.alias("c")).select("key", "c.*"), "distinct")
    root = components(links(docs, distinct, words, similarity)).withColumnRenamed("node", "key")
    named = rows.select("doc_id", "_hash", "key").join(root, "key", "left")
    return cut(named.select("doc_id", "_hash", F.coalesce("component", "key").alias("root")))
