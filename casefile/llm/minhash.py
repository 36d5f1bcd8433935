"""Near duplicates by an inverted join over MinHash signature coordinates.

Every distinct set of word shingles gets a signature of ``COORDINATES`` minima. Under each (coordinate, value) pair stands
a posting list of the sets that have it; the collisions of two sets, the lists they share, estimate their Jaccard
similarity. Pairs with at least ``least_matches`` collisions go on to an exact comparison of the whole sets. The threshold
is so low that a pair at the asked similarity misses it with a probability below ``miss``.

* Prefix: lists are ordered from rare to frequent. Two sets with m collisions of K share one of their K - m + 1 rarest
  lists, so only those are merged; lists of one set end at the first count.
* Skip: the m - 1 most frequent lists of a set, where the crowds are, are never merged. Their collisions are counted by
  probing the two signatures of a pair that has met.

A posting list is not merged pair by pair. Each set first meets the one that heads most of its lists, the centre of a
family of copies. Sets that are connected by then need not meet each other, and only the others meet their lists. In long
lists these meet where they share one of their rarest shingles with enough of both left behind it, as similar sets must:
copies that differ from the centre each in its own way have many shingles of their own, and no pair of them is formed.
There, too, sets first meet a few, the ``HEADS`` of each shingle's list that have the least before it; groups are formed
anew, and only sets that are still apart meet the whole list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.llm.common import components, stored
from casefile.llm.jaccard import shingle_set

COORDINATES = 48
LONG_LIST = 8
"""Members of a posting list above which those still apart meet by their rarest shingles."""
HEADS = 4
"""Members of such a list, those with the least before its shingle, that all others meet before whole lists do."""
BLOCK, CHUNK = 1 << 10, 1 << 16


def least_matches(percent: int, miss: float, coordinates: int = COORDINATES) -> int:
    """The most collisions that a pair of the similarity fails to reach with a probability below ``miss``; 1 at least."""
    s, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * s**m * (1 - s) ** (coordinates - m)
        if below >= miss:
            return max(m, 1)
    return coordinates


def functions() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the hash functions, as columns."""
    draw = np.random.Generator(np.random.PCG64(13))
    size = (COORDINATES, 1)
    return draw.integers(0, 1 << 64, size, dtype=np.uint64), draw.integers(0, 1 << 64, size, dtype=np.uint64) | np.uint64(1)


def signature(found: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Upper halves of the least values of a set (sorted distinct hashes, not empty), one per coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK] ^ masks) * factors).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, _hash, key, size, signature); ``key`` stands for the set of shingles and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, factors = functions()
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column(2).cast(pa.large_binary()):
                found = shingle_set(text.as_py() or b"", words)
                keys.append(int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 3)).view(np.int64)) if len(found) else None)
                sizes.append(len(found))
                signatures.append(signature(found, masks, factors) if len(found) else None)
            added = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], names=["doc_id", "_hash", "key", "size", "signature"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, _hash bigint, key bigint, size bigint, signature array<int>"
    return docs.select("doc_id", "_hash", "text").mapInArrow(run, schema)


def shared_tokens(posted: DataFrame) -> DataFrame:
    """Rows (key, size, token, n): the tokens of ``posted`` (key, size, token) that ``n`` keys have, two at least."""
    return posted.join(posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "token").select("key", "size", "token", "n")


def rarest(shared: DataFrame, total: Column, skip: Column) -> DataFrame:
    """Rows (key, size, weight, token, place): of each key's tokens, from rare to frequent, those shared and not among the last ``skip``.

    Of its ``total`` tokens those of one key come first but meet nothing; ``place`` counts them, ``weight`` adds up the
    frequencies of the others.
    """
    kept = shared.groupBy("key", "size").agg(F.sum("n").alias("weight"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("_t"))  # a set at most
    own = (total - F.size("_t")).alias("_own")
    kept = kept.select("key", "size", "weight", own, F.slice("_t", F.lit(1), F.greatest(F.size("_t") - skip, F.lit(0)).cast("int")).alias("_t"))
    kept = kept.select("key", "size", "weight", "_own", F.posexplode("_t").alias("_at", "_x"))
    return kept.select("key", "size", "weight", F.col("_x.token").alias("token"), (F.col("_own") + F.col("_at")).alias("place"))


def coordinates(sets: DataFrame) -> DataFrame:
    """Rows (key, size, token); a token is coordinate and value in one number."""
    token = F.shiftleft(F.col("_i").cast("long"), 32).bitwiseOR(F.col("_v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return sets.select("key", "size", F.posexplode("signature").alias("_i", "_v")).select("key", "size", token.alias("token"))


def alike(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def colliding(pairs: DataFrame, sets: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide in ``matches`` coordinates or more."""
    of = lambda key, name: sets.select(F.col("key").alias(key), F.col("signature").alias(name))
    same = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(of("a", "_a"), "a").join(of("b", "_b"), "b").filter(same >= matches).select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the sets in ``wanted`` (key, doc_id, _hash): 8 bytes a shingle, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py() or b"", words).tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "shingles"])

    places = wanted.select("key", F.col("doc_id").alias("_d"), F.col("_hash").alias("_t"))
    found = docs.select("doc_id", "_hash", "text").join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")))
    return found.select("key", "text").mapInArrow(run, "key bigint, shingles binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    of = lambda key, name: shingles.select(F.col("key").alias(key), F.col("shingles").alias(name))
    return pairs.join(of("a", "_a"), "a").join(of("b", "_b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint")


def each_shingle(shingles: DataFrame) -> DataFrame:
    """Rows (key, size, token) of (key, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, held in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(held.as_buffer(), dtype="<i8")
                for at in range(0, len(found), CHUNK):
                    part = found[at : at + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key.as_py())), pa.array(np.full(len(part), len(found))), pa.array(part)], names=["key", "size", "token"])

    return shingles.select("key", "shingles").mapInArrow(run, "key bigint, size bigint, token bigint")


def star(shared: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each key with the one that heads most of its lists. A list's head is its member of the greatest weight."""
    weighted = shared.join(prefix.select("key", "weight").distinct(), "key")
    heads = weighted.groupBy("token").agg(F.max(F.struct("weight", "key", "size")).alias("head"))
    votes = weighted.join(heads, "token").filter((F.col("key") != F.col("head.key")) & alike(F.col("size"), F.col("head.size"), percent))
    votes = votes.groupBy("key", F.col("head.key").alias("_h")).agg(F.count("*").alias("n"))
    best = votes.groupBy("key").agg(F.max(F.struct("n", "_h")).alias("c"))
    return best.select(F.least("key", "c._h").alias("a"), F.greatest("key", "c._h").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """Rows (key, _g): the group of each key that ``links`` (a, b) connect."""
    return stored(components(links).select(F.col("node").alias("key"), F.col("component").alias("_g")), "groups")


def parted(cells: DataFrame, group: DataFrame) -> DataFrame:
    """Of ``cells`` (cell, key, ...) those of two connected groups or more, with ``members`` (their number), ``_g`` (the
    group) and ``_apart``: whether the key is outside the cell's largest group, whose members need not meet each other."""
    named = stored(cells.join(group, "key", "left").withColumn("_g", F.coalesce("_g", "key")), "named")
    groups = named.groupBy("cell", "_g").agg(F.count("*").alias("n")).groupBy("cell")
    lists = groups.agg(F.sum("n").alias("members"), F.count("*").alias("groups"), F.max(F.struct("n", "_g")).alias("m")).filter("groups > 1")
    named = named.join(lists.select("cell", "members", F.col("m._g").alias("_most")), "cell")
    return stored(named.withColumn("_apart", F.col("_g") != F.col("_most")).drop("_most"), "members")


def links(docs: DataFrame, sets: DataFrame, words: int, percent: int, matches: int, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs (a, b) of keys that connect what all similar pairs do. ``sets``: (key, size, signature, doc_id, _hash)."""
    shared = stored(shared_tokens(coordinates(sets)), "postings")
    prefix = stored(rarest(shared, F.lit(COORDINATES), F.lit(matches - 1)).drop("place"), "prefixes")

    tried = stored(star(shared, prefix, percent), "pairs")
    met = stored(colliding(tried, sets, matches), "met")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = stored(whole_sets(docs, sets.join(ends(met), "key"), words), "sets")
    first = stored(verified(met, held, percent), "links")

    group = connected(first)
    named = parted(prefix.select("key", "size", F.col("token").alias("cell")), group)

    def met_in(cells: DataFrame, others: DataFrame, near: Column, done: DataFrame) -> DataFrame:
        """Pairs (a, b), each once, of a member apart and one of ``others``, of one cell but not of one group; ``near`` compares them by size and place."""
        loose = cells.filter("_apart").select("cell", *[F.col(c).alias(f"{c}2") for c in ("key", "size", "place", "_g")])
        pairs = loose.join(others, "cell").filter("_g <> _g2").filter(near)
        return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct().join(done, ["a", "b"], "left_anti")

    short = named.filter(F.col("members") <= long_list).withColumn("place", F.lit(0))
    rest = stored(colliding(met_in(short, short, alike(F.col("size"), F.col("size2"), percent), tried), sets, matches), "met")
    crowd = stored(named.filter(F.col("members") > long_list).select("key").distinct(), "crowd")
    more = ends(rest).union(crowd).distinct().join(held.select("key"), "key", "left_anti")
    held = held.union(stored(whole_sets(docs, sets.join(more, "key"), words), "sets"))
    # similar sets share one of their rarest shingles, all but the last ceil(similarity * size) - 1; behind the first that
    # they share there must be enough of both left
    each = shared_tokens(each_shingle(held.join(crowd, "key", "left_semi")))
    rare = rarest(each, F.col("size"), F.ceil(F.col("size") * percent / 100 - 1e-9) - 1)
    rare = stored(rare.select("key", "size", "place", F.col("token").alias("cell")), "rare")
    left = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    enough = left * (100 + percent) >= (F.col("size") + F.col("size2")) * percent
    # first with the members that have the least before the cell's shingle: they connect most of a family
    cells = parted(rare, group)
    order = Window.partitionBy("cell").orderBy(F.col("place") / F.col("size"), "key")
    heads = cells.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= HEADS).drop("_at")
    pairs = stored(rest.union(met_in(cells, heads, enough, tried)).distinct(), "pairs")
    second = stored(first.union(verified(pairs, held, percent)), "links")
    cells = parted(rare, connected(second))
    last = met_in(cells, cells, enough, tried.union(pairs))
    return stored(second.union(verified(last, held, percent)), "links")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, miss: float = 1e-6, long_list: int = LONG_LIST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): (doc_id, n_shingles long, component_id, kept).

    Documents are linked if the Jaccard similarity of their sets of distinct word shingles is ``percent`` / 100 or more,
    compared in whole numbers. A text of fewer words is one shingle, its whole sequence. ``component_id`` is the smallest
    doc_id that can be reached, ``kept`` tells whether it is the row's own.

    Null and blank texts have an empty set and are linked with nothing, so each stands for itself. Copies share a set and
    never meet pair by pair; repeated rows come out alike. A row with a null doc_id takes part; its class takes the
    smallest id there is, and in a class of such rows only ``component_id`` is null and ``kept`` false. Further columns,
    whatever their names, are not looked at. No documents give no rows. Texts are hashed in chunks and their sets held
    as 8 bytes a shingle, one pair of sets at a time.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    matches = least_matches(percent, miss)
    rows = stored(sketches(docs, words), "sketches")
    one = F.min_by(F.struct("doc_id", "_hash", "size", "signature"), F.struct(F.col("doc_id").isNull(), "doc_id", "_hash"))
    sets = rows.filter("key is not null").groupBy("key").agg(one.alias("c"))
    sets = stored(sets.select("key", "c.*"), "distinct")
    group = components(links(docs, sets, words, percent, matches, long_list)).withColumnRenamed("node", "key")
    named = sets.select("key", "doc_id").join(group, "key", "left").withColumn("_g", F.coalesce("component", "key"))
    least = named.groupBy("_g").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.select("key", "_g").join(least, "_g").select("key", "component_id"), "classes")
    full = rows.filter("key is not null").select("doc_id", "size", "key").join(named, "key").select("doc_id", "size", "component_id")
    out = full.union(rows.filter("key is null").select("doc_id", "size", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
