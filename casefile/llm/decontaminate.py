"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, doc_id, text_hash, pos) for the terms the test items use, written in segments
that are each sorted by term. A term is the XXH64 of its word. A document's end has a posting too (term ``END``, whose
position is the document's number of words), so sizes need no second pass over the texts.

A test window is searched from its rarest terms: their lists, shifted by the terms' offsets in the item, must meet on the
same (document, shift). What is left is checked for all terms of the item along that shift; runs of matching positions
as long as a window are exact occurrences.

(doc_id, text_hash) names a document: rows repeated in full share their postings, rows that share a doc_id only do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.llm.common import ascii_lower, cut, shared_folder

END = 0
"""Term of the posting that tells where a document ends."""
BROADCAST_ROWS = 2_000_000
"""Rows up to which a list of (document, shift, position) to check is broadcast; beyond, it is shuffled."""


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Null has none."""
    separators = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), separators), "")


def term(word: Column) -> Column:
    return F.xxhash64(word)


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (item, item_id, at, term, size): the words of every item. ``item`` is a key of (item_id, text)."""
    df = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("_w")).distinct()
    df = df.select("item", "item_id", F.size("_w").alias("size"), F.posexplode_outer("_w").alias("at", "_word")).filter("at is not null")
    return df.select("item", "item_id", "at", term(F.col("_word")).alias("term"), "size")


def build_index(docs: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """Writes the postings of ``terms`` (column ``term``) and returns the table.

    ``terms`` is the vocabulary of the test items. It meets the words as a join, broadcast only up to its checked size.
    """
    vocabulary = cut(terms.select("term").union(docs.sparkSession.range(1).select(F.lit(END).cast("long").alias("term"))).distinct())
    if vocabulary.count() <= BROADCAST_ROWS:
        vocabulary = F.broadcast(vocabulary)
    given = docs.select("doc_id", F.hash("text").alias("text_hash"), words(F.col("text")).alias("_w"))
    hashes = F.array_append(F.transform("_w", term), F.lit(END).cast("long"))
    # outer: a filter on the array's size, which a plain explode brings along, would split every text twice
    each = given.select("doc_id", "text_hash", F.posexplode_outer(hashes).alias("pos", "term"))
    each.join(vocabulary, "term", "left_semi").sortWithinPartitions("term").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("n"))


def _listed(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the terms in ``asked`` (item, at, term), shifted: (item, at, doc_id, text_hash, shift)."""
    return index.join(asked, "term").select("item", "at", "doc_id", "text_hash", (F.col("pos") - F.col("at")).alias("shift"))


def matches(index: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """Exact phrase matches: (item, item_id, doc_id, text_hash, start, stop, at).

    Rows are maximal runs of at least ``window`` words (all words of a shorter item) that a document, from word ``start``
    up to before ``stop``, has in common with an item from its word ``at`` on.
    """
    least = F.least(F.lit(window), F.col("size"))
    counts = cut(terms.select("term").distinct().join(frequencies(index), "term"))
    # terms the documents lack break every window that holds them
    known = cut(terms.join(counts, "term", "left").select("item", "at", "term", "size", F.coalesce("n", F.lit(0)).alias("n")))
    starts = known.select("item", F.explode(F.sequence(F.greatest(F.col("at") - least + 1, F.lit(0)), F.least(F.col("at"), F.col("size") - least))).alias("w"), "at", "term", "n")
    by = Window.partitionBy("item", "w")
    ranked = starts.withColumn("_rarest", F.min("n").over(by)).filter("_rarest > 0")
    ranked = ranked.withColumn("_rank", F.row_number().over(by.orderBy("n", "at"))).filter("_rank <= 2")
    ranked = cut(ranked.groupBy("item", "w").agg(F.min_by(F.struct("at", "term"), "_rank").alias("a"), F.max_by(F.struct("at", "term"), "_rank").alias("b")))
    seed = lambda c: _listed(index, ranked.select("item", F.col(f"{c}.at").alias("at"), F.col(f"{c}.term").alias("term")).distinct())
    same = lambda x, y: F.col(f"x.{x}").eqNullSafe(F.col(f"y.{y}"))
    pairs = ranked.select("item", F.col("a.at").alias("at"), F.col("b.at").alias("other")).distinct()
    first = seed("a").join(pairs, ["item", "at"]).alias("x")
    second = seed("b").alias("y")
    on = (F.col("x.item") == F.col("y.item")) & (F.col("x.other") == F.col("y.at")) & (F.col("x.shift") == F.col("y.shift"))
    on = on & (F.col("x.text_hash") == F.col("y.text_hash")) & same("doc_id", "doc_id")
    lines = cut(first.join(second, on, "left_semi").select("item", "doc_id", "text_hash", "shift").distinct())
    # all terms of the item along the shift
    wanted = cut(lines.join(known.select("item", "at", "term"), "item").select("term", "item", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "at", "shift", (F.col("at") + F.col("shift")).alias("pos")))
    asked = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = index.join(asked, ["term", "pos"]).filter(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")))
    found = found.select("item", "doc_id", "text_hash", "shift", "at").distinct()
    order = Window.partitionBy("item", "doc_id", "text_hash", "shift").orderBy("at")  # at most the item's words
    runs = found.withColumn("_run", F.col("at") - F.row_number().over(order))
    runs = runs.groupBy("item", "doc_id", "text_hash", "shift", "_run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    sizes = terms.select("item", "item_id", "size").distinct()
    runs = runs.join(sizes, "item").filter(F.col("n") >= least)
    begin = (F.col("at") + F.col("shift")).cast("int")
    return runs.select("item", "item_id", "doc_id", "text_hash", begin.alias("start"), (begin + F.col("n")).alias("stop"), "at")


def proximity(index: DataFrame, terms: DataFrame, span: int = 30) -> DataFrame:
    """Proximity matches: (item, item_id, doc_id, text_hash, start, stop), where all distinct words of an item occur, in any
    order, within ``span`` words around an occurrence of the item's rarest word (``span`` on either side).

    ``start`` and ``stop`` enclose the nearest occurrence of every word. Lists are met per (document, stretch of ``span``
    words), so frequent words never meet outside the rare word's surroundings.
    """
    counts = cut(terms.select("term").distinct().join(frequencies(index), "term"))
    known = terms.select("item", "item_id", "term").distinct().join(counts, "term", "left").fillna(0, ["n"])
    by = Window.partitionBy("item")
    known = cut(known.withColumn("_n", F.count("*").over(by)).withColumn("_rarest", F.min("n").over(by)).filter("_rarest > 0").withColumn("_rank", F.row_number().over(by.orderBy("n", "term"))))
    anchor = index.join(known.filter("_rank = 1").select("item", "item_id", "term", "_n"), "term")
    anchor = anchor.select("item", "item_id", "_n", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("pos").alias("middle"))
    anchor = anchor.distinct().withColumn("_cell", F.explode(F.array(*[F.expr(f"middle div {span}") + k for k in (-1, 0, 1)])))
    others = index.join(known.select("item", "term"), "term").withColumn("_cell", F.expr(f"pos div {span}")).withColumnRenamed("item", "_item")
    on = (F.col("item") == F.col("_item")) & (F.col("_t") == F.col("text_hash")) & F.col("_d").eqNullSafe(F.col("doc_id"))
    on = on & (anchor["_cell"] == others["_cell"]) & (F.abs(F.col("pos") - F.col("middle")) <= span)
    near = anchor.join(others, on).groupBy("item", "item_id", "_n", "doc_id", "text_hash", "middle", "term")
    near = near.agg(F.min_by("pos", F.struct(F.abs(F.col("pos") - F.col("middle")), "pos")).alias("pos"))
    whole = near.groupBy("item", "item_id", "_n", "doc_id", "text_hash", "middle").agg(F.count("*").alias("_have"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    return whole.filter("_have = _n").select("item", "item_id", "doc_id", "text_hash", "start", "stop").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, folder: str | None = None) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_words, n_hit, items array, n_items, contaminated).

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of an item (an item of fewer
    words, but not none, is one window). Texts and items may be null or empty; items repeated in full count once, and so
    does an item_id; an item without an id counts under the empty id. Document rows stay rows.
    """
    terms = cut(item_terms(items))
    index = build_index(docs, terms, folder or shared_folder(docs.sparkSession, "postings"))
    found = cut(matches(index, terms, window))
    positions = found.select("doc_id", "text_hash", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct()
    hit = positions.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    ids = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    hit = hit.join(ids, (hit["doc_id"].eqNullSafe(ids["doc_id"])) & (hit["text_hash"] == ids["text_hash"])).select(hit["doc_id"].alias("_d"), hit["text_hash"].alias("_t"), "n_hit", "items")
    ends = index.filter(F.col("term") == END)
    df = ends.join(hit, ends["doc_id"].eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return df.select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"), n_hit.alias("n_hit"), items_.alias("items"), F.size(items_).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns."""
    bad = contamination(docs, items, window).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.hash(docs["text"]) == bad["_t"]), "left_anti")
