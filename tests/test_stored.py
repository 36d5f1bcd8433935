"""Queries that read a table once do not keep a copy of it, and marked sources are shuffled once."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from casefile.operators import matching, similarity
from casefile.plans import journal_queries, matching_queries
from casefile.plans.catalog import load
from casefile.session import cut_lineage

SMALL = "/root/testdata/sf0.001"


def test_explicit_matches_store_nothing(spark, monkeypatch):
    calls = []
    for name in ("cut_lineage", "stored"):
        monkeypatch.setattr(matching_queries, name, lambda df: calls.append(1) or cut_lineage(df), raising=False)
    found = load().queries["match_explicit"].run(spark, SMALL)
    assert found.count() > 0 and calls == []


def test_marked_sources_are_shuffled_once(spark):
    n = F.col("id")
    sources = spark.range(3000).select(
        F.when(n % 50 != 49, n % 5).alias("m"), F.when(n % 40 != 39, F.concat(F.lit("e"), n)).alias("source_id"),
        F.when(n % 30 != 29, F.sha2((n % 700).cast("string"), 256)).alias("sha256"),
    )
    selected = sources.filter((n % 3 == 0) & (n < 900)).select("m", "source_id")
    selected = selected.unionByName(selected.limit(5)).unionByName(spark.createDataFrame([(1, "gone")], "m long, source_id string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.unselected_copies(sources, selected, ["m"], "source_id").select("m", "source_id", "sha256")
        got = sorted(map(tuple, found.collect()), key=str)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    chosen = {r for r in map(tuple, selected.collect()) if None not in r}
    rows = [tuple(r) for r in sources.collect()]
    contents = {(m, h) for m, e, h in rows if (m, e) in chosen and h is not None}
    assert got == sorted((r for r in rows if r[0] is not None and (r[0], r[2]) in contents and r[:2] not in chosen), key=str) and len(got) > 100
    # both readings of the marked sources come from one shuffle
    assert len(re.findall(r"(?<!\], )Exchange hashpartitioning\(m#\d+L, source_id", plan)) == 2 and "ReusedExchange" in plan


def test_block_meeting_memory(monkeypatch):
    """Words of two blocks are counted in few bytes a word: tables of codes have a bound, and small sets are taken in portions."""
    monkeypatch.setattr(similarity, "CODE_BITS", 16, raising=False)
    draw = np.random.default_rng(3)
    words = draw.integers(-(1 << 31), 1 << 31, (20_000, 100)).astype(np.int32)
    words[19_000:, :90] = words[:1000, :90]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 100, dtype=np.int32)), pa.array(words.reshape(-1)))
    given = pa.table({
        "set_id": pa.array(np.arange(20_000)), "block": pa.array(np.arange(20_000, dtype=np.int32) // 10_000), "n": pa.array(np.full(20_000, 100, np.int32)),
        "needed": pa.array(np.full(20_000, 82, np.int32)), "words": lists,
    })
    given = pa.Table.from_batches(given.to_batches(max_chunksize=3000))
    tracemalloc.start()
    met = similarity._shared_words(given, 100_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(met["small"].to_pylist(), met["large"].to_pylist())) == [(i, 19_000 + i) for i in range(1000)]
    assert most < 100e6  # two million words


def test_small_matters_are_scored_in_one_place(spark, monkeypatch):
    """No list of words is shuffled for a small matter; large matters, which meet by words, get the same scores."""
    draw = random.Random(11)
    words = lambda least: draw.sample([f"w{i}" for i in range(30)], draw.randrange(least, 9))
    dates = ["1 may 2020", "2 may 2020", "3 may 2020"]
    targets = spark.createDataFrame(
        [(m, i, words(1), draw.choice([*dates, None])) for m in (1, 2, 3, None) for i in range(5 * (m or 1))], "m int, target long, words array<string>, date_key string"
    )
    profiles = spark.createDataFrame(
        [(m, i, words(0), draw.sample(dates, draw.randrange(3))) for m in (1, 2, 3, None) for i in range(20)], "m int, profile long, words array<string>, dates array<string>"
    )
    for least in ((1, 1), (38, 1), (1, 2)):
        found = []
        for within in (1 << 16, 250, 0):
            monkeypatch.setattr(matching, "WITHIN", within, raising=False)
            scores = matching.score_profiles(targets, profiles, ["m"], *least)
            found.append(sorted(map(tuple, scores.select("m", "target", "profile", "score").collect())))
            if within > 250:
                assert "Generate" not in scores._jdf.queryExecution().optimizedPlan().toString()
        assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_report_parts_are_stored_compressed(spark, monkeypatch):
    """What the report reads several times is kept in tables, not as rows of full width."""
    calls, cut = [], journal_queries.cut_lineage
    monkeypatch.setattr(journal_queries, "cut_lineage", lambda df: calls.append(1) or cut(df))
    load().queries["build_report"].run(spark, SMALL)
    assert calls == []
