from __future__ import annotations

import zlib
from collections import Counter

from casefile.llm import sharding

COLUMNS = "doc_id long, text string, shard string, extra int"


def run(spark, tmp_path, rows, **options):
    frame = spark.createDataFrame(rows, COLUMNS)
    return sharding.shuffle_into(frame, f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}", **options)


def test_rows_law(spark, tmp_path):
    rows = [(i, "copy" if i % 3 == 0 else f"text é {i}" * (i % 50), "old", i) for i in range(1000)]
    rows += [(None, None, None, 1), (None, "", None, 2), (7, "text", "a", 3), (7, "text", "a", 3)]
    found = run(spark, tmp_path, rows, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in found) == Counter((a, b, d) for a, b, _, d in rows)
    counts = Counter(r.shard for r in found)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    again = run(spark, tmp_path, rows[::-1], bucket_bytes=20_000).collect()
    place = lambda rs: {(r.doc_id, r.extra): (r.shard, r.slot) for r in rs if r.extra > 3}
    assert place(found) == place(again)
    moved = run(spark, tmp_path, rows, bucket_bytes=20_000, seed=12).collect()
    assert place(found) != place(moved)
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert sum(a < b for a, b in zip(order, order[1:])) < 0.6 * len(order)


def test_few_and_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0
    few = run(spark, tmp_path, [(1, "a", None, 0), (2, "b", None, 0)]).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2
    assert zlib.crc32(b"") == 0


def test_as_many_buckets_as_the_bytes_need(spark, tmp_path):
    rows = [(i % 7, "x" * (i % 5), None, i) for i in range(3000)]  # few ids and texts: the other columns spread them
    frame = spark.createDataFrame(rows, COLUMNS)
    hashes = frame.select(sharding.row_hash(frame, 3).alias("h")).distinct().count()
    assert hashes == len(rows)
    found = run(spark, tmp_path, rows, bucket_bytes=1, shards=7).collect()  # more than 2 ** 15 buckets, most of them empty
    assert sorted((r.doc_id, r.text, r.extra) for r in found) == sorted((a, b, d) for a, b, _, d in rows)
    counts = Counter(r.shard for r in found)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
