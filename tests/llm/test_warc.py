from __future__ import annotations

import gzip
import hashlib

from casefile.llm import files, warc


def test_round_trip(spark, tmp_path):
    big, twin = "<p>é" * 400, "x" * 1000
    rows = [(i, f"http://a/{i}", big) for i in range(5)] + [(10, None, twin), (11, "u\r\nWARC-Type: x", twin), (11, "u", twin)]
    rows += [(20, "u", "short"), (21, "u", "short"), (22, "u", None), (23, "u", ""), (None, "u", big), (None, None, "lonely" * 300), (None, "v", "lonely" * 300)]
    rows += [(100 + i, "http://x/ü", f"<b>{i}</b>" * i) for i in range(300)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, offset string").repartition(3)
    index = warc.archive(spark, frame, f"file://{tmp_path}/w")
    assert index.count() == len(rows)
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in warc.read_records(index, payload=True).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same) if len(data) >= 1000 and same else page
        revisit = first != page
        want.append((page, "revisit" if revisit else "response", first if revisit else None, len(data), hashlib.sha1(data).hexdigest(), b"" if revisit else data))
    assert found == sorted(want, key=str)


def test_selection_reads_few_ranges(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.archive(spark, frame, f"file://{tmp_path}/w")
    archives = index.select("file").distinct().count()
    assert warc.ranges(index).count() == archives
    some = index.filter("page_id % 50 = 0")
    assert warc.ranges(some, gap=0).count() == 4 and warc.ranges(some).count() <= archives
    assert sorted(r.page_id for r in warc.read_records(some).collect()) == [0, 50, 100, 150]
    spans = warc.ranges(index, span=1000).collect()
    assert max(r.stop - r.start for r in spans) < 1000 + max(r.length for r in index.collect())
    row = index.first()
    assert gzip.decompress(files.read_range(row.file, row.offset, row.length)).startswith(b"WARC/1.1\r\n")
    assert warc.read_records(index.filter("false")).count() == 0
    empty = warc.archive(spark, frame.filter("false"), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_ranges_are_dealt_by_bytes(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    found = warc.ranges(warc.archive(spark, frame, f"file://{tmp_path}/w"), span=500)
    width = sum(r.stop - r.start for r in found.collect())
    sizes = warc.dealt(found, task_bytes=width // 6).rdd.glom().map(lambda rows: sum(r.stop - r.start for r in rows)).collect()
    assert sum(sizes) == width and len([x for x in sizes if x]) >= 6 and max(sizes) < width / 3
    assert warc.dealt(found, span=width).rdd.getNumPartitions() == 1
    assert warc.dealt(found.filter("false")).count() == 0
