"""WARC archives, index first: the writer leaves a row per record (file, offset, length, URL, digest), and readers turn
the selected rows into few sorted byte-range reads.

Every task writes archives of its own under a name no other attempt uses. The index is the commit: a row exists only
for records of a task that ended, and files of lost attempts are named by no row. Records are gzip members, so each can
be read alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import files
from casefile.llm.common import cut

ARCHIVE_BYTES = 1 << 30
SPAN = 8 << 20
GAP = 64 << 10
TASK_BYTES = 128 << 20
INDEX = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Per page (page_id, url, html, payload_bytes, payload_digest, record_type, refers_to).

    Of pages with equal payloads of at least ``least_bytes`` the one with the largest page_id is the response, the
    others refer to it. Rows that share that page_id are all responses; rows without a page_id never are referred to,
    and a group of such rows only is all responses. A null html is an empty payload.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    # only payloads that occur twice or more: the table is small beside the pages, and a hot payload is one row of it
    again = df.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    again = cut(again.filter("_n > 1 and _first is not null").drop("_n"))
    df = df.join(again, "payload_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= least_bytes)
    kind = F.when(other, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type")
    return df.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind, F.when(other, F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([] if url is None else [("WARC-Target-URI", quote(url, safe="!\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~-."))]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``records`` below ``folder`` and returns the index table (also below it), read back.

    The work happens once, in this call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places = []
                for page_id, url, html, digest, kind, refers in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{folder}/archives/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.create(name)
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, (html or "").encode(), digest, refers, kind == "revisit")) + pack.flush()
                    out.write(data)
                    places.append((name, at, len(data)))
                    at += len(data)
                names, starts, lengths = zip(*places) if places else ((), (), ())
                arrays = [batch.column(i) for i in (0, 1, 3, 4, 5, 6)] + [pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return rows.sparkSession.read.parquet(f"{folder}/index")


def ranges(selected: DataFrame, span: int = SPAN, gap: int = GAP) -> DataFrame:
    """Byte ranges (file, start, stop, places) that hold the selected index rows.

    Records of one file and ``span`` are read together unless more than ``gap`` unwanted bytes lie between them; no
    range is longer than a span and a record.
    """
    from pyspark.sql import Window

    df = selected.select("file", "offset", "length", F.expr(f"offset div {span}").alias("_span")).distinct()
    order = Window.partitionBy("file", "_span").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    df = df.withColumn("_new", F.when(F.col("offset") - before <= gap, 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = F.sort_array(F.collect_list(F.struct("offset", "length")))  # at most a span's records
    return df.groupBy("file", "_span", "_run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), places.alias("places"))


def dealt(found: DataFrame, task_bytes: int = TASK_BYTES, span: int = SPAN) -> DataFrame:
    """The byte ranges in tasks of about ``task_bytes`` each, in file order; fewer bytes than that for every core are
    dealt in tasks of a span. A shuffle of index rows alone would be merged into one reading task."""
    width = found.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    cores = found.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-width // task_bytes), min(cores, -(-width // span)))
    return found.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")


def read_records(selected: DataFrame, payload: bool = False) -> DataFrame:
    """The records behind index rows: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Digest and size of a response are taken from its payload and must agree with the record's head; those of a revisit
    are what its head says. Every selected place is read once, however often it is selected. Other columns of the index
    rows go; no index rows, no records.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def number(fields: dict[str, str], key: str) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(key, ""))
        return int(found[1]) if found else None

    def one(data: bytes) -> tuple:
        fields, block = parse(data)
        head, _, body = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        row = (number(fields, "warc-record-id"), fields.get("warc-target-uri"), size, digest, fields["warc-type"], number(fields, "warc-refers-to"))
        return (*row, body) if payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = files.read_range(file, start, stop - start)
                rows = [one(zlib.decompress(data[p["offset"] - start : p["offset"] - start + p["length"]], 31)) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    found = dealt(ranges(selected).select("file", "start", "stop", "places"))
    return found.mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages as archives below ``folder``; returns the index."""
    return write_archives(records(pages), folder)
