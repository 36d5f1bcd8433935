"""Whole files in a folder every executor reaches: written from rows, and digested piece by piece."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 8 << 20
TASK_BYTES = 256 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI as Spark lists it: ``file:/x`` has one slash, and no character is escaped."""
    scheme, authority, path = re.fullmatch(r"(?:([a-zA-Z][\w+.-]*):)?(?://([^/]*))?(.*)", uri, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), path
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return system, root.rstrip("/") + path


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Rows (path, bytes) of the files in a folder, empty ones too, which Spark's own file sources leave out.

    Files and folders whose names begin with a dot are hidden. One task lists the folder itself, then tasks list what is
    below its subfolders; no listing passes through the driver.
    """
    _, root = located(folder.rstrip("/"))
    prefix = folder.rstrip("/").removesuffix(root)

    def rows(path: str, deep: bool) -> Iterator[pa.RecordBatch]:
        here, _ = located(folder)
        found = [x for x in here.get_file_info(fs.FileSelector(path, recursive=deep)) if not re.search(r"(?:^|/)\.", x.path[len(root) :].lstrip("/"))]
        for i in range(0, len(found), 10_000):
            some = found[i : i + 10_000]
            size = [None if x.type == fs.FileType.Directory else x.size for x in some]
            yield pa.RecordBatch.from_arrays([pa.array([prefix + x.path for x in some], pa.string()), pa.array(size, pa.int64())], names=["path", "bytes"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from rows(root, False)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from rows(path.removeprefix(prefix), True)

    found = spark.range(1, numPartitions=1).mapInArrow(top, "path string, bytes bigint")
    files, folders = found.filter("bytes IS NOT NULL"), found.filter("bytes IS NULL")
    if not recursive:
        return files
    deeper = folders.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("path")).mapInArrow(below, "path string, bytes bigint")
    return files.union(deeper.filter("bytes IS NOT NULL"))


def digest(uri: str) -> str:
    """SHA-256 of a file of any size, held in memory by one piece only."""
    system, path = located(uri)
    found = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def with_digests(files: DataFrame, wanted: str = "true", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Adds ``sha256`` of the file at ``path`` to the rows that meet ``wanted``, null to the others, which are not opened.

    ``files``: path, bytes and any other columns but sha256. Rows are dealt to as many tasks as their bytes need, and at
    least one for every core; a file is read once, by one task, since SHA-256 goes from its first byte to its last.
    """
    rows = files.withColumn("_wanted", F.coalesce(F.expr(wanted), F.lit(False)))
    width = rows.filter("_wanted").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-width // task_bytes))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in files.dtypes), "sha256 string"])
    names = [*files.columns, "sha256"]
    at, flag = names.index("path"), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(p) if w else None for p, w in zip(batch.column(at).to_pylist(), batch.column(flag).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:flag], pa.array(found, pa.string())], names=names)

    return rows.repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, content string or binary; null: empty) as one file of ``folder``; returns how many.

    Names are unique. A file is written whole under its own name, so a task that runs again leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{name}", compression=None) as stream:
                    stream.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    given = rows.select("name", F.col("content").cast("binary"))
    return given.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
