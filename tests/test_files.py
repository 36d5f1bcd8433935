from __future__ import annotations

import hashlib

from casefile.operators import attachments
from casefile.sources import files


def test_digests_in_pieces(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "a" / "b").mkdir(parents=True)
    contents = {"a/one.PDF": b"x" * (files.PIECE + 1), "a/b/two.txt": "\u00e9".encode(), "none": b"", "a/~$open.docx": b"lock", "name with space & sign.eml": b"mail", "z.gz": b"not packed", "_kept": b"k", "a/b/.hidden": b"h", ".git/x": b"h"}
    for name, content in contents.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(content)
    contents = {k: v for k, v in contents.items() if "/." not in f"/{k}"}
    found = {r.path.partition("/in/")[2]: r for r in attachments.read_sources(spark, f"file://{folder}").collect()}
    assert {k: (r.bytes, r.sha256) for k, r in found.items()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
    assert found["a/one.PDF"].extension == "pdf" and found["none"].extension == "none"
    top = attachments.read_sources(spark, f"file://{folder}", recursive=False)
    assert {r.name for r in top.collect()} == {"none", "name with space & sign.eml", "z.gz", "_kept"}


def test_rejected_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with (folder / "big.eml").open("wb") as file:
        file.truncate(attachments.BYTE_LIMITS["eml"] + 1)
    for name, content in {"fine.eml": b"mail", "~$fine.docx": b"lock", "empty.txt": b""}.items():
        (folder / name).write_bytes(content)
    found = attachments.read_sources(spark, f"file://{folder}", admitted=True)
    assert {(r.name, r.reject_reason, r.sha256) for r in found.collect()} == {
        ("big.eml", "too large", None), ("empty.txt", "empty", None), ("fine.eml", None, hashlib.sha256(b"mail").hexdigest())}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 5
    (tmp_path / "in").mkdir()
    with (tmp_path / "in" / "scan.tif").open("wb") as file:
        file.truncate(size)  # sparse: it takes no disk
    row = attachments.read_sources(spark, f"file://{tmp_path}/in").first()
    want = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        want.update(bytes(min(1 << 24, size - at)))
    assert (row.bytes, row.sha256) == (size, want.hexdigest())


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "\u00e9"), ("b", None), ("c c", "")], "name string, content string")
    assert files.write_files(rows, f"file://{tmp_path}/out/deep") == 3
    assert {p.name: p.read_bytes() for p in (tmp_path / "out" / "deep").iterdir() if not p.name.startswith(".")} == {"a.txt": "\u00e9".encode(), "b": b"", "c c": b""}
    assert files.write_files(rows.filter("false"), f"file://{tmp_path}/out/deep") == 0
