"""Files in the shared folder, opened from tasks through pyarrow's filesystems (local, HDFS, object stores)."""

from __future__ import annotations

import re
from typing import Any

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a Hadoop-style URI; ``file:/x`` counts as ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def create(uri: str) -> Any:
    """A new file for writing; its folder is made if it is missing."""
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, start)
