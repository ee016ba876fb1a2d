"""Files that every executor can reach, by plain path or by URI (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import os

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of `path`, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def kind(files: fs.FileSystem, path: str) -> fs.FileType:
    return files.get_file_info(path).type


def size(files: fs.FileSystem, path: str) -> int:
    """Bytes of a file; a missing one is an error."""
    info = files.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size
