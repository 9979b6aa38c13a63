"""Files opened in tasks, wherever they lie."""

from __future__ import annotations

from typing import Any


def opened(source: str) -> tuple[Any, str]:
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if source.startswith(("/", "file:")):
        return fs.LocalFileSystem(), source.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(source)
