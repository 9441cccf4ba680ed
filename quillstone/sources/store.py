"""Files by path inside tasks: the store of a path, opened as a file that can be sought."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def located(path: str):
    """The pyarrow file system of a path as Spark gives it, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file for reading, with seek and tell, that reads only what is asked for."""
    store, there = located(path)
    return store.open_input_file(there)


def attempted(work: Callable[[], T], attempts: int = 3, delay: float = 1.0) -> T:
    """Try again after an error of the store, waiting longer each time; the last error
    is raised."""
    for n in range(attempts):
        try:
            return work()
        except OSError:
            if n + 1 == attempts:
                raise
            time.sleep(delay * (n + 1))
    raise ValueError("no attempts")
