"""Raw arrays in a shared folder: written by tasks, memory-mapped by workers.

A path is a URI or a local path. Files appear under their name only when they are complete, so a task that is run again
replaces them by the same bytes. A folder that is not on a mounted file system is read through a copy of each
file in the worker's temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def _located(path: str):
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


@contextmanager
def writing(path: str) -> Iterator:
    """An output stream that becomes the file ``path`` when the block ends without an error."""
    system, place = _located(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, place)


@lru_cache(maxsize=4096)
def _local_file(path: str) -> str:
    system, place = _located(path)
    if urlparse(path).scheme in ("", "file"):
        return place
    with tempfile.NamedTemporaryFile(delete=False) as copy, system.open_input_stream(place) as source:
        while part := source.read(1 << 24):
            copy.write(part)
    return copy.name


def mapped(path: str, kind) -> np.ndarray:
    """The array in a file, memory-mapped; an empty file is an empty array."""
    import os

    name = _local_file(path)
    return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)


def find_sorted(keys: np.ndarray, firsts: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shard and place of each of the ascending ``keys`` in sorted shards that follow each other; -1 where absent."""
    shard = np.searchsorted(firsts, keys, "right") - 1
    place = np.full(len(keys), -1, np.int64)
    bounds = np.searchsorted(shard, np.arange(len(shards) + 1))
    for i, values in enumerate(shards):
        low, high = bounds[i], bounds[i + 1]
        if low < high:
            at = np.searchsorted(values, keys[low:high])
            hit = values[np.minimum(at, len(values) - 1)] == keys[low:high]
            place[low:high] = np.where(hit & (at < len(values)), at, -1)
    return shard, place
