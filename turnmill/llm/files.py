"""Files in the shared folder, reached by URI so that any store works that pyarrow or Spark's Hadoop client knows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pfs


def opened(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


@contextmanager
def whole(uri: str) -> Iterator[Callable[[bytes], object]]:
    """A writer of a file that appears under its name only when complete, so that a repeated task replaces it whole."""
    fs, path = opened(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out.write
        fs.move(part, path)
    except BaseException:
        if fs.get_file_info(part).type != pfs.FileType.NotFound:
            fs.delete_file(part)
        raise


class Ranges:
    """A flat file of a store without memory mapping: each slice is read when it is asked for."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        first, last, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at(max(0, last - first) * self.dtype.itemsize, first * self.dtype.itemsize), self.dtype)


def mapped(uri: str, dtype: str) -> np.ndarray | Ranges:
    """A flat file whose slices are arrays: memory-mapped where the folder is mounted."""
    fs, path = opened(uri)
    if isinstance(fs, pfs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    return Ranges(fs.open_input_file(path), dtype)
