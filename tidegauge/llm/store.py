"""Files in shared folders, from the driver or an executor's Python.

A ``file:`` folder is opened as such and can be memory-mapped; any other scheme
goes through pyarrow's file systems. Writers put a file under a temporary name
and rename it at the end, so a repeated or a lost task leaves no torn file.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
from pyarrow import fs


def at(url: str) -> tuple[fs.FileSystem, str]:
    if m := re.match(r"file:/*(/.*)", url):
        return fs.LocalFileSystem(), m[1]
    if "://" in url:
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url


class Writer:
    """``with Writer(url) as f: f.write(bytes)``; the file appears when the block ends well."""

    def __init__(self, url: str):
        self.fs, self.path = at(url)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.file = self.fs.open_output_stream(self.temp)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind:
            self.fs.delete_file(self.temp)
        else:
            self.fs.move(self.temp, self.path)


def load(url: str, dtype) -> np.ndarray:
    """A flat array: mapped into memory from a local folder, else read."""
    where, path = at(url)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
