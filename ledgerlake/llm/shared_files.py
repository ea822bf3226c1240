"""Files that tasks write to the shared folder and workers map into memory."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs

from ledgerlake.llm.arrays import map_arrays, save_arrays


def _local(uri: str) -> str | None:
    """The path of a shared folder that is mounted, None for one behind a store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_file(folder: str, name: str, source: str) -> str:
    """Copy a finished local file to the shared folder under its final name in one step.

    A task that runs again writes the same name with the same bytes, so either copy may win.
    """
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = os.path.join(path, f".{name}-{uuid.uuid4().hex}")
        shutil.copyfile(source, part)
        os.replace(part, os.path.join(path, name))
    else:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        part = f"{top}/_{name}-{uuid.uuid4().hex}"
        with open(source, "rb") as f, store.open_output_stream(part) as out:
            shutil.copyfileobj(f, out, 1 << 22)
        store.move(part, f"{top}/{name}")
    return f"{folder}/{name}"


def put_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    with tempfile.TemporaryDirectory(prefix="ledgerlake-") as d:
        save_arrays(os.path.join(d, name), arrays)
        return put_file(folder, name, os.path.join(d, name))


_FETCHED: dict[str, str] = {}


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a shared file, mapped where it lies or, from a store, from a worker's copy."""
    path = _local(uri)
    if path is None:
        path = _FETCHED.get(uri)
        if path is None:
            store, at = fs.FileSystem.from_uri(uri)
            path = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-"), "arrays")
            with store.open_input_stream(at) as f, open(path, "wb") as out:
                shutil.copyfileobj(f, out, 1 << 22)
            _FETCHED[uri] = path
    return map_arrays(path)


def read_range(uri: str, start: int, length: int) -> bytes:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(length)
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as f:
        return f.read_at(length, start)


def file_size(uri: str) -> int:
    path = _local(uri)
    if path is not None:
        return os.path.getsize(path)
    store, at = fs.FileSystem.from_uri(uri)
    return store.get_file_info(at).size
