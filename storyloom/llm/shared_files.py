"""Plain files in the shared scratch folder, written and read by tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from storyloom.session import scratch_root


def new_folder(spark: SparkSession, name: str) -> str:
    """Address of a fresh folder; the driver makes it, tasks of any executor may write there."""
    root = scratch_root(spark)
    uri = f"{root if '://' in root else 'file://' + os.path.abspath(root.removeprefix('file:'))}/llm-{name}-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return uri


def write(folder: str, name: str, parts: list[bytes]) -> int:
    """Write a file under another name first: a task run again replaces it whole, readers never see half."""
    system, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    system.move(part, f"{path}/{name}")
    return sum(map(len, parts))


def mapped(folder: str, name: str) -> np.ndarray:
    """Bytes of a file, memory-mapped where the folder is mounted, else read."""
    system, path = fs.FileSystem.from_uri(folder)
    full = f"{path}/{name}"
    info = system.get_file_info(full)
    if info.type == fs.FileType.NotFound or not info.size:
        return np.empty(0, np.uint8)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(full, np.uint8, "r")
    with system.open_input_stream(full) as f:
        return np.frombuffer(f.read(), np.uint8)


def reader(folder: str, name: str) -> Callable[[int, int], bytes]:
    """Reads a number of bytes from a place of a file, which is mapped where the folder is mounted."""
    system, path = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        raw = mapped(folder, name)
        return lambda begin, size: raw[begin:begin + size].tobytes()
    file = system.open_input_file(f"{path}/{name}")
    return lambda begin, size: file.read_at(size, begin)


def remove(folder: str) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    system.delete_dir(path)
