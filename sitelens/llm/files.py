"""Files that tasks write to and read from the shared folder, by its URI."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext


def create(folder: str, suffix: str) -> tuple[str, object]:
    """Path and stream of a new file. The name is the attempt's own, so a retried or speculative task never meets another's file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    task = TaskContext.get()
    name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None)


def open_input(path: str):
    """A file that is read from front to back."""
    fs, local = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(local, compression=None, buffer_size=1 << 20)


def open_random(path: str):
    fs, local = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(local)
