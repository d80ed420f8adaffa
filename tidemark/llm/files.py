"""Whole files in the shared folder, written and read by tasks.

Paths are URIs that pyarrow opens (local, HDFS, S3). A file is written under a name of the
attempt and then moved, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """An output stream; the file appears at uri when all of it is written."""
    system, path = opened_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(attempt) as out:
        yield out
    system.move(attempt, path)


def reader(uri: str):
    system, path = opened_fs(uri)
    return system.open_input_file(path)
