"""Files in the shared folder, read and written by tasks themselves."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs

# Hadoop's names of a store and the one that pyarrow knows.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style URI or an absolute path."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def write_table(uri: str, table: pa.Table) -> None:
    system, path = locate(uri)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(re.sub("/[^/]*$", "", path), recursive=True)
    with system.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)


def read_table(uri: str) -> pa.Table:
    system, path = locate(uri)
    with system.open_input_file(path) as source:
        return pa.ipc.open_file(source).read_all()
