"""Random access to files on any file system the cluster can reach."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; plain paths are local or mounted."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def read_bytes(path: str) -> bytes | None:
    """Whole small file, or None if it does not exist."""
    fs, inner = resolve(path)
    if fs.get_file_info(inner).type != pafs.FileType.File:
        return None
    with fs.open_input_file(inner) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Write through a temporary name, so a retried task never leaves half a file."""
    fs, inner = resolve(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{os.getpid()}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, inner)


def exists(path: str) -> bool:
    fs, inner = resolve(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound
