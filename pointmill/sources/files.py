"""Ranged reads and whole writes in any store that Arrow's file systems reach, and ranged reads of URLs, from the driver or a task."""

from __future__ import annotations

from pyarrow import fs

from . import http


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def size_of(path: str) -> int:
    if http.is_url(path):
        return http.size_of(path)
    store, p = open_store(path)
    info = store.get_file_info(p)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def exists(path: str) -> bool:
    if http.is_url(path):
        return http.exists(path)
    store, p = open_store(path)
    return store.get_file_info(p).type == fs.FileType.File


def read_range(path: str, start: int, length: int) -> bytes:
    """Exactly ``length`` bytes; fewer are an error."""
    if http.is_url(path):
        return http.read_range(path, start, length) if length else b""
    store, p = open_store(path)
    with store.open_input_file(p) as f:
        f.seek(start)
        out = f.read(length)
    if len(out) != length:
        raise EOFError(f"{path}: {length} bytes asked at {start}, {len(out)} there")
    return out


def read_all(path: str) -> bytes:
    return read_range(path, 0, size_of(path))


def join(folder: str, name: str) -> str:
    """A name inside a folder; one that leaves it is refused."""
    if any(part == ".." for part in name.replace("\\", "/").split("/")):
        raise ValueError(f"{name} leaves its folder")
    return f"{folder.rstrip('/')}/{name}"


def write_all(path: str, data: bytes) -> None:
    store, p = open_store(path)
    store.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(p, compression=None) as f:
        f.write(data)


def list_files(folder: str) -> list[str]:
    store, p = open_store(folder)
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(p, recursive=True)) if i.type == fs.FileType.File)
