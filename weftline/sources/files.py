"""Files in the folder that all tasks see, read at any place and written whole, by the tasks themselves.

Paths are those of Arrow's file systems: local ones and file:, hdfs:, s3:, gs: and abfs: URIs.
"""

from __future__ import annotations

import json
import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write(path: str, data: bytes) -> None:
    store, at = opened(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def read(path: str) -> bytes:
    store, at = opened(path)
    with store.open_input_stream(at) as source:
        return source.read()


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    store, at = opened(path)
    found = store.get_file_info(at)
    return found.size if found.type == fs.FileType.File else None


def names(folder: str) -> list[str]:
    """Names of the files of a folder, in order; none if there is no such folder."""
    store, at = opened(folder)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File)


def delete(folder: str, some: list[str]) -> None:
    """Deletes files of a folder; those that are not there are passed over."""
    store, at = opened(folder)
    for name in some:
        try:
            store.delete_file(f"{at}/{name}")
        except FileNotFoundError:
            pass


def delete_folder(folder: str) -> None:
    """Deletes a folder with all in it, if it is there."""
    store, at = opened(folder)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def manifest(folder: str) -> dict | None:
    """What a finished write says of its files; None if there was none."""
    path = f"{folder}/_manifest.json"
    return None if size(path) is None else json.loads(read(path))


def finish(folder: str, parts: list[str], what: dict) -> None:
    """Ends a write: files that lost attempts left go, then the manifest says which ones count."""
    known = set(parts)
    delete(folder, [n for n in names(folder) if n.startswith("part-") and n not in known])
    write(f"{folder}/_manifest.json", json.dumps(what).encode())
