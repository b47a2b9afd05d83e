"""Files that tasks read and write themselves, on any file system that Arrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style address: local ones may hold blanks, and one slash or three after ``file:``."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Store:
    """A folder named by a URI. Made anew in each task, since connections do not travel."""

    def __init__(self, uri: str):
        self.fs, root = resolve(uri)
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self.path(name)).type != pafs.FileType.NotFound

    def open(self, name: str):
        return self.fs.open_input_stream(self.path(name), compression=None)  # the bytes as they are, whatever the name ends in

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    @contextmanager
    def writing(self, name: str) -> Iterator:
        """A stream to a new or replaced file, which appears whole at the end; after an error it does not appear."""
        target = self.path(name)
        folder, _, last = target.rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/.draft-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            yield out
        self.fs.move(draft, target)
        stale = f"{folder}/.{last}.crc"  # what Hadoop's local client keeps beside a file that it wrote
        if self.fs.type_name == "local" and self.fs.get_file_info(stale).type != pafs.FileType.NotFound:
            self.fs.delete_file(stale)

    def put(self, name: str, content: bytes) -> None:
        with self.writing(name) as out:
            out.write(content)
