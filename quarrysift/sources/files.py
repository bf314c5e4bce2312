"""Single files in a folder that all executors share, by its URI: mounted (file: or a plain path), or on any store that Arrow reaches."""

from __future__ import annotations

import os

from pyarrow import fs


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(folder)


class Folder:
    def __init__(self, uri: str):
        self.fs, self.root = store(uri.rstrip("/"))

    def write(self, path: str, data: bytes) -> None:
        """A file, whole or not at all: it is written beside its place and then moved there. A task that is run again overwrites it."""
        to = f"{self.root}/{path}"
        folder, name = to.rsplit("/", 1)
        self.fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{os.getpid()}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, to)

    def list(self, under: str = "") -> list[tuple[str, int]]:
        """(path, bytes) of all files below a folder, by path; none if it doesn't exist."""
        top = f"{self.root}/{under}".rstrip("/")
        found = self.fs.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return sorted((f.path[len(top) + 1 :], f.size) for f in found if f.type == fs.FileType.File)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read()
