"""Files in a shared store, written and read from tasks by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Written:
    """A file that appears under its name only when it is complete.

    An attempt writes to a name of its own and moves it at the end, so a task
    that runs again, or twice at once, replaces a file by an equal one.
    """

    def __init__(self, uri: str):
        self.store, self.path = located(uri)
        folder = self.path.rsplit("/", 1)[0]
        self.store.create_dir(folder, recursive=True)
        self.part = f"{folder}/_{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)

    def __enter__(self):
        return self

    def write(self, data) -> None:
        self.out.write(data)

    def tell(self) -> int:
        return self.out.tell()

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.part, self.path)
        else:
            self.store.delete_file(self.part)


def opened(uri: str):
    """A seekable reader."""
    store, path = located(uri)
    return store.open_input_file(path)


def size_of(uri: str) -> int:
    store, path = located(uri)
    return store.get_file_info(path).size


def read_at(source, offset: int, length: int) -> bytes:
    """Exactly ``length`` bytes from ``offset``."""
    source.seek(offset)
    data = source.read(length)
    if len(data) != length:
        raise EOFError(f"{length} bytes wanted at {offset}, {len(data)} found")
    return data
