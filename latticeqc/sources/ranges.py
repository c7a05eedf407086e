"""Files of any size opened inside tasks, so that they can be read by ranges."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow.fs import FileSystem, LocalFileSystem


def open_file(path: str):
    """A file that can seek, from a path as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inside = FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_file(inside)


def opens(path: str) -> bool:
    """Whether Python workers know the store of ``path``; a local path is always taken as known."""
    try:
        open_file(path).close()
    except (OSError, ValueError, NotImplementedError):
        return path.startswith(("file:", "/"))
    return True
