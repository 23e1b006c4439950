"""Files for Python tasks, by the URIs that Spark uses."""

from __future__ import annotations

from urllib.parse import quote


def file_system(uri: str):
    """(file system, path in it) of a full URI as Spark writes it: names stand unescaped."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    host, local = "", rest
    if rest.startswith("//"):
        host, _, local = rest[2:].partition("/")
        local = f"/{local}"
    if scheme == "file":
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(f"{scheme}://{host}{quote(local)}")
