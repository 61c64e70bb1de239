"""Objects by address (scheme://bucket/key): small documents beside the tables, on any file system that pyarrow knows.

For what one process reads or writes whole. Tables go through Spark's own readers and writers."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote

_ADDRESS = re.compile(r"^([a-z][a-z0-9+.-]*)://([^/]+)/?(.*)$", re.S)
PARTIAL = ".partial"


class BadAddress(ValueError):
    pass


def parse(uri: str) -> tuple[str, str, str]:
    """Scheme, bucket and key; a bare path or a key that climbs is refused."""
    m = _ADDRESS.match(uri)
    if not m:
        raise BadAddress(f"no address of an object: {uri!r}")
    key = posixpath.normpath(m[3]) if m[3] else ""
    if key.startswith(("..", "/")) or ".." in m[3].split("/") or m[2] == "..":
        raise BadAddress(f"the key climbs: {uri!r}")
    return m[1], m[2], key


class Store:
    """Buckets are folders below a root."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root))

    def _path(self, uri: str) -> str:
        _, bucket, key = parse(uri)
        return f"{self.root}/{bucket}/{key}".rstrip("/")

    def _is_file(self, path: str) -> bool:
        return self.system.get_file_info(path).is_file

    def put_bytes(self, uri: str, data: bytes) -> None:
        """Under another name first: half an object is never seen."""
        path = self._path(uri)
        self.system.create_dir(posixpath.dirname(path))
        with self.system.open_output_stream(path + PARTIAL) as out:
            out.write(data)
        self.system.move(path + PARTIAL, path)

    def get_bytes(self, uri: str) -> bytes:
        with self.open_read(uri) as f:
            return f.read()

    def put_text(self, uri: str, text: str) -> None:
        self.put_bytes(uri, text.encode("utf-8"))

    def get_text(self, uri: str) -> str:
        return self.get_bytes(uri).decode("utf-8")

    def exists(self, uri: str) -> bool:
        return self._is_file(self._path(uri))

    def delete(self, uri: str) -> None:
        """An object that isn't there is deleted already."""
        if self._is_file(path := self._path(uri)):
            self.system.delete_file(path)

    def open_read(self, uri: str):
        return self.system.open_input_stream(self._path(uri), compression=None)

    def open_append(self, uri: str):
        path = self._path(uri)
        self.system.create_dir(posixpath.dirname(path))
        return self.system.open_append_stream(path, compression=None)

    def list_keys(self, prefix: str) -> Iterator[str]:
        """Addresses below a prefix, in order; what is still being written is hidden."""
        from pyarrow import fs

        scheme, bucket, key = parse(prefix)
        base = f"{self.root}/{bucket}/"
        start = posixpath.dirname(base + key) if not prefix.endswith("/") else (base + key).rstrip("/")
        found = self.system.get_file_info(fs.FileSelector(start, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda f: f.path):
            name = info.path.removeprefix(base)
            if info.is_file and name.startswith(key) and not name.endswith(PARTIAL):
                yield f"{scheme}://{bucket}/{name}"

    def list_prefixes(self, prefix: str) -> Iterator[str]:
        """Names directly below a prefix, each once, without walking what is below them."""
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self._path(prefix), allow_not_found=True))
        yield from sorted(f.base_name for f in found if not f.base_name.endswith(PARTIAL))

    def public_url(self, uri: str, relative_to: str | None = None) -> str:
        """A link to an object, from a page at another address if one is given."""
        path = self._path(uri)
        if relative_to is not None:
            path = posixpath.relpath(path, posixpath.dirname(self._path(relative_to)))
        return quote(path)
