"""Random access to a file's bytes: paths, memory, streams, and sources of one's own."""

from __future__ import annotations

import io
from typing import BinaryIO, Protocol

import pyarrow.fs as pafs

from ..errors import FormatError


class RangeSource(Protocol):
    """A length and exact reads of ranges; reads come one at a time."""

    length: int

    def read(self, offset: int, size: int) -> bytes: ...

    def close(self) -> None: ...


class StreamSource:
    """A seekable binary stream; closed with the source where it is owned."""

    def __init__(self, stream: BinaryIO, owned: bool = False):
        if not stream.seekable() or not stream.readable():
            raise ValueError("the stream must be readable and seekable")
        self.stream, self.owned = stream, owned
        self.length = stream.seek(0, io.SEEK_END)

    def read(self, offset: int, size: int) -> bytes:
        self.stream.seek(offset)
        parts = []
        while size and (part := self.stream.read(size)):
            parts.append(part)
            size -= len(part)
        return b"".join(parts)

    def close(self) -> None:
        if self.owned:
            self.stream.close()


class BytesSource:
    """Bytes in memory, borrowed."""

    def __init__(self, data: bytes | bytearray | memoryview):
        self.data = memoryview(data)
        self.length = len(self.data)

    def read(self, offset: int, size: int) -> bytes:
        return bytes(self.data[offset : offset + size])

    def close(self) -> None:
        pass


class PathSource(StreamSource):
    """A file of any file system that pyarrow knows, by path or URI."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        super().__init__(fs.open_input_file(name), owned=True)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_source(what: str | bytes | bytearray | memoryview | BinaryIO | RangeSource, owned: bool = False) -> RangeSource:
    if isinstance(what, str):
        return PathSource(what)
    if isinstance(what, bytes | bytearray | memoryview):
        return BytesSource(what)
    return what if hasattr(what, "length") else StreamSource(what, owned)


def read_exactly(source: RangeSource, offset: int, size: int) -> bytes:
    """size bytes; a range outside the source is a usage error, a short read a broken file."""
    if offset < 0 or size < 0 or offset + size > source.length:
        raise ValueError(f"bytes {offset} + {size} lie outside a source of {source.length}")
    data = source.read(offset, size)
    if len(data) != size:
        raise FormatError("the input ended during an exact read", offset + len(data))
    return data
