"""Values of pages, decoded strictly with numpy: sizes must be exact, indices in bounds.

Spark and Arrow decode faster and forgive more. This lane is for saying what is
wrong with a file, and where; it gives the same values for files that are right.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..errors import LimitExceededError
from ..options import ReaderOptions
from .footer import Chunk, FileMetadata
from .pages import PLAIN, Page, needed, walk_payloads
from .ranges import RangeSource

DTYPES = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}
ARROW = {"BOOLEAN": pa.bool_(), "INT32": pa.int32(), "INT64": pa.int64(), "FLOAT": pa.float32(), "DOUBLE": pa.float64()}
Bad = Callable[[str], Exception]


def hybrid(data: bytes, width: int, count: int, bad: Bad) -> np.ndarray:
    """Numbers in runs and bit-packed groups of eight; all bytes are used, and padding fills a last group only."""
    if not 0 <= width <= 32:
        raise bad(f"numbers of {width} bits")
    out, at, left = [np.empty(0, np.int64)], 0, count
    while left:
        head = shift = 0
        while True:
            if at >= len(data) or shift > 28:
                raise bad("a run has no whole header")
            head |= (data[at] & 0x7F) << shift
            at += 1
            shift += 7
            if data[at - 1] < 0x80:
                break
        n = head >> 1
        if not n:
            raise bad("a run is empty")
        size = n * width if head & 1 else (width + 7) // 8
        if size > len(data) - at:
            raise bad("a run ends early")
        body = data[at : at + size]
        at += size
        if head & 1:
            if 8 * n - left >= 8:
                raise bad("a run has more padding than a group")
            bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").reshape(8 * n, width) if width else np.zeros((8 * n, 0), np.uint8)
            out.append((bits.astype(np.int64) << np.arange(width)).sum(axis=1)[:left])
            left -= min(left, 8 * n)
        else:
            if n > left:
                raise bad("a run is longer than its page")
            value = int.from_bytes(body, "little")
            if value >> width:
                raise bad("a run's number has more bits than it may")
            out.append(np.full(n, value, np.int64))
            left -= n
    if at != len(data):
        raise bad("bytes follow the last run")
    return np.concatenate(out)


def plain(data: bytes, n: int, physical: str, width: int | None, options: ReaderOptions, bad: Bad) -> list | np.ndarray:
    """n values; the bytes must be theirs exactly."""
    if physical in DTYPES:
        kind = np.dtype(DTYPES[physical])
        if len(data) != n * kind.itemsize:
            raise bad("values have another size than their page")
        return np.frombuffer(data, kind)
    if physical == "BOOLEAN":
        if len(data) != (n + 7) // 8:
            raise bad("values have another size than their page")
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)
    if physical == "FIXED_LEN_BYTE_ARRAY":
        if len(data) != n * width:
            raise bad("values have another size than their page")
        return [data[i : i + width] for i in range(0, len(data), width)]
    out, at = [], 0
    for _ in range(n):
        if at + 4 > len(data):
            raise bad("a value's length is missing")
        (size,) = struct.unpack_from("<i", data, at)
        at += 4
        if size < 0 or size > len(data) - at:
            raise bad("a value is longer than its page")
        if size > options.binary_value_bytes:
            raise LimitExceededError("a binary value passes the limit of bytes")
        out.append(data[at : at + size])
        at += size
    if at != len(data):
        raise bad("bytes follow the last value")
    return out


def pages_of(
    source: RangeSource, meta: FileMetadata, chunk: Chunk, options: ReaderOptions | None = None, rows: tuple[int, int] | None = None
) -> Iterator[tuple[Page, int, pa.Array]]:
    """Each data page of a chunk, the group's row of its first value, and its values, nulls in place.

    rows: a range of the group's rows; what walk_payloads doesn't read has no values.
    """
    options = options or ReaderOptions()
    e = meta.columns[chunk.column].element
    physical, width, optional = e.physical, e.raw.get("type_length"), e.repetition == "OPTIONAL"
    kind = ARROW.get(physical, pa.binary())
    dictionary: list | np.ndarray = []
    for page, h, data, where in walk_payloads(source, meta, chunk, options, rows_of=rows):

        def bad(message: str, where=where) -> Exception:  # noqa: ANN001
            return where(message)

        body = h[page.kind]
        if page.kind == "dictionary":
            dictionary = plain(data, page.values, physical, width, options, bad)
            continue
        if data is None:
            yield page, page.row, pa.array([], kind)
            continue
        n, at = page.values, 0
        if rows and len(data) < page.uncompressed and page.encoding == PLAIN and not optional:
            low, high = needed(page, rows)
            yield page, page.row + low, pa.array(plain(data, high - low, physical, width, options, bad), kind)
            continue
        valid = np.ones(n, bool)
        if page.kind == "v2":
            at = body["definition_bytes"]
            if optional:
                valid = hybrid(data[:at], 1, n, bad).astype(bool)
            if n - int(valid.sum()) != body["nulls"]:
                raise bad("a page has another number of nulls than it says")
        elif optional:
            if len(data) < 4:
                raise bad("a page has no definition levels")
            at = 4 + int.from_bytes(data[:4], "little")
            if at > len(data):
                raise bad("definition levels are longer than their page")
            valid = hybrid(data[4:at], 1, n, bad).astype(bool)
        count, values = int(valid.sum()), data[at:]
        if body["encoding"] == PLAIN:
            found = plain(values, count, physical, width, options, bad)
        else:
            if not values and count:
                raise bad("a page has no indices")
            at = hybrid(values[1:], values[0], count, bad) if values else np.empty(0, np.int64)
            if len(at) and int(at.max()) >= len(dictionary):
                raise bad("an index lies outside the dictionary")
            found = dictionary[at] if isinstance(dictionary, np.ndarray) else [dictionary[i] for i in at.tolist()]
        if valid.all():
            yield page, page.row, pa.array(found, kind)
        else:
            place = np.cumsum(valid) - 1
            taken = pa.array(found, kind).take(pa.array(np.where(valid, place, 0), mask=~valid)) if count else pa.nulls(n, kind)
            yield page, page.row, taken


def chunk_array(source: RangeSource, meta: FileMetadata, chunk: Chunk, options: ReaderOptions | None = None, rows: tuple[int, int] | None = None) -> pa.Array:
    """All values of a chunk, or those of a range of the group's rows."""
    kind = ARROW.get(meta.columns[chunk.column].element.physical, pa.binary())
    found = [(first, a) for _, first, a in pages_of(source, meta, chunk, options, rows) if len(a)]
    whole = pa.concat_arrays([pa.array([], kind), *(a for _, a in found)])
    return whole if rows is None else whole.slice(rows[0] - found[0][0] if found else 0, rows[1] - rows[0])
