"""Hand-built files: a writer of compact Thrift and of one-column pages."""

import struct
import zlib

BOOL, I8, I32, I64, BIN, LIST, STRUCT = 1, 3, 5, 6, 8, 9, 12


def varint(x):
    out = b""
    while x > 0x7F:
        out += bytes([x & 0x7F | 0x80])
        x >>= 7
    return out + bytes([x])


def zigzag(x):
    return varint((x << 1) ^ (x >> 63) if x >= 0 else (-x << 1) - 1)


def value(kind, x):
    if kind in (I32, I64):
        return zigzag(x)
    if kind == I8:
        return struct.pack("b", x)
    if kind == BIN:
        x = x.encode() if isinstance(x, str) else x
        return varint(len(x)) + x
    if kind == STRUCT:
        return fields(x)
    of, items = x
    head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + varint(len(items))
    return head + b"".join(value(of, i) for i in items)


def fields(rows):
    """A structure of (id, kind, value) rows; ids rise, or else are written in full."""
    out, last = b"", 0
    for number, kind, x in rows:
        wire = (1 if x else 2) if kind == BOOL else kind
        out += bytes([(number - last) << 4 | wire]) if 0 < number - last < 16 else bytes([wire]) + zigzag(number)
        out += b"" if kind == BOOL else value(kind, x)
        last = number
    return out + b"\0"


def leaf(name="value", kind=1, repetition=0, extra=()):
    return sorted([(1, I32, kind), (3, I32, repetition), (4, BIN, name), *extra])


def root(children, name="schema"):
    return [(4, BIN, name), (5, I32, children)]


def page(values, header=None, kind=0, encoding=0, crc=None, body=None, definition=3, compressed=None, uncompressed=None):
    """A V1 data page (kind 0) of INT32 values, or of the given bytes."""
    data = struct.pack(f"<{len(values)}i", *values) if body is None else body
    rows = [(1, I32, kind), (2, I32, len(data) if uncompressed is None else uncompressed), (3, I32, len(data) if compressed is None else compressed)]
    if crc is not None:
        rows.append((4, I32, struct.unpack("<i", struct.pack("<I", zlib.crc32(data) ^ (crc == "bad")))[0]))
    own = {0: (5, [(1, I32, len(values)), (2, I32, encoding), (3, I32, definition), (4, I32, 3)]), 2: (7, [(1, I32, len(values)), (2, I32, encoding)]), 1: (6, [])}
    number, inner = own[kind] if header is None else header
    return fields([*rows, (number, STRUCT, inner)]) + data


def file(groups, names=("value",), version=1, rows=None, schema=None, change_chunk=None, magic=b"PAR1", tail=b"PAR1", more=()):
    """groups: for each group, for each column, (row count, its pages' bytes)."""
    data, wire = magic, []
    for columns in groups:
        chunks = []
        for (n, pages), name in zip(columns, names, strict=True):
            at, body = len(data), b"".join(pages)
            data += body
            meta = {1: (I32, 1), 2: (LIST, (I32, [0, 3])), 3: (LIST, (BIN, [name])), 4: (I32, 0), 5: (I64, n), 6: (I64, len(body)), 7: (I64, len(body)), 9: (I64, at)}
            chunk = {2: (I64, 0)}
            if change_chunk:
                change_chunk(chunk, meta)
            chunk[3] = (STRUCT, [(k, *v) for k, v in sorted(meta.items())])
            chunks.append([(k, *v) for k, v in sorted(chunk.items())])
        n = columns[0][0] if columns else 0
        wire.append([(1, LIST, (STRUCT, chunks)), (2, I64, 0), (3, I64, n)])
    total = sum(c[0][0] for c in groups if c) if rows is None else rows
    schema = [root(len(names)), *(leaf(n) for n in names)] if schema is None else schema
    footer = fields([(1, I32, version), (2, LIST, (STRUCT, schema)), (3, I64, total), (4, LIST, (STRUCT, wire)), *more])
    return data + footer + struct.pack("<i", len(footer)) + tail


def column(*pages, **options):
    """(row count, pages) of INT32 pages."""
    return sum(map(len, pages)), [page(p, **options) for p in pages]
