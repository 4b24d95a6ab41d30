"""A file's footer: read, decoded by tables of the public format, and checked."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, NamedTuple

from ..errors import FormatError, LimitExceededError, UnsupportedFeatureError
from ..options import ReaderOptions
from . import annotations as an
from .ranges import RangeSource, read_exactly
from .thrift import ANY, BINARY, BOOL, DOUBLE, I8, I16, I32, I64, Decoder, Many, Struct, Text  # noqa: F401

MAGIC, ENCRYPTED = b"PAR1", b"PARE"
#: Codecs, encodings, repetitions and column orders by code.
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
REPETITIONS = ("REQUIRED", "OPTIONAL", "REPEATED")
ORDERS = {1: "TYPE_DEFINED", 2: "IEEE_754_TOTAL", 3: "INT96_TIMESTAMP"}
#: Why a leaf can't be read.
NESTED = "Nested leaves are outside the Core 0.1 profile."
REPETITION_MODE = "The repetition mode is outside the Core 0.1 profile."
REPEATED_VALUES = "Repeated values are outside the Core 0.1 profile."
UNKNOWN_TYPE = "The physical type is unknown."
INT96 = "INT96 is outside the Core 0.1 profile."
WIDTH = "The fixed-length byte width is missing or invalid."

# The structures, by field id, as the public format has them.
UNIT = Struct("time unit", {1: ("millis", ANY, False), 2: ("micros", ANY, False), 3: ("nanos", ANY, False)}, union=True)
_TIME = Struct("time type", {1: ("adjusted", BOOL, True), 2: ("unit", UNIT, True)})
_BODIES = {
    5: Struct("decimal type", {1: ("scale", I32, True), 2: ("precision", I32, True)}),
    7: _TIME,
    8: _TIME,
    10: Struct("integer type", {1: ("width", I8, True), 2: ("signed", BOOL, True)}),
}
LOGICAL = Struct("logical type", {i: ("body", _BODIES.get(i, ANY), False) for i in an.MODERN}, union=True)
ELEMENT = Struct(
    "schema element",
    {
        1: ("type", I32, False),
        2: ("type_length", I32, False),
        3: ("repetition", I32, False),
        4: ("name", Text(), True),
        5: ("children", I32, False),
        6: ("converted", I32, False),
        7: ("scale", I32, False),
        8: ("precision", I32, False),
        9: ("field_id", I32, False),
        10: ("logical", LOGICAL, False),
    },
)
KEY_VALUE = Struct("key and value", {1: ("key", Text(), True), 2: ("value", Text(), False)})
STATISTICS = Struct(
    "statistics",
    {
        1: ("legacy_max", BINARY, False),
        2: ("legacy_min", BINARY, False),
        3: ("null_count", I64, False),
        4: ("distinct_count", I64, False),
        5: ("max", BINARY, False),
        6: ("min", BINARY, False),
        7: ("max_exact", BOOL, False),
        8: ("min_exact", BOOL, False),
        9: ("nan_count", I64, False),
    },
    strict=True,
)
COLUMN = Struct(
    "column metadata",
    {
        1: ("type", I32, True),
        2: ("encodings", Many(I32), True),
        3: ("path", Many(Text()), True),
        4: ("codec", I32, True),
        5: ("values", I64, True),
        6: ("uncompressed", I64, True),
        7: ("compressed", I64, True),
        8: ("key_values", Many(KEY_VALUE, "key_value_metadata_entries"), False),
        9: ("data_page", I64, True),
        10: ("index_page", I64, False),
        11: ("dictionary_page", I64, False),
        12: ("statistics", STATISTICS, False),
        14: ("bloom_offset", I64, False),
        15: ("bloom_length", I32, False),
    },
)
CHUNK = Struct(
    "column chunk",
    {
        1: ("file_path", Text(), False),
        2: ("file_offset", I64, True),
        3: ("meta", COLUMN, False),
        4: ("offset_index", I64, False),
        5: ("offset_index_length", I32, False),
        6: ("column_index", I64, False),
        7: ("column_index_length", I32, False),
        8: ("crypto", ANY, False),
        9: ("encrypted", BINARY, False),
    },
)
GROUP = Struct(
    "row group",
    {
        1: ("columns", Many(CHUNK, "leaf_columns"), True),
        2: ("bytes", I64, True),
        3: ("rows", I64, True),
        5: ("file_offset", I64, False),
        6: ("compressed", I64, False),
        7: ("ordinal", I16, False),
    },
)
ORDER = Struct("column order", {i: ("order", ANY, False) for i in ORDERS}, union=True)
FILE = Struct(
    "file metadata",
    {
        1: ("version", I32, True),
        2: ("schema", Many(ELEMENT, "schema_elements"), True),
        3: ("rows", I64, True),
        4: ("groups", Many(GROUP, "row_groups"), True),
        5: ("key_values", Many(KEY_VALUE, "key_value_metadata_entries"), False),
        6: ("created_by", Text(), False),
        7: ("orders", Many(ORDER, "leaf_columns"), False),
        8: ("encryption", ANY, False),
        9: ("signing_key", BINARY, False),
    },
)


class Element(NamedTuple):
    ordinal: int
    parent: int | None
    path: tuple[str, ...]
    raw: dict[str, Any]
    status: str
    meaning: an.Meaning | None
    max_definition: int
    max_repetition: int

    @property
    def physical(self) -> str | None:
        return an.physical_name(self.raw.get("type"))

    @property
    def repetition(self) -> str | None:
        code = self.raw.get("repetition")
        return REPETITIONS[code] if code is not None and 0 <= code < 3 else None


class Column(NamedTuple):
    ordinal: int
    element: Element
    reason: str | None  # why it can't be read; None where it can

    @property
    def name(self) -> str:
        return self.element.path[-1]


class Chunk(NamedTuple):
    group: int
    column: int
    raw: dict[str, Any]
    meta: dict[str, Any]

    @property
    def codec(self) -> str | None:
        return CODECS[self.meta["codec"]] if 0 <= self.meta["codec"] < len(CODECS) else None

    @property
    def first_page(self) -> int:
        return min(self.meta["data_page"], self.meta.get("dictionary_page", self.meta["data_page"]))


class Group(NamedTuple):
    ordinal: int
    offset: int  # rows before it
    rows: int
    raw: dict[str, Any]
    chunks: list[Chunk]


@dataclass
class FileMetadata:
    version: int
    rows: int
    created_by: str | None
    elements: list[Element]
    columns: list[Column]
    groups: list[Group]
    key_values: list[tuple[str, str | None]]
    orders: list[str]
    encrypted: bool
    length: int
    footer_offset: int

    def column(self, name: str) -> Column:
        """The top-level column of exactly this name; absent and ambiguous names are usage errors."""
        found = [c for c in self.columns if c.element.path == (name,)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns have the name {name!r}")
        return found[0]


def open_metadata(source: RangeSource, options: ReaderOptions | None = None) -> FileMetadata:
    """The metadata of a file, in three reads."""
    options = options or ReaderOptions()
    n = source.length
    if n < 0:
        raise ValueError("the source's length is negative")
    if n < 12:
        raise FormatError("the input is too short for a file")
    head, tail = read_exactly(source, 0, 4), read_exactly(source, n - 8, 8)
    if head != MAGIC:
        raise FormatError("the file starts with another magic", 0)
    if tail[4:] == ENCRYPTED:
        raise UnsupportedFeatureError("the footer is encrypted", n - 4)
    if tail[4:] != MAGIC:
        raise FormatError("the file ends with another magic", n - 4)
    size = int.from_bytes(tail[:4], "little", signed=True)
    if size < 0:
        raise FormatError("the footer's length is negative", n - 8)
    if size > options.footer_bytes:
        raise LimitExceededError("the footer passes the limit of bytes", n - 8)
    if size > n - 12:
        raise FormatError("the footer lies outside the input", n - 8)
    return parse_footer(read_exactly(source, n - 8 - size, size), n - 8 - size, n, options)


def parse_footer(data: bytes, at: int, length: int, options: ReaderOptions) -> FileMetadata:
    decoder = Decoder(data, at, options)
    raw = decoder.struct(FILE)
    if decoder.at != len(data):
        raise FormatError("bytes follow the file metadata", decoder.offset)
    if raw["version"] not in (1, 2):
        raise UnsupportedFeatureError(f"file metadata of version {raw['version']}", at)
    if raw["rows"] < 0:
        raise FormatError("the file's row count is negative", at)
    elements, columns = _schema(raw["schema"], at, options)
    orders = [ORDERS.get(x["member"], "UNKNOWN") for x in raw.get("orders", [])]
    if orders and len(orders) != len(columns):
        raise FormatError("there are not as many column orders as leaves", at)
    groups, before = [], 0
    for k, g in enumerate(raw["groups"]):
        for name in ("rows", "bytes", "compressed", "file_offset"):
            if g.get(name, 0) < 0:
                raise FormatError(f"a row group's {name} is negative", at)
        if len(g["columns"]) != len(columns):
            raise FormatError("a row group has not one chunk a leaf", at, k)
        chunks = [_chunk(c, column, g["rows"], k, length, at) for c, column in zip(g["columns"], columns, strict=True)]
        groups.append(Group(k, before, g["rows"], g, chunks))
        before += g["rows"]
        if before >= 1 << 63:
            raise FormatError("the row counts add up to more than 64 bits", at)
    if before != raw["rows"]:
        raise FormatError("the file's row count is not the sum of its groups'", at)
    key_values = [(x["key"], x.get("value")) for x in raw.get("key_values", [])]
    encrypted = "encryption" in raw or "signing_key" in raw
    return FileMetadata(raw["version"], raw["rows"], raw.get("created_by"), elements, columns, groups, key_values, orders, encrypted, length, at)


def _schema(raw: list[dict[str, Any]], at: int, options: ReaderOptions) -> tuple[list[Element], list[Column]]:
    if not raw:
        raise FormatError("the schema is empty", at)
    root = raw[0]
    if "type" in root or root.get("repetition", 0) != 0 or root.get("children", -1) < 0:
        raise FormatError("the root of the schema is malformed", at)
    elements = [Element(0, None, (), root, *an.resolve(root), 0, 0)]
    columns: list[Column] = []
    open_groups = [[0, root["children"]]] if root["children"] else []
    for i, x in enumerate(raw[1:], 1):
        if not open_groups:
            raise FormatError("the schema has an element without a parent", at)
        if "repetition" not in x:
            raise FormatError("a schema element has no repetition", at)
        leaf = "type" in x
        if leaf == ("children" in x) or x.get("children", 0) < 0:
            raise FormatError("a schema element is not exactly one of leaf and group", at)
        parent = elements[open_groups[-1][0]]
        open_groups[-1][1] -= 1
        kind = x["repetition"]
        element = Element(i, parent.ordinal, (*parent.path, x["name"]), x, *an.resolve(x), parent.max_definition + (kind in (1, 2)), parent.max_repetition + (kind == 2))
        elements.append(element)
        if leaf:
            if element.physical == "FIXED_LEN_BYTE_ARRAY" and x.get("type_length", 0) <= 0:
                raise FormatError("a fixed-length element has no valid length", at)
            if len(columns) >= options.leaf_columns:
                raise LimitExceededError("the schema passes the limit of leaves", at)
            columns.append(Column(len(columns), element, _reason(element)))
        elif x["children"]:
            if len(open_groups) + 1 > options.thrift_depth:
                raise LimitExceededError("the schema nests too deep", at)
            open_groups.append([i, x["children"]])
        while open_groups and not open_groups[-1][1]:
            open_groups.pop()
    if open_groups:
        raise FormatError("the schema ends before all children", at)
    return elements, columns


def _reason(e: Element) -> str | None:
    tests = (
        (e.parent != 0, NESTED),
        (e.repetition not in ("REQUIRED", "OPTIONAL"), REPETITION_MODE),
        (e.max_repetition != 0, REPEATED_VALUES),
        (e.physical is None, UNKNOWN_TYPE),
        (e.physical == "INT96", INT96),
        (e.physical == "FIXED_LEN_BYTE_ARRAY" and e.raw.get("type_length", 0) <= 0, WIDTH),
    )
    return next((why for bad, why in tests if bad), None)


def _chunk(raw: dict[str, Any], column: Column, rows: int, group: int, length: int, footer: int) -> Chunk:
    def bad(message: str) -> FormatError:
        return FormatError(message, footer, group, column.ordinal)

    def within(what: str, start: int, size: int) -> None:
        if start < 0 or size < 0 or start + size > length:
            raise bad(f"the {what} lies outside the input")
        if start + size > footer:
            raise bad(f"the {what} reaches into the footer")

    meta = raw.get("meta")
    if meta is None:
        raise bad("a column chunk has no metadata")
    for where, name in ((raw, "file_offset"), (meta, "values"), (meta, "uncompressed"), (meta, "compressed"), (meta, "data_page")):
        if where[name] < 0:
            raise FormatError(f"a column chunk's {name} is negative", footer)
    if min(meta.get(k, 0) for k in ("dictionary_page", "index_page", "bloom_offset", "bloom_length")) < 0:
        raise bad("an offset or length of a column chunk is negative")
    for name in ("offset_index", "column_index"):
        if (name in raw) != (f"{name}_length" in raw):
            raise bad(f"the {name} has an offset or a length, not both")
        if name in raw:
            within(name, raw[name], raw[f"{name}_length"])
    if "bloom_length" in meta:
        if "bloom_offset" not in meta:
            raise bad("a bloom filter has a length and no offset")
        within("bloom filter", meta["bloom_offset"], meta["bloom_length"])
    local = "file_path" not in raw
    if local:
        for name in ("index_page", *(() if "bloom_length" in meta else ("bloom_offset",))):
            if name in meta and meta[name] >= min(length, footer):
                raise bad(f"the {name} lies outside the input")
    if tuple(meta["path"]) != column.element.path:
        raise bad("a column chunk's path is not that of its leaf")
    if meta["type"] != column.element.raw["type"]:
        raise bad("a column chunk's physical type is not that of its leaf")
    if column.reason is None and meta["values"] != rows:
        raise bad("a flat column chunk has not as many values as its group rows")
    out = Chunk(group, column.ordinal, raw, meta)
    if local:
        first, size = out.first_page, meta["compressed"]
        within("column chunk", first, size)
        for name in ("dictionary_page", "data_page"):
            if name in meta and not first <= meta[name] < first + size:
                raise bad(f"the {name} lies outside its column chunk")
    if min((meta.get("statistics", {}).get(k, 0) for k in ("null_count", "distinct_count", "nan_count")), default=0) < 0:
        raise bad("column statistics have a negative count")
    return out
