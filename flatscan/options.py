"""Limits of a reader and the description of a scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

MIB = 1 << 20
GIB = 1 << 30
#: Default and ceiling of each limit.
LIMITS = {
    "footer_bytes": (64 * MIB, GIB),
    "thrift_depth": (64, 256),
    "thrift_container_elements": (1_048_576, 16_777_216),
    "schema_elements": (16_384, 1_048_576),
    "leaf_columns": (4_096, 65_536),
    "row_groups": (65_536, 1_048_576),
    "key_value_metadata_entries": (16_384, 1_048_576),
    "metadata_string_bytes": (16 * MIB, 256 * MIB),
    "page_header_bytes": (MIB, 16 * MIB),
    "compressed_page_bytes": (64 * MIB, GIB),
    "uncompressed_page_bytes": (256 * MIB, GIB),
    "pages_per_column_chunk": (1_048_576, 16_777_216),
    "dictionary_entries": (16_777_216, 134_217_728),
    "dictionary_bytes": (256 * MIB, GIB),
    "values_per_page": (16_777_216, 134_217_728),
    "binary_value_bytes": (64 * MIB, GIB),
    "rows_per_batch": (1_048_576, 16_777_216),
    "binary_batch_bytes": (256 * MIB, GIB),
    "scan_pooled_bytes": (512 * MIB, 8 * GIB),
}
TARGET_ROWS = 65_536


@dataclass(frozen=True)
class ReaderOptions:
    """Limits by name; each from 1 to its ceiling."""

    footer_bytes: int = LIMITS["footer_bytes"][0]
    thrift_depth: int = LIMITS["thrift_depth"][0]
    thrift_container_elements: int = LIMITS["thrift_container_elements"][0]
    schema_elements: int = LIMITS["schema_elements"][0]
    leaf_columns: int = LIMITS["leaf_columns"][0]
    row_groups: int = LIMITS["row_groups"][0]
    key_value_metadata_entries: int = LIMITS["key_value_metadata_entries"][0]
    metadata_string_bytes: int = LIMITS["metadata_string_bytes"][0]
    page_header_bytes: int = LIMITS["page_header_bytes"][0]
    compressed_page_bytes: int = LIMITS["compressed_page_bytes"][0]
    uncompressed_page_bytes: int = LIMITS["uncompressed_page_bytes"][0]
    pages_per_column_chunk: int = LIMITS["pages_per_column_chunk"][0]
    dictionary_entries: int = LIMITS["dictionary_entries"][0]
    dictionary_bytes: int = LIMITS["dictionary_bytes"][0]
    values_per_page: int = LIMITS["values_per_page"][0]
    binary_value_bytes: int = LIMITS["binary_value_bytes"][0]
    rows_per_batch: int = LIMITS["rows_per_batch"][0]
    binary_batch_bytes: int = LIMITS["binary_batch_bytes"][0]
    scan_pooled_bytes: int = LIMITS["scan_pooled_bytes"][0]

    def __post_init__(self) -> None:
        for f in fields(self):
            value, ceiling = getattr(self, f.name), LIMITS[f.name][1]
            if not isinstance(value, int) or not 1 <= value <= ceiling:
                raise ValueError(f"{f.name} is {value!r}; it must be from 1 to {ceiling}")


@dataclass(frozen=True)
class RowRange:
    """Rows from ``start``, ``count`` of them; the end stays within 64 bits."""

    start: int
    count: int

    def __post_init__(self) -> None:
        if self.start < 0 or self.count < 0 or self.start + self.count >= 1 << 63:
            raise ValueError(f"rows {self.start} + {self.count} are no range")

    @property
    def end(self) -> int:
        return self.start + self.count


@dataclass(frozen=True)
class ScanOptions:
    """What a scan reads: columns by name or ordinal in output order, row groups (None: all), rows, rows a batch."""

    columns: tuple[str | int, ...]
    row_groups: tuple[int, ...] | None = None
    rows: RowRange | None = None
    target_rows: int = TARGET_ROWS

    def __init__(self, columns: Sequence[str | int], row_groups: Sequence[int] | None = None, rows: RowRange | None = None, target_rows: int = TARGET_ROWS):
        if any(c is None for c in columns) or any(g is None for g in row_groups or ()):
            raise ValueError("a column or row group is None")
        object.__setattr__(self, "columns", tuple(columns))
        object.__setattr__(self, "row_groups", None if row_groups is None else tuple(row_groups))
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "target_rows", target_rows)
