"""The row-group lane: a data source whose partitions are runs of selected row groups.

Groups that aren't selected are never opened, and no batch crosses groups. Each
task holds one Arrow batch of the target size at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.physical import physical_array
from .ranges import filesystem

NAME = "flatscan_row_groups"


class Leaf(NamedTuple):
    """What decoding asks of a schema element."""

    path: tuple[str, ...]
    physical: str
    raw: dict[str, Any]


class Segments(InputPartition):
    """(group, rows to skip, rows, first row in the file) of each segment."""

    def __init__(self, segments: list[list[int]]):
        self.segments = segments


class RowGroupSource(DataSource):
    """Options: path, target, and as JSON the leaves to read, their names in the output, and the segments of each partition.

    The schema is given by the reader's caller, who has parsed the footer.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowGroupReader(self.options)


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.target = options["path"], int(options["target"])
        self.leaves = [Leaf(tuple(x["path"]), x["physical"], {"type_length": x["type_length"]}) for x in json.loads(options["leaves"])]
        self.names, self.parts = json.loads(options["names"]), json.loads(options["partitions"])

    def partitions(self) -> list[InputPartition]:
        return [Segments(x) for x in self.parts] or [Segments([])]

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        if not partition.segments:
            return
        fs, name = filesystem(self.path)
        with fs.open_input_file(name) as f:
            file = pq.ParquetFile(f, page_checksum_verification=True)
            for segment in partition.segments:
                yield from self._segment(file, *segment)

    def _segment(self, file: pq.ParquetFile, group: int, skip: int, count: int, first: int) -> Iterator[pa.RecordBatch]:
        paths = [".".join(e.path) for e in self.leaves]
        at, end, row = 0, skip + count, first - skip
        for batch in file.iter_batches(self.target, row_groups=[group], columns=list(dict.fromkeys(paths))):
            low, high = max(at, skip), min(at + batch.num_rows, end)
            if low < high:
                part = batch.slice(low - at, high - low)
                arrays = [physical_array(part.column(batch.schema.names.index(p)), e) for p, e in zip(paths, self.leaves, strict=True)]
                rows = pa.array(range(row + low, row + high), pa.int64())
                groups = pa.array([group] * (high - low), pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays, rows, groups], [*self.names, "row_index", "row_group"])
            at += batch.num_rows
            if at >= end:
                return
