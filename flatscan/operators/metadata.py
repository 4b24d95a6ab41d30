"""Footers and pages as DataFrames, one row a thing.

``path`` is a file, a folder or a glob. One file is parsed on the driver; many
are parsed on executors, each file by one task, and no footer passes the driver.
Pages are walked a column chunk at a time; a worker that goes on with the same
file doesn't parse its footer again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..options import ReaderOptions
from ..sources import annotations as an
from ..sources.footer import ENCODINGS, FileMetadata, open_metadata
from ..sources.pages import walk
from ..sources.ranges import PathSource, RangeSource, filesystem


class HadoopSource:
    """A file of any file system that the session knows, read on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.read_bytes = jvm.org.apache.commons.io.IOUtils.toByteArray
        self.length = self.fs.getFileStatus(self.path).getLen()

    def read(self, offset: int, size: int) -> bytes:
        stream = self.fs.open(self.path)
        try:
            stream.seek(offset)
            return bytes(self.read_bytes(stream, size)) if size else b""
        finally:
            stream.close()

    def close(self) -> None:
        pass


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files at a path, sorted; names that start with _ or . are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(p) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if s.isFile() and s.getPath().getName()[0] not in "_.":
                found.append(s.getPath().toString())
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def file_rows(m: FileMetadata) -> Iterator[tuple]:
    yield m.version, m.rows, len(m.groups), len(m.columns), len(m.elements), m.created_by, m.encrypted, m.length, m.footer_offset


def element_rows(m: FileMetadata) -> Iterator[tuple]:
    for e in m.elements:
        raw, meaning = e.raw, e.meaning
        modern, code = raw.get("logical"), raw.get("converted")
        yield (
            e.ordinal, e.parent, raw["name"], list(e.path), raw.get("type"), e.physical, raw.get("type_length"),
            raw.get("repetition"), e.repetition, raw.get("children"), raw.get("field_id"),
            code, an.LEGACY[code] if code is not None and 0 <= code < len(an.LEGACY) else None,
            modern and modern["member"], modern and an.MODERN.get(modern["member"]),
            raw.get("scale"), raw.get("precision"), e.status, *(meaning or (None,) * 7), e.max_definition, e.max_repetition,
        )


def column_rows(m: FileMetadata) -> Iterator[tuple]:
    for c in m.columns:
        yield c.ordinal, c.element.ordinal, c.name, list(c.element.path), c.reason is None, c.reason, m.orders[c.ordinal] if m.orders else "ABSENT"


def group_rows(m: FileMetadata) -> Iterator[tuple]:
    for g in m.groups:
        yield g.ordinal, g.offset, g.rows, g.raw["bytes"], g.raw.get("compressed"), g.raw.get("file_offset")


def chunk_rows(m: FileMetadata) -> Iterator[tuple]:
    for g in m.groups:
        for c in g.chunks:
            x, raw = c.meta, c.raw
            yield (
                c.group, c.column, x["path"], x["type"], an.physical_name(x["type"]), x["codec"], c.codec,
                x["encodings"], [ENCODINGS.get(e) for e in x["encodings"]], x["values"], x["uncompressed"], x["compressed"],
                raw["file_offset"], x["data_page"], x.get("dictionary_page"), x.get("index_page"),
                raw.get("offset_index"), raw.get("offset_index_length"), raw.get("column_index"), raw.get("column_index_length"),
                x.get("bloom_offset"), x.get("bloom_length"), raw.get("file_path"), "crypto" in raw, "encrypted" in raw,
                [(k["key"], k.get("value")) for k in x.get("key_values", [])],
            )


def statistics_rows(m: FileMetadata) -> Iterator[tuple]:
    names = ("legacy_min", "legacy_max", "min", "max", "null_count", "distinct_count", "min_exact", "max_exact", "nan_count")
    for g in m.groups:
        for c in g.chunks:
            s = c.meta.get("statistics")
            yield c.group, c.column, c.meta["path"], s is not None, *((s or {}).get(n) for n in names)


def key_value_rows(m: FileMetadata) -> Iterator[tuple]:
    yield from ((i, k, v) for i, (k, v) in enumerate(m.key_values))


TABLES: dict[str, tuple[str, Callable[[FileMetadata], Iterator[tuple]]]] = {
    "file_metadata": ("version int, row_count bigint, row_groups int, leaf_columns int, schema_elements int, created_by string, encrypted boolean, length bigint, footer_offset bigint", file_rows),
    "schema_elements": (
        "ordinal int, parent int, name string, path array<string>, type_code int, physical_type string, type_length int, repetition_code int, repetition string, children int, field_id int, "
        "converted_code int, converted_type string, logical_code int, logical_type string, scale int, precision int, status string, semantic_kind string, semantic_scale int, semantic_precision int, "
        "time_unit string, adjusted_to_utc boolean, integer_width int, integer_signed boolean, max_definition int, max_repetition int",
        element_rows,
    ),
    "columns": ("ordinal int, element int, name string, path array<string>, is_readable boolean, unsupported_reason string, column_order string", column_rows),
    "row_groups": ("ordinal int, row_offset bigint, row_count bigint, total_byte_size bigint, total_compressed_size bigint, file_offset bigint", group_rows),
    "column_chunks": (
        "row_group int, column int, path array<string>, type_code int, physical_type string, codec_code int, codec string, encoding_codes array<int>, encodings array<string>, value_count bigint, "
        "total_uncompressed_size bigint, total_compressed_size bigint, file_offset bigint, data_page_offset bigint, dictionary_page_offset bigint, index_page_offset bigint, offset_index_offset bigint, "
        "offset_index_length int, column_index_offset bigint, column_index_length int, bloom_filter_offset bigint, bloom_filter_length int, external_file string, has_crypto_metadata boolean, "
        "has_encrypted_metadata boolean, key_values array<struct<key:string,value:string>>",
        chunk_rows,
    ),
    "chunk_statistics": (
        "row_group int, column int, path array<string>, present boolean, legacy_min binary, legacy_max binary, min binary, max binary, null_count bigint, distinct_count bigint, min_exact boolean, "
        "max_exact boolean, nan_count bigint",
        statistics_rows,
    ),
    "key_values": ("ordinal int, key string, value string", key_value_rows),
}
PAGES = (
    "row_group int, column int, page int, kind string, offset bigint, header_bytes int, compressed_bytes int, uncompressed_bytes int, values bigint, nulls bigint, encoding_code int, "
    "row_in_group bigint, crc string"
)


def metadata(spark: SparkSession, path: str, table: str, options: ReaderOptions | None = None) -> DataFrame:
    """A metadata table of all files at the path, with the file's name first."""
    ddl, rows = TABLES[table]
    found = files(spark, path)
    schema = StructType.fromDDL(f"file string, {ddl}")
    if len(found) == 1:
        m = open_metadata(HadoopSource(spark, found[0]), options)
        return spark.createDataFrame([(found[0], *r) for r in rows(m)], schema)
    return _on_executors(spark.createDataFrame([(f,) for f in found], "file string").repartition(len(found)), schema, lambda r: ((r["file"], *x) for x in rows(_open(r["file"], options)[1])))


def pages(spark: SparkSession, path: str, columns: list[int] | None = None, payloads: bool = False, options: ReaderOptions | None = None) -> DataFrame:
    """The pages of all files at the path, walked strictly; column chunks are dealt to the tasks."""
    chunks = metadata(spark, path, "column_chunks", options).select("file", "row_group", "column")
    if columns is not None:
        chunks = chunks.where(F.col("column").isin(columns))

    def rows(r: dict) -> Iterator[tuple]:
        source, m = _open(r["file"], options)
        try:
            yield from ((r["file"], *p) for p in walk(source, m, m.groups[r["row_group"]].chunks[r["column"]], options, payloads))
        finally:
            source.close()

    return _on_executors(chunks.repartition("file", "row_group", "column"), StructType.fromDDL(f"file string, {PAGES}"), rows)


#: The footer that this worker parsed last, by what tells files and options apart.
_parsed: dict[tuple, FileMetadata] = {}


def _open(path: str, options: ReaderOptions | None) -> tuple[RangeSource, FileMetadata]:
    source = PathSource(path)
    fs, name = filesystem(path)
    key = path, source.length, fs.get_file_info(name).mtime_ns, options
    if key not in _parsed:
        m = open_metadata(source, options)
        _parsed.clear()
        _parsed[key] = m
    return source, _parsed[key]


def _on_executors(df: DataFrame, schema: StructType, fn: Callable[[dict], Iterator[tuple]], lot: int = 4096) -> DataFrame:
    """The tuples that fn makes of each row, in batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held: list[tuple] = []
                for x in fn(r):
                    held.append(x)
                    if len(held) == lot:
                        yield _batch(held, arrow)
                        held = []
                yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(_structs(c, f.type), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _structs(column: tuple, kind: pa.DataType) -> list:
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = [f.name for f in kind.value_type]
        return [[dict(zip(names, y, strict=True)) for y in x] for x in column]
    return list(column)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Chunks and sizes by column path, from metadata alone."""
    return (
        metadata(spark, path, "column_chunks")
        .groupBy("path")
        .agg(F.count("*").alias("chunks"), F.sum("value_count").alias("values"), F.sum("total_compressed_size").alias("compressed_bytes"), F.sum("total_uncompressed_size").alias("uncompressed_bytes"))
    )
