"""Projected scans: chosen columns over chosen row groups and rows of one file, or over all rows of many.

The native lane is Spark's own reader; column pruning, codecs and decoding are
Spark's, and rows are kept by their index, so it reads every group. The row-group
lane opens selected groups only. Both give physical values, with the row's place
in the file. Unless a lane is named, a scan of less than half of a file's rows
takes the row-group lane, any other the native one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import UnsupportedFeatureError
from ..functions.physical import PLAIN_TYPES, payload_bytes, physical_value, read_type, seen_by_spark
from ..options import ReaderOptions, RowRange, ScanOptions
from ..plans.preflight import ScanPlan, plan
from ..sources.decode import chunk_array
from ..sources.footer import FileMetadata, open_metadata
from ..sources.ranges import PathSource
from ..sources.row_groups import NAME, RowGroupSource
from .metadata import HadoopSource, files


def single_file(spark: SparkSession, path: str) -> str:
    """The one file at a path; row numbers are those of a file, so a scan has one."""
    found = files(spark, path)
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} files; a scan reads one")
    return found[0]


def describe(spark: SparkSession, path: str, scan: ScanOptions, options: ReaderOptions | None = None) -> tuple[str, FileMetadata, ScanPlan]:
    """File, metadata and plan; every error of a wrong argument or an unreadable chunk comes here."""
    file = single_file(spark, path)
    meta = open_metadata(HadoopSource(spark, file), options)
    return file, meta, plan(meta, scan, options)


def scan(
    spark: SparkSession,
    path: str,
    columns: list[str | int],
    row_groups: list[int] | None = None,
    rows: RowRange | None = None,
    target_rows: int = 65_536,
    lane: str | None = None,
    identity: bool = False,
    options: ReaderOptions | None = None,
) -> DataFrame:
    """The chosen columns, in the given order, as physical values.

    identity adds row_index (in the file) and row_group. Rows come in no order;
    sort by row_index where order counts. lane is "native", "row_group", "strict",
    which decodes by this library's own rules and fails where they do, or None:
    the cheaper one of the first two.
    """
    file, meta, p = describe(spark, path, ScanOptions(columns, row_groups, rows, target_rows), options)
    if lane not in (None, "native", "row_group", "strict"):
        raise ValueError(f"there is no lane {lane!r}")
    if lane is None:
        lane = "row_group" if 2 * sum(s.count for s in p.segments) < meta.rows else "native"
    if lane == "native":
        return _native(spark, file, meta, p, identity)
    out = _row_groups(spark, file, meta, p) if lane == "row_group" else _strict(spark, file, p, options)
    return out if identity else out.drop("row_index", "row_group")


def scan_files(spark: SparkSession, path: str, columns: list[str | int], identity: bool = False, options: ReaderOptions | None = None) -> DataFrame:
    """The chosen columns of all files at a path (a file, a folder or a glob), as physical values, by the native lane.

    identity adds file and row_index, which counts from 0 in each file. The footers
    are checked on the driver, one after another, before anything is read; files whose
    columns have one form are read together, so that the plan doesn't grow with them.
    """
    forms: dict[tuple, tuple[list[str], ScanPlan]] = {}
    kinds: dict[tuple, str] = {}
    for file in files(spark, path):
        _, meta, p = describe(spark, file, ScanOptions(columns), options)
        _by_name(meta, p)
        forms.setdefault(tuple((c.name, c.element.physical, seen_by_spark(c.element)) for c in p.columns), ([], p))[0].append(file)
        kinds.setdefault(tuple((c.name, c.element.physical) for c in p.columns), file)
    if len(kinds) > 1:
        raise ValueError(f"{' and '.join(list(kinds.values())[:2])} differ in the columns' names or physical types")
    place = {"file": "file_path", "row_index": "row_index"} if identity else {}
    return reduce(DataFrame.union, [_read(spark, paths, p, place) for paths, p in forms.values()])


def _by_name(meta: FileMetadata, p: ScanPlan) -> None:
    names = [c.name for c in meta.columns if c.element.parent == 0]
    if any(names.count(c.name) > 1 for c in p.columns):
        raise UnsupportedFeatureError("a column's name repeats; the row-group lane reads it by ordinal")


def _read(spark: SparkSession, paths: list[str], p: ScanPlan, place: dict[str, str]) -> DataFrame:
    """Physical values of files of one form, with fields of where their rows are, by their new names."""
    schema = StructType([StructField(c.name, read_type(c.element)) for c in p.columns])
    values = [physical_value(F.col(f"`{c.name}`"), c.element).alias(n) for c, n in zip(p.columns, p.names, strict=True)]
    return spark.read.schema(schema).parquet(*paths).select(*values, *(F.col(f"_metadata.{x}").alias(n) for n, x in place.items()))


#: So many intervals of rows are tested one by one; more are looked up.
FEW = 8
PLACES = "bucket bigint, low bigint, high bigint, row_group bigint"


def _native(spark: SparkSession, file: str, meta: FileMetadata, p: ScanPlan, identity: bool) -> DataFrame:
    _by_name(meta, p)
    df = _read(spark, [file], p, {"row_index": "row_index"})
    runs: list[list[int]] = []
    for s in p.segments:  # neighbouring segments are one interval
        if runs and runs[-1][1] == s.start:
            runs[-1][1] += s.count
        else:
            runs.append([s.start, s.start + s.count])
    whole, at = runs == [[0, meta.rows]], F.col("row_index")
    out = [*p.names, "row_index", "row_group"]
    if len(runs) <= FEW and (not identity or len(p.segments) <= FEW):
        if not whole:
            df = df.where(reduce(lambda x, y: x | y, [(at >= a) & (at < b) for a, b in runs], F.lit(False)))
        group = reduce(lambda x, s: F.when(at >= s.start, F.lit(s.group).cast("long")).otherwise(x), p.segments, F.lit(None).cast("long"))
        return df.withColumn("row_group", group).select(out) if identity else df.select(p.names)
    # a row finds its segment among those of its bucket; a plan's depth doesn't grow with the segments
    step = max(1, meta.rows // (2 * len(p.segments)))
    pieces = [(k, s.start, s.start + s.count, s.group) for s in p.segments for k in range(s.start // step, (s.start + s.count - 1) // step + 1)]
    places = F.broadcast(spark.createDataFrame(pieces, PLACES))
    found = df.withColumn("bucket", F.floor(at / step)).join(places, "bucket").where((at >= F.col("low")) & (at < F.col("high")))
    return found.select(out if identity else p.names)


#: Compressed bytes of the chosen chunks that one partition of the row-group lane reads, if a group has no more.
PARTITION_BYTES = 16 << 20


def _row_groups(spark: SparkSession, file: str, meta: FileMetadata, p: ScanPlan) -> DataFrame:
    """Partitions of neighbouring segments; the footer is parsed once, on the driver."""
    spark.dataSource.register(RowGroupSource)
    partitions: list[list[list[int]]] = []
    room = 0
    for s in p.segments:
        group = meta.groups[s.group]
        size = sum(group.chunks[c.ordinal].meta["compressed"] for c in p.columns)
        if size > room:
            partitions.append([])
            room = PARTITION_BYTES
        partitions[-1].append([s.group, s.start - group.offset, s.count, s.start])
        room -= size
    leaves = [{"path": c.element.path, "physical": c.element.physical, "type_length": c.element.raw.get("type_length")} for c in p.columns]
    fields = [StructField(n, PLAIN_TYPES[c.element.physical]) for n, c in zip(p.names, p.columns, strict=True)]
    return (
        spark.read.format(NAME)
        .schema(StructType([*fields, StructField("row_index", LongType()), StructField("row_group", LongType())]))
        .option("path", file)
        .option("leaves", json.dumps(leaves))
        .option("names", json.dumps(p.names))
        .option("partitions", json.dumps(partitions))
        .option("target", str(p.target_rows))
        .load()
    )


def _strict(spark: SparkSession, file: str, p: ScanPlan, options: ReaderOptions | None) -> DataFrame:
    """One task a row group; it holds the projected columns of one group."""
    fields = [StructField(n, PLAIN_TYPES[c.element.physical]) for n, c in zip(p.names, p.columns, strict=True)]
    schema = StructType([*fields, StructField("row_index", LongType()), StructField("row_group", LongType())])
    ordinals, names, target = [c.ordinal for c in p.columns], schema.names, p.target_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = PathSource(file)
        try:
            meta = open_metadata(source, options)
            for s in (r for b in batches for r in b.to_pylist()):
                group = meta.groups[s["g"]]
                first = s["start"] - group.offset
                arrays = [chunk_array(source, meta, group.chunks[i], options, (first, first + s["n"])) for i in ordinals]
                for a in range(0, s["n"], target):
                    n = min(target, s["n"] - a)
                    place = [pa.array(range(s["start"] + a, s["start"] + a + n), pa.int64()), pa.array([s["g"]] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(x.slice(a, n) for x in arrays), *place], names)
        finally:
            source.close()

    segments = spark.createDataFrame([tuple(s) for s in p.segments], "g int, start bigint, n bigint")
    return segments.repartition(max(1, len(p.segments))).mapInArrow(run, schema)


def oversized_values(df: DataFrame, columns: list[str], options: ReaderOptions | None = None) -> DataFrame:
    """Rows of a scan with a binary value over the limit."""
    limit = (options or ReaderOptions()).binary_value_bytes
    return df.where(reduce(lambda x, y: x | y, [payload_bytes(F.col(c)) > limit for c in columns], F.lit(False)))
