"""Batches as relations: where they start, and what their views hold.

A batch covers at most one page of every projected column, never crosses a row
group, and has the target number of rows at most, counted from each column's page
starts. Row groups are handled apart, so no window holds more than a group's
pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import LimitExceededError
from ..functions.physical import payload_bytes, validity_byte
from ..options import ReaderOptions, ScanOptions
from .metadata import pages
from .scan import describe


def batch_identity(spark: SparkSession, path: str, scan: ScanOptions, options: ReaderOptions | None = None) -> DataFrame:
    """(row_offset, row_group, offset_in_group, row_count) of each batch of a scan.

    Exact as long as no byte limit shortens a batch; the session applies those.
    """
    _, meta, p = describe(spark, path, scan, options)
    segments = spark.createDataFrame(
        [(s.group, meta.groups[s.group].offset, s.start, s.start + s.count) for s in p.segments], "row_group int, group_offset bigint, low bigint, high bigint"
    )
    starts = pages(spark, path, [c.ordinal for c in p.columns], options=options).where("kind <> 'dictionary' and values > 0")
    starts = starts.select("column", "row_group", "row_in_group", "values").join(F.broadcast(segments), "row_group")
    first = F.col("group_offset") + F.col("row_in_group")
    cut = starts.select("row_group", "group_offset", "high", F.greatest("low", first).alias("a"), F.least("high", first + F.col("values")).alias("b")).where("a < b")
    cuts = cut.select("row_group", "group_offset", "high", F.explode(F.sequence("a", F.col("b") - 1, F.lit(p.target_rows).cast("long"))).alias("row_offset")).distinct()
    after = F.lead("row_offset").over(Window.partitionBy("row_group").orderBy("row_offset"))
    return cuts.select("row_offset", "row_group", (F.col("row_offset") - F.col("group_offset")).alias("offset_in_group"), (F.coalesce(after, "high") - F.col("row_offset")).alias("row_count"))


def fixed_batches(rows: DataFrame, target: int) -> DataFrame:
    """Batches of ``target`` rows from a row-indexed scan: first row and row count."""
    batch = F.floor(F.col("row_index") / target).alias("batch")
    return rows.groupBy(batch).agg(F.min("row_index").alias("row_offset"), F.count("*").alias("row_count"))


def validity(rows: DataFrame, value: Column, place: str = "row_index") -> DataFrame:
    """(byte_index, bits): the validity bitmap of a column, eight rows a byte, the first row lowest."""
    return rows.groupBy(F.floor(F.col(place) / 8).alias("byte_index")).agg(validity_byte(value.isNotNull(), F.col(place)).alias("bits"))


def offsets(rows: DataFrame, value: str, group: Column, place: str = "row_index") -> DataFrame:
    """rows with ``begin`` and ``end`` of each value in its batch's payload; a null's are equal."""
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(payload_bytes(F.col(value))).over(w)
    return rows.withColumns({"begin": upto - payload_bytes(F.col(value)), "end": upto})


def capped_rows(rows: DataFrame, values: list[str], group: Column, options: ReaderOptions | None = None, place: str = "row_index") -> DataFrame:
    """rows with ``payload``, the batch's binary bytes up to each; a single row over the limit is an error."""
    limit = (options or ReaderOptions()).binary_batch_bytes
    own = sum((payload_bytes(F.col(v)) for v in values), F.lit(0).cast("long"))
    if worst := rows.agg(F.max(own)).head()[0]:
        if worst > limit:
            raise LimitExceededError(f"a row has {worst} bytes of binary values")
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("payload", F.sum(own).over(w))
