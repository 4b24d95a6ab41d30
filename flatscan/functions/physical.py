"""Physical values of columns that Spark and Arrow read as logical ones, and batch views."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import annotations as an
from ..sources.footer import Element

PLAIN_TYPES = {"BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BYTE_ARRAY": T.BinaryType(), "FIXED_LEN_BYTE_ARRAY": T.BinaryType()}
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seen_by_spark(e: Element) -> an.Meaning | None:
    """What Spark's reader takes an element for: the modern annotation first, valid or not."""
    if "logical" in e.raw:
        return an.modern_meaning(e.raw["logical"])
    return an.legacy_meaning(e.raw["converted"], e.raw.get("scale"), e.raw.get("precision")) if "converted" in e.raw else None


def read_type(e: Element) -> T.DataType:
    """The type to read a leaf as, so that its physical value can be had."""
    m, plain = seen_by_spark(e), PLAIN_TYPES[e.physical]
    if m is None or e.physical not in ("INT32", "INT64"):
        return plain
    if m.kind == "DATE":
        return T.DateType()
    if m.kind == "DECIMAL":
        return T.DecimalType(m.precision, m.scale)
    if m.kind == "TIMESTAMP" and m.unit != "NANOS":
        return T.TimestampType() if m.adjusted else T.TimestampNTZType()
    if m.kind == "INTEGER":
        signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
        unsigned = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
        return (signed if m.signed else unsigned)[m.width]
    return plain


def physical_value(c: SparkColumn, e: Element) -> SparkColumn:
    """The physical value of a leaf that was read as ``read_type``; independent of the session's time zone."""
    m, kind = seen_by_spark(e), read_type(e)
    plain = PLAIN_TYPES[e.physical]
    if kind == plain:
        return c
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) if m.unit == "MICROS" else F.unix_millis(c)
    if isinstance(kind, T.TimestampNTZType):
        unit = "MICROSECOND" if m.unit == "MICROS" else "MILLISECOND"
        return F.timestamp_diff(unit, F.expr(EPOCH), c)
    if m.kind == "DECIMAL":
        return (c.cast(f"decimal(38,{m.scale})") * F.lit(10**m.scale)).cast(plain)
    if not m.signed and m.width >= 32:
        half, whole = (F.lit(Decimal(1 << b)) for b in (m.width - 1, m.width))
        wide = c.cast("decimal(38,0)")
        return F.when(wide >= half, wide - whole).otherwise(wide).cast(plain)
    return c.cast(plain)


def physical_array(a: pa.Array, e: Element) -> pa.Array:
    """The same for an Arrow array."""
    want = {"BOOLEAN": pa.bool_(), "INT32": pa.int32(), "INT64": pa.int64(), "FLOAT": pa.float32(), "DOUBLE": pa.float64()}.get(e.physical, pa.binary())
    kind = a.type
    if kind == want:
        return a
    if pa.types.is_dictionary(kind):
        return physical_array(a.cast(kind.value_type), e)
    if pa.types.is_temporal(kind):
        return a.view(pa.int32() if kind.bit_width == 32 else pa.int64()).cast(want)
    if pa.types.is_unsigned_integer(kind):
        return a.view(want) if kind.bit_width == want.bit_width else a.cast(want)
    if pa.types.is_decimal(kind):
        if pa.types.is_binary(want):
            width = e.raw.get("type_length")
            raw = [None if x is None else int(x.scaleb(kind.scale)).to_bytes(width or (int(x.scaleb(kind.scale)).bit_length() + 8) // 8, "big", signed=True) for x in a.to_pylist()]
            return pa.array(raw, want)
        return pa.array([None if x is None else int(x.scaleb(kind.scale)) for x in a.to_pylist()], want)
    if pa.types.is_null(kind):
        return pa.nulls(len(a), want)
    if pa.types.is_float16(kind):
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2), len(a), a.buffers(), offset=a.offset).cast(want)
    if isinstance(kind, pa.ExtensionType):
        return physical_array(a.storage, e)
    return pc.cast(a, want)


def validity_byte(valid: SparkColumn, place: SparkColumn) -> SparkColumn:
    """One byte of a bitmap, the first row in the lowest bit; an aggregate over groups of eight rows."""
    return F.bit_or(F.call_function("shiftleft", valid.cast("int"), F.pmod(place, F.lit(8)).cast("int")))


def payload_bytes(value: SparkColumn) -> SparkColumn:
    """Bytes that a value adds to a batch's payload; none for a null."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
