"""The truth contract of scans: a hash of each column's values in row order."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: first state, multiplier, and the mark after a binary value.
SEED, PRIME, SEPARATOR = 1_469_598_103_934_665_603, 1_099_511_628_211, 0x100
_MASK = (1 << 64) - 1


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def mix(state: int, value: int) -> int:
    """value counts as a signed 32-bit number."""
    return (state * PRIME ^ _signed(value, 32)) & _MASK


def mix_long(state: int, value: int) -> int:
    return mix(mix(state, value), value >> 32)


def _numbers(values: pa.Array, physical: str) -> list[int]:
    """The 32-bit numbers that the hash takes of values, none of which is null."""
    if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        a = values.cast(pa.large_binary())
        ends = np.frombuffer(a.buffers()[1], "<i8")[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, "<i8")
        out = np.full(ends[-1] - ends[0] + len(a), SEPARATOR, "<i4")
        octets = np.ones(len(out), bool)
        octets[ends[1:] - ends[0] + np.arange(len(a))] = False
        if octets.any():
            out[octets] = np.frombuffer(a.buffers()[2], "u1")[ends[0] : ends[-1]]
        return out.tolist()
    kind = {"INT64": "<i8", "DOUBLE": "<f8", "FLOAT": "<f4"}.get(physical, "<i4")
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype(kind)).view("<i4").tolist()


def _chain(state: int, numbers: list[int]) -> int:
    """mix of one number after another."""
    for x in numbers:
        state = (state * PRIME ^ x) & _MASK
    return state


def _fold(batches: Iterable[pa.RecordBatch], kinds: dict[str, str]) -> int:
    values, nulls = [SEED] * len(kinds), [SEED] * len(kinds)
    for batch in batches:
        for i, (n, kind) in enumerate(kinds.items()):
            values[i] = _chain(values[i], _numbers(batch[n].drop_null(), kind))
            nulls[i] = _chain(nulls[i], _numbers(batch["row_index"].filter(batch[n].is_null()), "INT64"))
    folded = [mix_long(v, _signed(n, 64)) for v, n in zip(values, nulls, strict=True)]
    out = folded[0]
    if len(folded) > 1:
        out = SEED
        for x in folded:
            out = mix_long(out, _signed(x, 64))
    return _signed(out, 64)


def scan_checksum(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row, ``checksum``: values and null places of each column in row order, then the columns in theirs.

    The hash depends on the order of all rows, so one task reads them, and sorts
    them on disk where they are many. group_checksums folds row groups apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_fold(batches, kinds)], pa.int64())], ["checksum"])

    return rows.select(*kinds, "row_index").coalesce(1).sortWithinPartitions("row_index").mapInArrow(run, "checksum bigint")


def group_checksums(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(row_group, row_count, checksum): the checksum of scan_checksum for each row group's rows.

    Row groups are folded apart from each other, each in one task; rows of one
    file, with row_index and row_group.
    """

    def run(table: pa.Table) -> pa.Table:
        out = {"row_group": [table["row_group"][0].as_py()], "row_count": [table.num_rows], "checksum": [_fold(table.sort_by("row_index").to_batches(), kinds)]}
        return pa.table({k: pa.array(x, pa.int64()) for k, x in out.items()})

    names = [*kinds, "row_index", F.col("row_group").cast("long")]
    return rows.select(*names).groupBy("row_group").applyInArrow(run, "row_group bigint, row_count bigint, checksum bigint")


def stream_digest(values: list[object], physical: str) -> str:
    """SHA-256 of a column's value stream: a zero byte for a null, else a one, the length and the value."""
    h = hashlib.sha256()
    pack = {"BOOLEAN": "<?", "INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}
    for x in values:
        if x is None:
            h.update(b"\0")
        else:
            data = bytes(x) if physical not in pack else struct.pack(pack[physical], x)
            h.update(b"\1" + struct.pack("<i", len(data)) + data)
    return h.hexdigest()
