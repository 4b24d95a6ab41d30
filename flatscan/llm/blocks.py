"""Fingerprints of all texts, exchanged between blocks of rows.

Rows are dealt into blocks of bounded bytes. A block sends each fingerprint once,
with what it knows of it, to the part that owns the fingerprint's range; a part
answers the blocks. A fingerprint that a third of all rows share therefore
reaches its part once per block, never once per row. Messages are byte strings
of packed arrays, one row for each block and part. All passes over the texts read
one shuffle of them.

Blocks and parts grow with the square root of the input, between 1 GB and the
size at which blocks reach MOST_BYTES. In between, blocks times parts, and so
messages, grow in proportion to the input; beyond, a message holds fewer
fingerprints, down to one, and messages follow fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .common import fresh, pieces_for, text_bytes

BLOCK_BYTES = 4 << 20
MOST_BYTES = 32 << 20
#: Up to so many blocks of BLOCK_BYTES, their size stays.
FIRST_BLOCKS = 256
#: A part owns the fingerprints of so many blocks' worth of text.
BLOCKS_A_PART = 4
LEAST = 24
#: Stands for a null id: after every other.
LAST = np.iinfo(np.int64).max
TO_PART = "part int, block int, a binary, b binary, c binary"
TO_BLOCK = "block int, a binary, b binary, c binary"

Message = tuple[int, bytes, bytes, bytes]


def block_size(total: int, least: int) -> int:
    """Bytes of a block of a text of ``total`` bytes in all, ``least`` of them up to FIRST_BLOCKS blocks."""
    return max(least, min(math.isqrt(total * least // FIRST_BLOCKS), least * MOST_BYTES // BLOCK_BYTES))


class Blocks:
    """docs with a block number, and passes over the blocks."""

    def __init__(self, docs: DataFrame, id: str, text: str, block_bytes: int = BLOCK_BYTES):
        self.id, self.text, self.schema = id, text, docs.schema
        if not isinstance(docs.schema[id].dataType, IntegralType):
            raise TypeError(f"{id} is {docs.schema[id].dataType.simpleString()}; ids must be whole numbers, for the least one stays")
        total = text_bytes(docs, text)
        block_bytes = block_size(total, block_bytes)
        self.count = pieces_for(total, block_bytes, LEAST)
        self.parts = pieces_for(total, BLOCKS_A_PART * block_bytes, LEAST)
        self.column = fresh(docs, "__block")
        # the piece of the input keeps rows that repeat very often from meeting in one block
        number = F.pmod(F.xxhash64(F.col(id), F.crc32(F.col(text).cast("binary")), F.spark_partition_id()), F.lit(self.count))
        self.rows = docs.withColumn(self.column, number.cast("int"))

    def _reader(self) -> Callable[[pa.Table], tuple[np.ndarray, list[bytes | None], int]]:
        """Takes a block's ids, texts and number from its rows; holds names only, so that it can be sent."""
        id, text, column = self.id, self.text, self.column

        def read(table: pa.Table) -> tuple[np.ndarray, list[bytes | None], int]:
            ids = table[id].cast(pa.int64()).fill_null(LAST).to_numpy()
            return ids, table[text].cast(pa.binary()).to_pylist(), table[column][0].as_py()

        return read

    def send(self, fn: Callable[[np.ndarray, list[bytes | None]], list[Message]]) -> DataFrame:
        """Messages (part, a, b, c) that fn makes of the ids and texts of each block."""

        read = self._reader()

        def run(table: pa.Table) -> pa.Table:
            ids, texts, block = read(table)
            return _to_parts(fn(ids, texts), block)

        return self.rows.groupBy(self.column).applyInArrow(run, TO_PART)

    def send_again(self, answers: DataFrame, fn: Callable[[np.ndarray, list[bytes | None], list[tuple[bytes, bytes, bytes]]], list[Message]]) -> DataFrame:
        """Messages that fn makes of each block and the answers that it got; blocks without an answer send none."""

        read = self._reader()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _to_parts([], 0)
            ids, texts, block = read(left)
            return _to_parts(fn(ids, texts, _bodies(right)), block)

        return self.rows.groupBy(self.column).cogroup(answers.groupBy("block")).applyInArrow(run, TO_PART)

    def finish(self, answers: DataFrame, fn: Callable[[np.ndarray, list[bytes | None], list[tuple[bytes, bytes, bytes]]], dict[str, pa.Array]], extra: StructType) -> DataFrame:
        """docs with the columns that fn makes; the text is replaced where fn gives it, and equal names are."""
        read = self._reader()
        names = {f.name for f in extra}
        out = StructType([f for f in self.schema if f.name not in names] + list(extra))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                made = fn(np.empty(0, np.int64), [], [])
            else:
                ids, texts, _ = read(left)
                made = fn(ids, texts, _bodies(right))
            return pa.table({f.name: made[f.name] if f.name in made else left[f.name] for f in out})

        return self.rows.groupBy(self.column).cogroup(answers.groupBy("block")).applyInArrow(run, out)


def answer(messages: DataFrame, fn: Callable[[list[int], list[tuple[bytes, bytes, bytes]]], list[Message]]) -> DataFrame:
    """Answers (block, a, b, c) that fn makes of all messages of a part."""

    def run(table: pa.Table) -> pa.Table:
        made = fn(table["block"].to_pylist(), _bodies(table))
        columns = list(zip(*made, strict=True)) or [[]] * 4
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("block", "a", "b", "c"), columns, (pa.int32(), *[pa.binary()] * 3), strict=True)})

    return messages.groupBy("part").applyInArrow(run, TO_BLOCK)


def _bodies(table: pa.Table) -> list[tuple[bytes, bytes, bytes]]:
    return list(zip(*(table[c].to_pylist() for c in "abc"), strict=True))


def _to_parts(made: list[Message], block: int) -> pa.Table:
    columns = list(zip(*made, strict=True)) or [[]] * 4
    parts, *rest = columns
    out = {"part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(made), pa.int32())}
    return pa.table(out | {k: pa.array(c, pa.binary()) for k, c in zip("abc", rest, strict=True)})
