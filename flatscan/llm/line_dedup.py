"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines is taken at every line. A
place where its value occurs again in the corpus, and the bytes of both lines with
it, lies inside a repeated chunk; where it doesn't, a chunk ends. So the content
alone sets the bounds, a line more or less moves only those next to it, and a
passage is found wherever it begins. Chunks of two lines or more that stood earlier
are removed whole (``whole_runs``, as op2 and the pipeline do it).

The other mode cuts texts into fixed chunks first, which takes a third of the
messages: a chunk ends where the rolling hash is a multiple of the mean length.
Chunks of two lines or more that occur more than once are removed but for their
first occurrence, after their bytes have been compared. It misses passages whose
ends fall inside a chunk.
"""

from __future__ import annotations

import hashlib
import struct
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import BLOCK_BYTES, Blocks, Message, answer
from .words import BASES, mix

MEAN_LINES = 3
WINDOW = 2
LEAST_LINES = 2
BASE = 1_000_003
BITS = 32


def line_hash(line: bytes) -> int:
    """The first four bytes of a line's MD5, which SQL has too."""
    return int.from_bytes(hashlib.md5(line, usedforsecurity=False).digest()[:4], "big")


def chunk_ends(lines: list[bytes], mean: int = MEAN_LINES, window: int = WINDOW) -> list[int]:
    """Where chunks end: line numbers, each after the last line of a chunk.

    Lines before the first count as lines of hash zero.
    """
    ends, held = [], deque([0] * window, maxlen=window)
    for i, line in enumerate(lines, 1):
        held.append(line_hash(line))
        roll = 0
        for h in held:
            roll = (roll * BASE + h) % (1 << BITS)
        if (roll >> 8) % mean == 0:
            ends.append(i)
    if not ends or ends[-1] < len(lines):
        ends.append(len(lines))
    return ends


def chunks_of(text: bytes | None, least: int = LEAST_LINES) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The lines of a text, and (first line, end, bytes) of its chunks of ``least`` lines or more that hold a word."""
    if text is None:
        return [], []
    lines = text.split(b"\n")
    out, start = [], 0
    for end in chunk_ends(lines) if len(lines) >= least else ():
        if end - start >= least:
            body = b"\n".join(lines[start:end])
            if body.split(None, 1):
                out.append((start, end, body))
        start = end
    return lines, out


def hashed_chunks(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The lines of a text, and (first line, end, 16-byte hash) of its chunks of several lines."""
    lines, own = chunks_of(text)
    return lines, [(s, e, xxhash.xxh3_128_digest(body)) for s, e, body in own]


def rolling_pairs(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The lines of a text, and (first line, end, 16-byte rolling hash) of every two neighbouring ones."""
    if text is None:
        return [], []
    lines = text.split(b"\n")
    if len(lines) < 2:
        return lines, []
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)
    rolled = mix(h[:-1] * np.array(BASES, np.uint64) + h[1:]).tobytes()
    return lines, [(i, i + 2, rolled[16 * i : 16 * i + 16]) for i in range(len(lines) - 1)]


def runs_of(lines: list[bytes], starts: list[int]) -> list[tuple[int, int]]:
    """(first line, end) of the maximal runs of overlapping pairs, given by their first lines, that hold a word."""
    out: list[list[int]] = []
    for s in starts:
        if out and s < out[-1][1]:
            out[-1][1] = s + 2
        else:
            out.append([s, s + 2])
    return [(s, e) for s, e in out if any(x.split(None, 1) for x in lines[s:e])]


def _part(h: bytes, parts: int) -> int:
    return int.from_bytes(h[:8], "little") % parts


def _deal(entries: dict[bytes, tuple[bytes, bytes]], parts: int) -> list[Message]:
    """One message a part: hashes, fixed-width facts, and bytes of any length."""
    by: dict[int, list] = {}
    for h in sorted(entries):
        by.setdefault(_part(h, parts), []).append((h, *entries[h]))
    return [(p, b"".join(x[0] for x in own), b"".join(x[1] for x in own), b"".join(x[2] for x in own)) for p, own in by.items()]


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, whole_runs: bool = False) -> DataFrame:
    """docs with repeated chunks of lines removed from the text, and n_lines and n_removed (long).

    Of all places of equal chunks, that with the least id stays, the first one in
    it; rows with equal ids and texts keep theirs alike. A null id comes after
    all others. Lines end at \\n; a text keeps its other lines, joined by \\n, and
    may end up empty. A null text stays null and has no lines; an empty one has
    one. A very long text is judged whole, in one block. Ids are whole numbers,
    others are a TypeError. An empty table stays empty. Other columns stay,
    whatever their names, but for some named n_lines or n_removed.

    whole_runs: instead of chunks, every run of two lines or more goes whose every
    two neighbouring lines stand so at a lesser id, or before them in the same one
    without sharing a line, if the run holds a word. Some copy of each line stays.
    """
    units = rolling_pairs if whole_runs else hashed_chunks
    blocks = Blocks(docs, id, text, block_bytes)
    parts = blocks.parts

    def hashes(ids: np.ndarray, texts: list[bytes | None]) -> list[Message]:
        seen: dict[bytes, int] = {}
        for t in texts:
            for _, _, h in units(t)[1]:
                seen[h] = seen.get(h, 0) + 1
        return _deal({h: (bytes([n > 1]), b"") for h, n in seen.items()}, parts)

    def repeated(at: list[int], bodies: list[tuple[bytes, bytes, bytes]]) -> list[Message]:
        often: dict[bytes, bool] = {}
        split = [[a[i : i + 16] for i in range(0, len(a), 16)] for a, _, _ in bodies]
        for own, (_, many, _) in zip(split, bodies, strict=True):
            for h, more in zip(own, many, strict=True):
                often[h] = h in often or bool(more)
        out = [(block, b"".join(h for h in own if often[h])) for block, own in zip(at, split, strict=True)]
        return [(block, a, b"", b"") for block, a in out if a]

    def candidates(ids: np.ndarray, texts: list[bytes | None], got: list[tuple[bytes, bytes, bytes]]) -> list[Message]:
        often = {a[i : i + 16] for a, _, _ in got for i in range(0, len(a), 16)}
        first: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        for d, t in zip(ids.tolist(), texts, strict=True):
            lines, own = units(t)
            for start, end, h in own:
                if h in often:
                    key, place = (h, b"\n".join(lines[start:end])), (d, start)
                    first[key] = min(first.get(key, place), place)
        by: dict[int, list] = {}
        for (h, body), place in sorted(first.items()):
            by.setdefault(_part(h, parts), []).append((h, struct.pack("<qqq", *place, len(body)), body))
        return [(p, *(b"".join(x[k] for x in own) for k in range(3))) for p, own in by.items()]

    def compare(at: list[int], bodies: list[tuple[bytes, bytes, bytes]]) -> list[Message]:
        first: dict[tuple[bytes, bytes], tuple[int, int]] = {}
        held: list[list[tuple[bytes, bytes]]] = []
        for a, facts, text_bytes in bodies:
            keys, offset = [], 0
            for i, (d, start, n) in enumerate(struct.iter_unpack("<qqq", facts)):
                # equal hashes are one chunk only where the bytes are equal
                key = a[16 * i : 16 * i + 16], text_bytes[offset : offset + n]
                offset += n
                first[key] = min(first.get(key, (d, start)), (d, start))
                keys.append(key)
            held.append(keys)
        # the second digest tells chunks apart that share the first
        return [(block, b"".join(h + xxhash.xxh3_64_digest(body, 1) for h, body in keys), b"".join(struct.pack("<qq", *first[k]) for k in keys), b"") for block, keys in zip(at, held, strict=True)]

    def remove(ids: np.ndarray, texts: list[bytes | None], got: list[tuple[bytes, bytes, bytes]]) -> dict[str, pa.Array]:
        first = {a[24 * i : 24 * i + 24]: place for a, b, _ in got for i, place in enumerate(struct.iter_unpack("<qq", b))}
        known = {h[:16] for h in first}
        kept, n_lines, n_removed = [], [], []
        for d, t in zip(ids.tolist(), texts, strict=True):
            lines, own = units(t)
            at = [(s, e, first.get(h + xxhash.xxh3_64_digest(b"\n".join(lines[s:e]), 1), (d, s))) for s, e, h in own if h in known]
            if whole_runs:
                gone = runs_of(lines, [s for s, _, (i, k) in at if i < d or k + 2 <= s])
            else:
                gone = [(s, e) for s, e, place in at if (d, s) > place]
            n_lines.append(len(lines))
            n_removed.append(sum(e - s for s, e in gone))
            for s, e in reversed(gone):
                del lines[s:e]
            kept.append(None if t is None else b"\n".join(lines) if gone else t)
        return {
            text: pa.array(kept, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
        }

    often = answer(blocks.send(hashes), repeated)
    verdicts = answer(blocks.send_again(often, candidates), compare)
    extra = StructType([StructField(text, StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    out = blocks.finish(verdicts, remove, extra)
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
