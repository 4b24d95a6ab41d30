"""Substring dedup: windows of words that an earlier document has too.

Levels of doubled length, up to the window's. At each level but the last, a whole
window stands for one of its parts of that level's length, the least by hash; the
choice depends on the words alone, so equal windows choose equal parts, and parts
chosen by neighbouring windows are mostly the same place. Only windows whose part
occurs in more than one document are extended to the next level's length; a block
that has none left sends nothing on, and a level that no block sends anything to is
passed over in no time. The last level compares whole windows, by 128 bits of two
hashes whose word hashes are drawn apart. A
level asks the parts that own its hashes and hears back which are repeated (see
blocks).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .blocks import BLOCK_BYTES, Blocks, Message, answer
from .words import BASES, hash_texts, inside, mix, ngrams, owners

WINDOW = 13
#: The first level's parts are about this many words long, or the window if that is shorter.
LEAST = 7

Body = tuple[bytes, bytes, bytes]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class Windows:
    """The whole windows of a block of texts: their places, documents and hashes."""

    def __init__(self, ids: np.ndarray, texts: list[bytes | None], window: int):
        self.texts = [t or b"" for t in texts]
        self.hashes, self.counts = hash_texts(self.texts)
        self.window = window
        own = owners(self.counts)
        self.at = np.flatnonzero(inside(self.counts, window))
        self.owner = own[self.at]
        self.doc = ids[self.owner]

    def least_parts(self, length: int) -> np.ndarray:
        """The least hash among the parts of this length in each window.

        Mixed again, for least hashes are small numbers and would crowd in a few ranges.
        """
        return mix(sliding_min(ngrams(self.hashes, length), self.window - length + 1)[self.at])

    def first(self) -> np.ndarray:
        """A hash of each window."""
        return ngrams(self.hashes, self.window)[self.at]

    def second(self, yes: np.ndarray) -> np.ndarray:
        """Another hash of those windows, from word hashes that don't depend on the first ones: equal in both means equal words.

        Only texts that have one of them are hashed again.
        """
        has = np.zeros(len(self.texts), bool)
        has[self.owner[yes]] = True
        other = np.zeros(len(self.hashes), np.uint64)
        other[np.repeat(has, self.counts)] = hash_texts([self.texts[i] for i in np.flatnonzero(has)], 1)[0]
        return ngrams(other, self.window, BASES[1])[self.at[yes]]


def levels(window: int, least: int = LEAST) -> list[int]:
    """Lengths that double up to the window's, which is the last."""
    out = [window]
    while out[0] > least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, and where a new combination of all but the last key starts in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys[:-1]:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _pack(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, ...: sorted or small numbers then compress."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: list[bytes], kind: type) -> np.ndarray:
    each = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).reshape(-1) for x in packed]
    return np.concatenate(each) if each else np.empty(0, kind)


def _deal(parts: int, key: np.ndarray, *columns: np.ndarray) -> list[Message]:
    """Messages to the parts that own ranges of keys; keys come sorted."""
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if a < b:
            own = [_pack(c[a:b]) for c in (key, *columns)]
            out.append((int(part[a]), own[0], own[1], b"".join(own[2:])))
    return out


def _split(bodies: list[Body]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all messages, and where each message starts among them."""
    return _unpack([a for a, _, _ in bodies], np.uint64), np.cumsum([0, *(len(a) // 8 for a, _, _ in bodies)])


def _has(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def shared_parts(at: list[int], bodies: list[Body]) -> list[Message]:
    """Which parts of windows stand in more than one document."""
    key, cuts = _split(bodies)
    low = _unpack([b for _, b, _ in bodies], np.int64)
    high = low + _unpack([c for _, _, c in bodies], np.int64)
    order, starts = _groups(key, low)
    shared = np.minimum.reduceat(low[order], starts) < np.maximum.reduceat(high[order], starts)
    yes = np.zeros(len(key), bool)
    yes[order] = np.repeat(shared, np.diff(np.append(starts, len(key))))
    return [(block, _pack(own), b"", b"") for block, a, b in zip(at, cuts, cuts[1:], strict=False) if len(own := key[a:b][yes[a:b]])]


def first_documents(at: list[int], bodies: list[Body]) -> list[Message]:
    """The least document of each whole window, to the blocks where a later document has it."""
    key, cuts = _split(bodies)
    second = _unpack([b for _, b, _ in bodies], np.uint64)
    low = _unpack([c[: len(c) // 2] for _, _, c in bodies], np.int64)
    high = low + _unpack([c[len(c) // 2 :] for _, _, c in bodies], np.int64)
    order, starts = _groups(key, second, low)
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(low[order], starts), np.diff(np.append(starts, len(key))))
    yes = first < high
    return [
        (block, _pack(key[a:b][own]), _pack(second[a:b][own]), _pack(first[a:b][own]))
        for block, a, b in zip(at, cuts, cuts[1:], strict=False)
        if (own := yes[a:b]).any()
    ]


def removed_windows(w: Windows, got: list[Body]) -> np.ndarray:
    """Which windows an earlier document has."""
    if not got or not len(w.at):
        return np.zeros(len(w.at), bool)
    key, second, first = (_unpack([x[i] for x in got], t) for i, t in ((0, np.uint64), (1, np.uint64), (2, np.int64)))
    order = np.argsort(key, kind="stable")
    key, second, first = key[order], second[order], first[order]
    own = w.first()
    met = _has(key, own)
    own, own_second, doc = own[met], w.second(met), w.doc[met]
    at = np.searchsorted(key, own)
    out = np.zeros(len(own), bool)
    # as many steps as the longest run of one first hash; that is one, but for collisions
    for _ in range(int(np.unique(key, return_counts=True)[1].max())):
        k = np.minimum(at, len(key) - 1)
        out |= (key[k] == own) & (second[k] == own_second) & (first[k] < doc)
        at += 1
    gone = np.zeros(len(w.at), bool)
    gone[met] = out
    return gone


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words removed that are covered by a window which starts in a document of a smaller id too.

    Words part at ASCII white space; those kept are joined by one space. Windows
    are judged on the input, not on what is left. n_words and n_removed (long)
    count words; spans holds (first word, end) of each removed run. A null text
    stays null, has no words and removes none; empty texts and those shorter than
    a window lose nothing. A very long text is judged whole, in one block. Rows
    with equal ids don't remove each other's words, so ties and repeated rows keep
    theirs alike; a null id comes after all others. Ids are whole numbers, others
    are a TypeError. An empty table stays empty. Other columns stay, whatever
    their names, but for some of those three names.
    """
    blocks = Blocks(docs, id, text, block_bytes)
    parts = blocks.parts

    parts_first = levels(window)[:-1]

    def survivors(w: Windows, length: int | None, got: list[Body]) -> np.ndarray:
        """The windows whose part of the last level's length is repeated."""
        if length is None:
            return np.ones(len(w.at), bool)
        return _has(np.sort(_unpack([a for a, _, _ in got], np.uint64)), w.least_parts(length))

    def level(length: int, before: int | None):  # noqa: ANN202
        def send(ids: np.ndarray, texts: list[bytes | None], got: list[Body] = ()) -> list[Message]:
            w = Windows(ids, texts, window)
            yes = survivors(w, before, got)
            key, doc, owner = w.least_parts(length)[yes], w.doc[yes], w.owner[yes]
            if not len(key):
                return []
            # neighbours mostly have the same least part
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            key, doc = key[new], doc[new]
            order, starts = _groups(key, doc)
            ends = np.append(starts[1:], len(order)) - 1
            doc = doc[order]
            return _deal(parts, key[order][starts], doc[starts], doc[ends] - doc[starts])

        return send

    def wholes(ids: np.ndarray, texts: list[bytes | None], got: list[Body] = ()) -> list[Message]:
        w = Windows(ids, texts, window)
        yes = survivors(w, parts_first[-1] if parts_first else None, got)
        first, second, doc = w.first()[yes], w.second(yes), w.doc[yes]
        order, starts = _groups(first, second, doc)
        if not len(order):
            return []
        ends = np.append(starts[1:], len(order)) - 1
        doc = doc[order]
        return _deal(parts, first[order][starts], second[order][starts], doc[starts], doc[ends] - doc[starts])

    def remove(ids: np.ndarray, texts: list[bytes | None], got: list[Body]) -> dict[str, pa.Array]:
        w = Windows(ids, texts, window)
        hit = w.at[removed_windows(w, got)]
        step = np.zeros(len(w.hashes) + window + 1, np.int64)
        step[hit] += 1
        np.add.at(step, hit + window, -1)
        gone = np.cumsum(step)[: len(w.hashes)] > 0
        ends = np.cumsum(w.counts)
        kept, removed, spans = [], [], []
        for t, a, b in zip(texts, ends - w.counts, ends, strict=True):
            own = gone[a:b]
            n = int(own.sum())
            removed.append(n)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) if n else np.empty(0, np.int64)
            spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            words = (t or b"").split()
            kept.append(None if t is None else b" ".join(compress(words, ~own) if n else words))
        return {
            text: pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(w.counts),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }

    shared, before = None, None
    for length in parts_first:
        fn = level(length, before)
        shared = answer(blocks.send(fn) if shared is None else blocks.send_again(shared, fn), shared_parts)
        before = length
    firsts = answer(blocks.send(wholes) if shared is None else blocks.send_again(shared, wholes), first_documents)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    extra = StructType([StructField(text, StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(span))])
    out = blocks.finish(firsts, remove, extra)
    added = ("n_words", "n_removed", "spans")
    return out.select(*[c for c in docs.columns if c not in added], *added)
