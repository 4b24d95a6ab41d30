"""Benchmark decontamination: SimHash over item-sized windows, then exact checks.

For each benchmark item, windows of the item's own length slide over a text.
Only windows with enough item shingles to reach the similarity are fingerprinted
(an exact bound, so nothing is lost). A fingerprint is looked up in a multi-index:
its 256 bits are cut into 16 blocks, and what differs in two bits or fewer of some
block is found. Two fingerprints within 47 bits must agree that far in some block,
so all of those are found; at the similarity 0.8 they differ in 39 bits on average.
Pairs beyond the radius, or that differ more in all 16 blocks, are not lost: items
that no fingerprint leads to are found by their rarest shingles, since a window that
reaches the similarity holds one of those. Each item found either way is compared
with all windows of the text by weighted Jaccard similarity of shingle counts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import chunks, hash_words, mix, ngrams

SHINGLE = 5
#: 64-bit words of a window's fingerprint, its blocks, and the bits that may differ in one.
WORDS, BLOCKS, FLIPS = 4, 16, 2
#: A-Z become a-z; other ASCII characters than letters and digits become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Most text of benchmark items that one pass carries to the executors.
ITEM_BYTES = 16 << 20


def shingles(text: bytes) -> np.ndarray:
    """Hashes of all runs of five words: lower-cased runs of ASCII letters, digits and characters beyond ASCII.

    Each character is lower-cased to one, wherever it stands.
    """
    if not text.isascii():
        # str.lower() makes two characters of the first, and looks at what stands around the second
        text = text.decode("utf-8", "replace").replace("\u0130", "i").replace("\u03a3", "\u03c3").lower().encode()
    return ngrams(hash_words(text.translate(FOLD).split()), SHINGLE)


def simhash(windows: np.ndarray, words: int = 1) -> np.ndarray:
    """A 64-bit fingerprint of each row of shingle hashes; a row of fingerprints where more words are asked for.

    Each occurrence of a shingle votes by its own hash, of the shingle and its
    running number in the row, so that fingerprints follow weighted Jaccard.
    """
    w = np.sort(windows, axis=1)
    new = np.ones(w.shape, bool)
    new[:, 1:] = w[:, 1:] != w[:, :-1]
    if not new.all():
        at = np.arange(w.shape[1])
        number = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
        w = w + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(windows), words), np.uint64)
    for word in range(words):
        h = mix(w ^ np.uint64((0x5851F42D4C957F2D + word * 0x2545F4914F6CDD1D) & (1 << 64) - 1))
        for bit in range(64):
            votes = ((h >> np.uint64(bit)) & np.uint64(1)).sum(axis=1, dtype=np.int64) * 2
            out[:, word] |= (votes > windows.shape[1]).astype(np.uint64) << np.uint64(bit)
    return out[:, 0] if words == 1 else out


def radius_for(similarity: float) -> int:
    """Bits in which all but a few fingerprints of a pair at the similarity differ at most: 66 at 0.8."""
    bits = 64 * WORDS
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(bits * p + 4.75 * math.sqrt(bits * p * (1 - p)))


class MultiIndex:
    """Fingerprints within ``radius`` bits of a query, found by blocks of 8 or 16 bits.

    Found is what differs in ``flips`` bits or fewer of some block; that is all
    within (flips + 1) * blocks - 1 bits, and so all within the radius where flips
    is radius // blocks, as it is if not given.
    """

    def __init__(self, prints: np.ndarray, radius: int = 23, blocks: int = 8, flips: int | None = None):
        self.prints, self.radius = prints.reshape(len(prints), -1), radius
        self.flips = radius // blocks if flips is None else flips
        width = 64 * self.prints.shape[1] // blocks
        self.kind = {8: np.uint8, 16: np.uint16}[width]
        values = self._blocks(self.prints)
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)
        self.ball = np.array([sum(1 << k for k in c) for n in range(self.flips + 1) for c in combinations(range(width), n)], self.kind)

    def _blocks(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(self.kind)

    def met(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the fingerprints that some block of one query leads to."""
        found = []
        for part, values, order in zip(self._blocks(query), self.sorted.T, self.order.T, strict=True):
            if len(values) <= 4 * len(self.ball):
                # so few that looking at each is less work than probing; it finds the same
                found.append(order[np.bitwise_count(values ^ part) <= self.flips])
                continue
            probes = self.ball ^ part
            a, b = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
            found += [order[x:y] for x, y in zip(a[a < b], b[a < b], strict=True)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def near(self, query: int | np.ndarray, radius: int | None = None) -> np.ndarray:
        query = np.atleast_1d(np.asarray(query, np.uint64))
        at = self.met(query)
        return at[np.bitwise_count(self.prints[at] ^ query).sum(axis=1, dtype=np.int64) <= (self.radius if radius is None else radius)]


class Rarest:
    """Items of one length, found by the ``kept`` of their shingles that are rarest among all items.

    Of n shingles a window that shares ``least`` lacks n - least at most, and so holds
    one of any n - least + 1: with that many kept no such window is lost.
    """

    def __init__(self, own: np.ndarray, kept: int):
        values, at, count = np.unique(own, return_inverse=True, return_counts=True)
        at = at.reshape(own.shape)
        at = np.take_along_axis(at, np.argsort(count[at], axis=1, kind="stable")[:, :kept], axis=1)
        order = np.argsort(at, axis=None, kind="stable")
        self.values, self.items = values[at.ravel()[order]], order // at.shape[1]

    def met(self, window: np.ndarray) -> np.ndarray:
        """Numbers of the items of which one such shingle is among the different ones given."""
        a, b = np.searchsorted(self.values, window), np.searchsorted(self.values, window, side="right")
        found = [self.items[x:y] for x, y in zip(a[a < b], b[a < b], strict=True)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class Spots:
    """Where a text has which shingle, at some places."""

    def __init__(self, s: np.ndarray, places: np.ndarray):
        order = np.argsort(s[places], kind="stable")
        self.values, self.at = s[places][order], places[order]

    def shared(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many shingles, counted as often as both have them, an item and each window of its length share."""
        n = len(own)
        own, most = np.unique(own, return_counts=True)
        a = np.searchsorted(self.values, own)
        m = np.searchsorted(self.values, own, side="right") - a
        number = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at, most = np.repeat(a, m) + number, np.repeat(most, m)
        place = self.at[at]
        # an occurrence counts in windows that hold it and, before it, fewer of its kind than the item has
        before = np.where(number >= most, self.at[np.maximum(at - most, 0)], -1)
        first = np.sort(np.maximum(before, place - n) + 1)
        return np.searchsorted(first, starts, side="right") - np.searchsorted(np.sort(place), starts)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of shingles, as multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


@dataclass
class Items:
    ids: list
    sets: list[np.ndarray]

    def __post_init__(self) -> None:
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.lengths = sorted({len(x) for x in self.sets})
        self.by_length, self.index, self.own, self._rarest = {}, {}, {}, {}
        for n in self.lengths:
            self.by_length[n] = [i for i, x in enumerate(self.sets) if len(x) == n]
            own = np.stack([self.sets[i] for i in self.by_length[n]])
            self.index[n] = MultiIndex(simhash(own, WORDS), blocks=BLOCKS, flips=FLIPS)
            self.own[n] = np.unique(own)

    def rarest(self, n: int, kept: int) -> Rarest:
        """Made when a window of that length is first looked up."""
        if (n, kept) not in self._rarest:
            self._rarest[n, kept] = Rarest(np.stack([self.sets[i] for i in self.by_length[n]]), kept)
        return self._rarest[n, kept]


def matches(s: np.ndarray, items: Items, similarity: float) -> list[tuple[int, float, int]]:
    """(item, similarity, first word) of the best window of each item that reaches the similarity."""
    if not len(s) or not len(items.all):
        return []
    at = np.minimum(np.searchsorted(items.all, s), len(items.all) - 1)
    hit = items.all[at] == s
    if not hit.any():
        return []
    places = np.flatnonzero(hit)
    spots = None
    best: dict[int, tuple[float, int]] = {}
    # a window of m shingles and an item of n shingles share (m + n) j / (1 + j) at least;
    # m is n, or the whole text where that is shorter
    for n in items.lengths:
        least = math.ceil((min(n, len(s)) + n) * similarity / (1 + similarity) - 1e-9)
        if len(places) < least:
            break
        # and only shingles of items of this length count
        own = items.own[n]
        own_hit = np.zeros(len(s) + 1, np.int64)
        own_hit[places + 1] = own[np.minimum(np.searchsorted(own, s[places]), len(own) - 1)] == s[places]
        below = np.cumsum(own_hit)
        if len(s) < n:
            if below[-1] >= least:
                for i in items.by_length[n]:
                    j = weighted_jaccard(s, items.sets[i])
                    if j >= similarity:
                        best[i] = (j, 0)
            continue
        starts = np.flatnonzero(below[n:] - below[:-n] >= least)
        if not len(starts):
            continue
        found, radius = set(), radius_for(similarity)
        # as many windows at a time as keep the copies small
        for lot in np.array_split(starts, max(1, len(starts) * n >> 18)):
            for x in simhash(s[lot[:, None] + np.arange(n)], WORDS):
                found.update(items.index[n].near(x, radius).tolist())
        # and the items that no fingerprint led to, by what stands in these windows
        edges = np.zeros(len(s) + 1, np.int64)
        edges[starts] += 1
        edges[starts + n] -= 1
        found.update(items.rarest(n, n - least + 1).met(np.unique(s[np.cumsum(edges)[:-1] > 0])).tolist())
        spots = spots or Spots(s, places)
        for k in found:
            i = items.by_length[n][k]
            low = spots.shared(items.sets[i], starts)
            at = int(low.argmax())
            j = int(low[at]) / (2 * n - int(low[at]))
            if j >= similarity:
                best[i] = (j, int(starts[at]))
    return sorted((i, j, start) for i, (j, start) in best.items())


def _item_lots(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[DataFrame]:
    """The items in lots of half the limit on average: one, or as many as their bytes ask for."""
    total = items.agg(F.sum(F.octet_length(F.col(item_text)))).head()[0] or 0
    lots = max(1, -(-2 * total // limit))
    for k in range(lots):
        yield items if lots == 1 else items.where(F.pmod(F.xxhash64(F.col(item_text), F.col(item_id)), F.lit(lots)) == k)


def _lots(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[tuple[str, Broadcast]]:
    """A name and the broadcast (ids, texts) of each lot, in order; the driver holds one lot at a time, and no plan holds any."""
    for lot in _item_lots(benchmark, item_id, item_text, limit):
        rows = lot.select(F.col(item_id), F.coalesce(F.col(item_text), F.lit(""))).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode() for r in rows]))


#: The index of the lot that this worker used last, by the lot's name.
_indexed: dict[str, Items] = {}


def _items(name: str, lot: Broadcast) -> Items:
    """The index of a lot, made once by a worker that goes on with it."""
    if name not in _indexed:
        _indexed.clear()
        ids, texts = lot.value
        own = [(i, s) for i, t in zip(ids, texts, strict=True) if len(s := shingles(t))]
        _indexed[name] = Items([i for i, _ in own], [s for _, s in own])
    return _indexed[name]


def decontamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = 0.8,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(id, item_id, similarity, first_word): each text and each benchmark item that it holds.

    Words are lower-cased and lose ASCII punctuation, so a passage is found
    whatever its case, punctuation and line breaks. An item counts as held where
    a window of its length, or the whole of a shorter text, reaches the similarity;
    the row gives the best such window, the first of equal ones. Items of fewer than five words, and null or
    empty texts and items, match nothing. Of other pairs none that reaches the
    similarity is left out, whatever it is above 0. Repeated rows of docs give repeated
    rows; items of equal text each match. A very long text is searched whole. An
    empty table of texts or of items has no rows. Extra columns are not returned,
    whatever their names; where ``id`` and ``item_id`` are one name, the second
    comes out as item. The items are broadcast in lots of bounded size, one lot a
    pass over the texts.
    """
    kind, item_kind = docs.schema[id].dataType, benchmark.schema[item_id].dataType
    arrow = to_arrow_type(item_kind)
    narrow = docs.select(F.col(id).alias("d"), F.col(text).alias("t"))
    out = None
    for name, lot in _lots(benchmark, item_id, item_text, item_bytes):

        def scan(batches: Iterator[pa.RecordBatch], name: str = name, lot: Broadcast = lot) -> Iterator[pa.RecordBatch]:
            items = _items(name, lot)
            for batch in batches:
                at, found = [], []
                for first, texts in chunks(batch["t"]):
                    for k, t in enumerate(texts, first):
                        more = matches(shingles(t), items, similarity)
                        found += more
                        at += [k] * len(more)
                columns = [
                    batch["d"].take(pa.array(at, pa.int64())),
                    pa.array([items.ids[i] for i, _, _ in found], arrow),
                    pa.array([j for _, j, _ in found], pa.float64()),
                    pa.array([s for _, _, s in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["d", "i", "similarity", "first_word"])

        part = narrow.mapInArrow(scan, f"d {kind.simpleString()}, i {item_kind.simpleString()}, similarity double, first_word bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"d": id, "i": item_id if item_id != id else "item"})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = 0.8,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, as decontamination finds them; no row is moved.

    Rows with a null, an empty or a short text stay, and so do all where the table
    of items is empty; an empty table of texts stays empty. Repeated rows stay or
    go together. A very long text is searched whole. All columns stay, whatever
    their names.
    """
    for name, lot in _lots(benchmark, item_id, item_text, item_bytes):

        def clean(batches: Iterator[pa.RecordBatch], name: str = name, lot: Broadcast = lot) -> Iterator[pa.RecordBatch]:
            items = _items(name, lot)
            for batch in batches:
                keep = [not matches(shingles(t), items, similarity) for _, texts in chunks(batch[text]) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
