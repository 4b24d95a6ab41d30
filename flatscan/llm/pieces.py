"""Sampled SentencePiece encoding, and decoding.

All segmentations of a text into pieces form a lattice. Forward filtering sums
the weights of all paths to each place; backward sampling then draws the pieces
from the end, each with its share of the sum. No piece of a vocabulary goes on
past a word's end into the next white space, so the lattice falls apart into
words, and drawing word by word gives exactly the lattice's distribution. Each
different word of a chunk is filtered once; all its occurrences draw from the
same table. Words are filtered and sampled side by side, a place at a time; what
goes on past LONG places (texts without spaces) is done word by word, in time that
grows with its length. The random numbers are hashes of the row's key, the word's number
and the draw's, so a row is segmented alike in each run and on each executor.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .words import chunks, mix

#: White space of the vocabulary; inside this module it is a plain space.
MARK = "▁".encode()
#: Bytes of a UTF-8 character by its first byte.
WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int32)
UNIT = re.compile(rb" *[^ \n]+| +|\n")
CHUNK_BYTES = 3 << 18
#: Bytes of a word, and pieces of an occurrence, that are worked on side by side with others.
LONG = 512
#: Edges that are Python numbers at a time.
EDGES = 1 << 16


@dataclass
class Vocabulary:
    """Pieces as a trie of bytes, with their weights."""

    parts: list[bytes]  # by id; empty for control pieces
    weight: np.ndarray  # log probability by id
    byte_ids: np.ndarray  # the id of each single byte's piece
    first: np.ndarray  # state after one byte, or -1
    second: np.ndarray  # state after two bytes, or -1
    base: np.ndarray  # a state's row in the two next tables starts here
    owner: np.ndarray  # the state whose row a slot is in
    target: np.ndarray  # where the slot's byte leads
    ends: np.ndarray  # the piece that ends in a state, or -1
    longest: int

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        slot = self.base[state] + byte
        return np.where(self.owner[slot] == state, self.target[slot], -1)


def _displaced(nodes: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a sparse table, each moved to a place where its entries meet free slots; the largest rows first."""
    size = 256
    while size < 5 * sum(map(len, nodes)):
        size *= 2
    draw, taken = random.Random(0), bytearray(size + 256)
    base = np.zeros(len(nodes), np.int32)
    owner, target = np.full((2, size + 256), -1, np.int32)
    for state in sorted(range(len(nodes)), key=lambda s: -len(nodes[s])):
        row = nodes[state]
        at = draw.randrange(size)
        while any(taken[at + c] for c in row):
            at = draw.randrange(size)
        base[state] = at
        for c, t in row.items():
            taken[at + c] = 1
            owner[at + c], target[at + c] = state, t
    return base, owner, target


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file with byte fallback.

    A BPE model has ranks and no probabilities; a piece of rank r then weighs
    1 / (r + 2), normed, as by Zipf's law. Bytes weigh less than any piece.
    Pieces with white space after another character are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    parts: list[bytes] = [b""] * n
    byte_ids = np.full(256, -1, np.int32)
    score = np.zeros(n)
    normal = []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            parts[i] = bytes([int(piece[3:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            parts[i] = piece.encode().replace(MARK, b" ")
            if b" " not in parts[i].lstrip(b" ") and b"\n" not in parts[i]:
                normal.append(i)
                score[i] = model.get_score(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback; decoding wouldn't be lossless")
    ranked = score.min() < -100  # log probabilities stay far above that
    weight = -np.log(np.minimum(-score, n) + 2) if ranked else score
    weight[normal] -= np.log(np.exp(weight[normal]).sum())
    weight[byte_ids] = weight[normal].min() - 3
    nodes: list[dict[int, int]] = [{}]
    ends = [-1]
    for i in normal:
        state = 0
        for c in parts[i]:
            if (after := nodes[state].get(c)) is None:
                after = nodes[state][c] = len(nodes)
                nodes.append({})
                ends.append(-1)
            state = after
        ends[state] = i
    first = np.full(256, -1, np.int32)
    second = np.full(65536, -1, np.int32)
    for c, t in nodes[0].items():
        first[c] = t
        for d, u in nodes[t].items():
            second[c * 256 + d] = u
    return Vocabulary(parts, weight, byte_ids, first, second, *_displaced(nodes), np.array(ends, np.int32), max(map(len, parts)))


@dataclass
class Lattice:
    """What backward sampling draws from, for many words at once.

    Nodes are places in words. The edges that end in node v have consecutive
    ``upto``: v plus the share of the paths to v that come by an edge up to it.
    """

    begin: np.ndarray  # first node of each word
    end: np.ndarray
    upto: np.ndarray
    start: np.ndarray  # node where an edge starts
    piece: np.ndarray
    first: np.ndarray  # first edge that ends in each node, and one more entry

    @classmethod
    def of(cls, words: list[bytes], v: Vocabulary, theta: float) -> Lattice:
        text = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int32, len(words))
        stop = np.cumsum(size, dtype=np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        left = np.repeat(stop, size) - np.arange(len(text), dtype=np.int32)
        heads = np.flatnonzero((text & 0xC0) != 0x80).astype(np.int32)
        width = WIDTH[text]
        bare = np.zeros(len(text), bool)
        bare[heads] = True
        found = []
        at, state = heads, v.first[text[heads]]
        for n in range(1, v.longest + 1):
            if n == 2:
                at = at[left[at] >= 2]
                state = v.second[text[at].astype(np.int32) * 256 + text[at + 1]]
            elif n > 2:
                live = left[at] >= n
                at = at[live]
                state = v.step(state[live], text[at + n - 1])
            if n > 1:
                live = state >= 0
                at, state = at[live], state[live]
                ends = v.ends[state]
            else:
                ends = np.where(state >= 0, v.ends[state], -1)
            if not len(at):
                break
            whole = ends >= 0
            found.append((at[whole], n, ends[whole]))
            if n <= 4:
                bare[found[-1][0][width[found[-1][0]] == n]] = False
        # characters without a piece of their own go byte by byte
        lone = np.flatnonzero(np.repeat(bare[heads], width[heads])[: len(text)]).astype(np.int32)
        found.append((lone, 1, v.byte_ids[text[lone]]))
        at = np.concatenate([x[0] for x in found])
        n = np.repeat(np.array([x[1] for x in found], np.int32), [len(x[0]) for x in found])
        piece = np.concatenate([x[2] for x in found])
        # a word of n bytes has n + 1 nodes
        begin = stop - size + np.arange(len(words), dtype=np.int32)
        order = np.argsort(at + n + word[at], kind="stable")
        at, n, piece = at[order], n[order], piece[order]
        owner = word[at]
        start = at + owner
        end = start + n
        weight = theta * v.weight[piece]
        sums = np.full(len(text) + len(words), -np.inf)
        sums[begin] = 0
        # places of equal distance from their word's start, from left to right
        side = np.flatnonzero(size[owner] <= LONG) if len(size) and size.max() > LONG else np.arange(len(owner))
        far = (end - begin[owner])[side]
        by = np.argsort(far.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(far[by], np.arange(1, int(far.max()) + 2 if len(far) else 1))
        by = side[by]
        for a, b in zip(cuts, cuts[1:], strict=False):
            e = by[a:b]
            if not len(e):
                continue
            value, to = sums[start[e]] + weight[e], end[e]
            new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, new)
            safe = np.where(np.isfinite(top), top, 0)
            total = np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.append(new, len(e))))), new)
            with np.errstate(divide="ignore"):
                sums[to[new]] = safe + np.log(total)
        for w in np.flatnonzero(size > LONG):
            a, b = np.searchsorted(end, (begin[w], begin[w] + size[w] + 1))
            sums[begin[w] : begin[w] + size[w] + 1] = _forward(int(begin[w]), int(size[w]), start[a:b], end[a:b], weight[a:b])
        reached = np.isfinite(sums[end]) & np.isfinite(sums[start])
        start, end, piece, weight = start[reached], end[reached], piece[reached], weight[reached]
        share = np.exp(sums[start] + weight - sums[end])
        new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        total = np.cumsum(share)
        within = total - np.repeat((total - share)[new], np.diff(np.append(new, len(end))))
        upto = end + np.clip(within, 0, 1)
        if len(end):
            last = np.append(new[1:], len(end)) - 1
            upto[last] = end[last] + 1.0
        first = np.searchsorted(end, np.arange(len(sums) + 1))
        return cls(begin, begin + size, upto, start, piece, first)

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences, in order, and how many each has."""
        order = np.argsort(word, kind="stable")  # near nodes are looked up together
        node, stop, live = self.end[word[order]], self.begin[word[order]], order
        seed, count = seed[order], np.zeros(len(word), np.int64)
        steps = []
        while len(live) and len(steps) < LONG:
            draw = (mix(seed + np.uint64(len(steps) + 1)) >> np.uint64(11)) * 2.0**-53
            edge = np.searchsorted(self.upto, node + draw, side="right")
            # rounding can make the sum reach the next node's
            edge -= (edge > 0) & (self.upto[edge - 1] >= node + 1)
            steps.append((live, self.piece[edge]))
            node = self.start[edge]
            count[live] += 1
            more = node != stop
            live, node, stop, seed = live[more], node[more], stop[more], seed[more]
        rest = {}
        for at, n, to, s in zip(live.tolist(), node.tolist(), stop.tolist(), seed, strict=True):
            rest[at] = self._walk(n, to, s, len(steps))
            count[at] += len(rest[at])
        out = np.empty(int(count.sum()), np.int32)
        last = np.cumsum(count) - 1
        for k, (at, piece) in enumerate(steps):
            out[last[at] - k] = piece
        for at, pieces in rest.items():
            upto = last[at] - len(steps) + 1
            out[upto - len(pieces) : upto] = pieces[::-1]
        return out, count

    def _walk(self, node: int, stop: int, seed: np.uint64, step: int) -> list[int]:
        """Pieces from a node back to the first one, the last piece first; draws as the steps before it did."""
        out, draws = [], []
        while node != stop:
            if not draws:
                draws = ((mix(seed + np.arange(step + 1, step + EDGES + 1, dtype=np.uint64)) >> np.uint64(11)) * 2.0**-53)[::-1].tolist()
                step += EDGES
            x = node + draws.pop()
            edge, last = int(self.first[node]), int(self.first[node + 1]) - 1
            while edge < last and self.upto[edge] <= x:
                edge += 1
            out.append(int(self.piece[edge]))
            node = int(self.start[edge])
        return out


def _forward(begin: int, size: int, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> list[float]:
    """Log sums of all paths to each node of one word, whose edges come in the order of their ends."""
    sums = [-math.inf] * (size + 1)
    sums[0] = 0.0
    now, held = -1, []
    for at in range(0, len(start), EDGES):
        lot = slice(at, at + EDGES)
        for i, v, w in zip((start[lot] - begin).tolist(), (end[lot] - begin).tolist(), weight[lot].tolist(), strict=True):
            if v != now:
                if held:
                    sums[now] = _log_sum(held)
                now, held = v, []
            if sums[i] > -math.inf:
                held.append(sums[i] + w)
    if held:
        sums[now] = _log_sum(held)
    return sums


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(y - top) for y in x))


def encode_texts(texts: list[bytes], keys: list, v: Vocabulary, theta: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and how many each has. An empty text has none."""
    split = [UNIT.findall(b" " + t) if t else [] for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    if not flat:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    row = np.array([xxhash.xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
    seeds = mix(np.repeat(row, n) + place * np.uint64(0x9E3779B97F4A7C15))
    pieces, count = Lattice.of(list(number), v, theta).sample(word, seeds)
    upto = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n)])]
    return pieces, np.diff(upto)


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", out: str = "pieces", theta: float = 1.0, seed: int = 0, decoded: str | None = None) -> DataFrame:
    """docs with ``out``: the piece ids of a segmentation drawn for the row's id.

    theta sharpens the distribution: weights are taken to that power. A null text
    has null pieces, an empty one has none. A very long text is encoded whole, in
    time and memory that grow with it, also where it has no space. Rows with equal
    ids and texts get equal pieces, null ids too; ids may be of any type. An empty
    table stays empty. A column named ``out`` is replaced, others stay. Where
    ``decoded`` names a column, it gets what decoding makes of the pieces, in the
    same pass.
    """
    docs = docs.drop(out, *([decoded] if decoded else []))
    v = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch[text], CHUNK_BYTES):
                part = batch.slice(first, len(texts))
                ids, n = encode_texts(texts, part[id].to_pylist(), v, theta, seed)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                null = part[text].is_null()
                made = {out: pa.ListArray.from_arrays(offsets, pa.array(ids), mask=null)}
                if decoded:
                    made[decoded] = _strings(decode_ids(ids, n, v), null)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])

    added = [StructField(out, ArrayType(IntegerType(), False))] + ([StructField(decoded, StringType())] if decoded else [])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def decode_ids(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[bytes]:
    """Texts of runs of ids; the space that encoding puts before a text goes."""
    size = np.fromiter(map(len, v.parts), np.int64, len(v.parts))
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(v.parts), np.uint8)
    n = size[ids]
    done = np.cumsum(n)
    data = text[np.repeat(begin[ids] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)].tobytes()
    upto = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a + data.startswith(b" ", a, b) : b] for a, b in zip(upto, upto[1:], strict=False)]


def _strings(texts: list[bytes], null: pa.Array) -> pa.Array:
    return pa.array([None if bad else t.decode("utf-8", "replace") for t, bad in zip(texts, null.to_pylist(), strict=True)], pa.string())


def decode(docs: DataFrame, model: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """docs with ``out``: the text of the piece ids.

    Null pieces have a null text; control pieces have no text; bytes that are no
    UTF-8, which encoding never makes, become U+FFFD. A column named ``out`` is
    replaced.
    """
    docs = docs.drop(out)
    v = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[pieces]
            counts = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            texts = _strings(decode_ids(lists.flatten().to_numpy(), counts, v), lists.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))
