"""Words, word hashes and n-gram hashes of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20
#: Multipliers of the two polynomial n-gram hashes; any odd numbers would do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) runs of about ``limit`` bytes; a null is an empty text. A text is never cut."""
    first, held, size = 0, [], 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        text = x.as_py() or b""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hash_texts(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and the number of words of each text.

    bytes.split() parts at the six ASCII white-space characters and at no other.
    """
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    digest = partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, chain.from_iterable(split)), np.uint64, int(counts.sum())), counts


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h (a public 64-bit finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of n words, by its first word; runs are not stopped by text ends."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, b = h[:m].copy(), np.uint64(base)
    for j in range(1, n):
        out *= b
        out += h[j : m + j]
    return mix(out)


def owners(counts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(counts)), counts)


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words, by their first word, lie within one text."""
    total = int(counts.sum())
    m = total - n + 1
    if m <= 0:
        return np.empty(0, bool)
    own = owners(counts)
    return own[:m] == own[n - 1 :]
