"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-gram indicators: words and pairs of words, and shapes
of words and pairs of shapes. Each indicator is scaled by the log ratio of its
smoothed frequencies in the two classes; a linear model with hinge loss is then
fitted by dual coordinate descent, and a logistic curve turns margins into
scores. The model is fitted on a sample of labelled rows that is bounded in rows and
in bytes; scoring is one pass over all texts, without a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import chunks, mix

BITS = 18
CLASS = bytes(
    ord("a") if 97 <= c <= 122 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else 0xFF if c >= 128 else c for c in range(256)
)
RUN = re.compile(rb"(.)\1+", re.DOTALL)


class Vocabulary(dict):
    """Words seen so far, by number, with the hash of each word and of its shape."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.shape = array("Q"), array("Q")

    def __missing__(self, w: bytes) -> int:
        # letters count once a run: only what surrounds them tells shapes apart
        flat = RUN.sub(rb"\1", w.translate(CLASS))
        self[w] = n = len(self)
        self.word.append(xxhash.xxh3_64_intdigest(w))
        self.shape.append(xxhash.xxh3_64_intdigest(flat, 1))
        return n


class Features:
    """Indicator sets of texts; remembers words it has seen, up to a bound."""

    def __init__(self, bits: int = BITS, remember: int = 200_000):
        self.bits, self.remember, self.seen = bits, remember, Vocabulary()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, indicator) pairs, each once, sorted."""
        if len(self.seen) > self.remember:
            self.seen = Vocabulary()
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        word, shape = np.array(self.seen.word)[at], np.array(self.seen.shape)[at]
        own = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
        pair = own[:-1] == own[1:]
        b = np.uint64(0x9E3779B97F4A7C15)
        same = (word[:-1] == word[1:]) & pair
        both = np.where(same, np.uint64(7), word[:-1] * b + word[1:])[pair]
        # n-grams of "equals the word before": how words repeat, whatever they are
        bit = same.astype(np.uint64)
        runs = bit[:-3] << np.uint64(3) | bit[1:-2] << np.uint64(2) | bit[2:-1] << np.uint64(1) | bit[3:]
        runs += np.uint64(1000)
        run_own = own[: len(runs)]
        runs_in = run_own == own[4 : 4 + len(runs)] if len(own) > 4 else np.zeros(0, bool)
        shapes = (shape[:-1] * b + shape[1:] + np.uint64(1))[pair]
        ids = np.concatenate([word, both, shape, shapes, runs[runs_in]])
        owner = np.concatenate([own, own[:-1][pair], own, own[:-1][pair], run_own[runs_in]])
        key = np.unique((owner << np.uint64(self.bits)) | (mix(ids) >> np.uint64(64 - self.bits)))
        return (key >> np.uint64(self.bits)).astype(np.int64), (key & np.uint64((1 << self.bits) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # class log-count ratio times the support vector weight
    bias: float
    slope: float
    offset: float
    bits: int = BITS

    def margins(self, rows: int, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n = np.bincount(own, minlength=rows)
        dot = np.bincount(own, weights=self.weights[ids], minlength=rows)
        return dot / np.sqrt(np.maximum(n, 1)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    pos, neg = np.full(size, smooth), np.full(size, smooth)
    for x, label in zip(rows, y, strict=True):
        (pos if label > 0 else neg)[x] += 1
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the hinge loss with an L2 penalty, by its dual, a row at a time."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in rows]
    norms = [float(v @ v) + 1 for v in values]
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            x, v, label = rows[i], values[i], y[i]
            slack = label * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), c)
            if step := (new - alpha[i]) * label:
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score curve, by Newton's method with smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, float(np.log((pos + 1) / (neg + 1))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = 5000,
    max_bytes: int = 64 << 20,
) -> Model:
    """A model from labelled rows whose id is not held out.

    The sample is the ``max_rows`` labelled ids with the smallest hashes, as far as
    their indicators (four bytes each) take ``max_bytes`` in all; so it is the same
    in each run, and what reaches the driver doesn't grow with the input. Rows
    without id or with a label other than 0 and 1 are left out; of rows with equal
    ids one counts, that with the least hash of its text. A null text is an empty
    one, a very long one counts whole. An id with both labels counts for both.
    Without rows of both classes, as for empty tables, every score is the smoothed
    rate of label 1. No other column is looked at, whatever its name.
    """
    known = labels.select(F.col(id).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).distinct()
    known = known.orderBy(F.xxhash64("k"), "k", "y").limit(max_rows)
    found = docs.select(F.col(id).alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).join(F.broadcast(known), "k")
    sample = found.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for first, texts in chunks(batch["t"]):
                own, ids = features.of(texts)
                ends = np.searchsorted(own, np.arange(len(texts) + 1))
                packed = [ids[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part["k"], part["y"], pa.array(packed, pa.binary())], ["k", "y", "x"])

    rows = sample.mapInArrow(extract, f"k {dict(docs.dtypes)[id]}, y int, x binary")
    # one task, of the bounded sample's rows alone
    upto = F.sum(F.octet_length("x")).over(Window.orderBy(F.xxhash64("k"), "k", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = rows.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("k", "y", "x").toArrow().to_pylist()
    got.sort(key=lambda r: (r["k"], r["y"], r["x"]))
    rows = [np.frombuffer(r["x"], np.int32).astype(np.int64) for r in got]
    y = np.array([2 * r["y"] - 1 for r in got], float)
    if len(set(y)) < 2:
        ones = float((y > 0).sum())
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log((ones + 1) / (len(y) - ones + 1))))
    part = np.array([xxhash.xxh3_64_intdigest(str(r["k"])) % 4 for r in got])
    size, learn, rest = 1 << BITS, np.flatnonzero(part > 0), np.flatnonzero(part == 0)

    def model(at: np.ndarray) -> Model:
        own = [rows[i] for i in at]
        ratio = log_count_ratio(own, y[at], size)
        w, bias = coordinate_descent(own, y[at], ratio)
        return Model(ratio * w, bias, 1.0, 0.0)

    out = model(np.arange(len(rows)))
    if len(set(y[learn])) == 2 and len(set(y[rest])) == 2:
        trial = model(learn)
        margins = np.array([trial.margins(1, np.zeros(len(rows[i]), np.int64), rows[i])[0] for i in rest])
        out.slope, out.offset = logistic(margins, y[rest])
    return out


def held_out(id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is a multiple of 5; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``, a double from 0 to 1, for every row.

    A null text is scored as an empty one, which has no indicators: its score is
    that of the bias alone. A very long text is scored whole. Repeated rows get
    equal scores; an empty table stays empty. A column of the name ``out`` is
    replaced; all others stay.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.bits)
        for batch in batches:
            scores = [model.scores(model.margins(len(texts), *features.of(texts))) for _, texts in chunks(batch[text])]
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType(), False)]))


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.3,
    max_rows: int = 5000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """docs with held_out, score and predicted (1 where the score reaches the threshold).

    ``fit`` says what is learnt from, ``score`` what null, empty and very long texts
    and repeated rows get. A row without id counts as held out. An empty table of
    texts stays empty; without labels every score is 0.5. Columns named like an
    output are replaced, all others stay.
    """
    model = fit(docs, labels, id, text, max_rows=max_rows, max_bytes=max_bytes)
    out = score(docs, model, text)
    return out.withColumns({"held_out": held_out(F.col(id)), "predicted": (F.col("score") >= threshold).cast("int")})
