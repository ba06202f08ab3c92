"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

A text's features are the n-grams that occur in it (ASCII lower-cased bytes).
Each one is scaled by its log-count ratio: the log of its share among the toxic
texts' n-grams over its share among the others'.  A logistic regression is
trained on the scaled features of labelled texts.  Every n-gram that enough of
these texts have is a feature, so those of rare words and languages count too.
n-grams that stand in the same texts are one column of the regression, scaled by
the root of their number, which gives each the weight it has as a column of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import utf8
from adpulse.llm.parts import pack, unpack
from adpulse.llm.runtime import prepare
from adpulse.llm.training import labelled_sample

NGRAMS = (4, 7)          # shortest and longest, in bytes
MIN_DOCS = 5             # training texts that an n-gram must occur in
SMOOTHING = 2.0          # texts of either class added to the counts of an n-gram
PENALTY = 0.1            # of squared weights
STEPS = 500              # at most; descent ends where the gradient is small
MEMORY = 10              # steps that the descent remembers
PER_CLASS = 1500         # training documents of each class
MODEL_BYTES = 256 << 20  # of a model at most: 16 a feature, and its table of places
FOLDS, HELD_OUT = 5, 0
_BLOCK = 1 << 19         # positions looked at together
_CELLS = 1 << 20         # features of training texts looked at together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the n-grams of a text, block by block, repeats included."""
    low = _LOWER[text]
    for at in range(0, len(low), _BLOCK):
        part = low[at: at + _BLOCK + NGRAMS[1] - 1]
        code = np.zeros(len(part), np.uint64)
        for n in range(1, NGRAMS[1] + 1):              # each length from the one before
            m = len(part) - n + 1
            if m <= 0:
                break
            code = (code[:m] << np.uint64(8)) | part[n - 1:]
            if n >= NGRAMS[0]:
                yield code[:_BLOCK] | np.uint64(n << 56)   # no two lengths meet


@dataclass
class Model:
    """n-gram codes in the order of their hashes, the weight of each, and the intercept."""

    codes: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        order = np.argsort(self.codes * _MIX)            # an odd factor: no two codes have one hash
        self.codes, self.weights = self.codes[order], self.weights[order]
        self.hashes = self.codes * _MIX
        bits = max(8, len(order).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.last: np.ndarray | None = None              # room for ``_once``, made where it is used

    def _found(self, code: np.ndarray) -> np.ndarray:
        """Places of those of the codes that the model has, each once."""
        h = code * _MIX
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        found = []
        while len(at):                                   # a slot has few codes: one is compared at a time
            left = at < end
            h, at, end = h[left], at[left], end[left]
            same = self.hashes[at] == h
            found.append(at[same])
            h, at, end = h[~same], at[~same] + 1, end[~same]
        return self._once(np.concatenate([np.zeros(0, np.int32), *found]))

    def _once(self, at: np.ndarray) -> np.ndarray:
        if self.last is None:
            self.last = np.empty(len(self.codes), np.int32)
        nth = np.arange(len(at), dtype=np.int32)
        self.last[at] = nth
        return at[self.last[at] == nth]

    def features(self, text: np.ndarray) -> np.ndarray:
        """Which of the codes occur in the text, in order."""
        codes = ngrams(text)
        if len(text) <= _BLOCK:                          # all lengths at once
            codes = [np.concatenate([np.zeros(0, np.uint64), *codes])]
        return np.sort(self._once(np.concatenate([np.zeros(0, np.int32), *map(self._found, codes)])))

    def score(self, text: np.ndarray) -> float:
        z = self.intercept + self.weights[self.features(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Log-count ratios from the weighted counts of each n-gram in either class."""
    p, q = positive + SMOOTHING, negative + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _logistic(col: np.ndarray, n: np.ndarray, labels: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalized regression on scaled features, by limited-memory BFGS.

    ``col`` has the features of the texts end to end, ``n`` of each.
    """
    end = np.cumsum(n)
    cuts = [0]
    while cuts[-1] < len(n):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, end[cuts[-1]] - n[cuts[-1]] + _CELLS, "right"))))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        scaled, total, slope = w * scale, PENALTY / 2 * (w @ w), np.zeros(len(x))
        for i, j in zip(cuts, cuts[1:]):
            c = col[end[i] - n[i]: end[j - 1]].astype(np.int64)
            z = b + np.bincount(np.repeat(np.arange(j - i), n[i:j]), scaled[c], j - i)
            total += (weights[i:j] * (np.logaddexp(0, z) - labels[i:j] * z)).sum()
            d = weights[i:j] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[i:j])
            slope[:-1] += np.bincount(c, np.repeat(d, n[i:j]), len(scale))
            slope[-1] += d.sum()
        slope[:-1] = slope[:-1] * scale + PENALTY * w
        return total, slope

    x = np.zeros(len(scale) + 1)
    x[-1] = np.log((weights[labels == 1].sum() + 1) / (weights[labels == 0].sum() + 1))
    f, g = loss(x)
    least, past = 1e-5 * max(np.linalg.norm(g), 1e-9), []
    for _ in range(STEPS):
        if np.linalg.norm(g) <= least:
            break
        way, alphas = -g, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ way))
            way = way - alphas[-1] * y
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y, r), alpha in zip(past, reversed(alphas)):
            way = way + (alpha - r * (y @ way)) * s
        step, down = 1.0, g @ way
        while True:
            f2, g2 = loss(x + step * way)
            if f2 <= f + 1e-4 * step * down or step < 1e-12:
                break
            step /= 2
        if f2 >= f:                                      # no smaller loss can be told from this one
            break
        s, y = step * way, g2 - g
        if s @ y > 0:
            past = [*past, (s, y, 1 / (s @ y))][-MEMORY:]
        x, f, g = x + s, f2, g2
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents outside the held-out fold.

    n-grams are counted in tasks and summed by a shuffle; the driver gets those
    that ``MIN_DOCS`` texts have and, for each of at most 2 * ``per_class`` texts,
    which columns occur in it.  The model is refused beyond ``MODEL_BYTES``, the
    most that goes to every task.  Without both classes every score is the one label,
    or one half.
    """
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, folds, held_out, per_class, id_col, text_col)
    classes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Both classes weigh the same, one a text on average: smoothing and penalty then mean the
    # same however many labels there are, and rare toxic texts are not outweighed.
    weight_of = {y: sum(classes.values()) / (2 * n) for y, n in classes.items()}
    if len(weight_of) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), {0: -30.0, 1: 30.0}[next(iter(weight_of))] if weight_of else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = utf8(b.column(0))
            for i, y in enumerate(b.column(1).to_pylist()):
                text = flat[offsets[i]: offsets[i + 1]]
                code = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, ngrams(text))]))
                k, mark = len(code), xxhash.xxh64_intdigest(text.tobytes()) >> 16
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.full(k, y, np.int64)), pa.array(np.full(k, mark, np.int64))], names=["code", "pos", "texts"])

    # Equal sums of the texts' hashes, and equal counts: the n-grams stand in the same texts.
    counts = (sample.mapInArrow(count, "code long, pos long, texts long").groupBy("code")
              .agg(F.sum("pos").alias("pos"), F.count("*").alias("n"), F.sum("texts").alias("texts")).where(F.col("n") >= MIN_DOCS)).toArrow()
    if 24 * counts.num_rows > MODEL_BYTES:
        raise ValueError(f"{counts.num_rows} n-grams are more than a model may hold: lower per_class or raise MIN_DOCS")
    codes, pos, n, texts = (counts.column(c).to_numpy().astype(np.int64) for c in ("code", "pos", "n", "texts"))
    order = np.argsort(codes.view(np.uint64))
    codes, pos, n, texts = codes.view(np.uint64)[order], pos[order], n[order], texts[order]
    ratio = ratios(pos * weight_of[1], (n - pos) * weight_of[0])
    _, first, group, members = np.unique(np.stack((texts, n, pos)), axis=1, return_index=True, return_inverse=True, return_counts=True)
    group = group.reshape(-1).astype(np.int32)
    root = np.sqrt(members)
    columns = Model(codes, group, 0.0)                   # for an n-gram's weight, its column

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = utf8(b.column(0))
            found = [np.unique(columns.weights[columns.features(flat[s:e])]) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in found], pa.int64()), pa.array([_packed(x) for x in found], pa.binary()), b.column(1)],
                                             names=["n", "found", "label"])

    rows = sample.mapInArrow(present, "n long, found binary, label int").toArrow()
    size, label_ = (rows.column(c).to_numpy() for c in ("n", "label"))
    weight = np.where(label_ == 1, weight_of[1], weight_of[0])
    found = rows.column("found").to_pylist()
    order = sorted(range(len(found)), key=lambda i: (label_[i], found[i]))
    size, label_, weight = size[order], label_[order], weight[order]
    col, end = np.empty(size.sum(), np.int32), np.cumsum(size)
    for i, e, k in zip(order, end, size):
        col[e - k: e] = _unpacked(found[i])
    del rows, found
    weights, intercept = _logistic(col, size, label_.astype(float), weight, ratio[first] * root)
    return Model(codes, (weights / root)[group] * ratio, intercept)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers by their differences, the first bytes together, then the second ones ..."""
    return pack(np.ascontiguousarray(np.diff(numbers, prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T))


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(blob)[0], np.uint8).reshape(4, -1).T).reshape(-1).view(np.int32))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    flat, offsets = utf8(column)
    return np.array([model.score(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:])], float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have the intercept's score."""
    prepare(docs.sparkSession)
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)), pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under one half."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
