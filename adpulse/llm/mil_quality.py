"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded: the frequencies of
pairs of neighbouring character kinds, and measures of its words, go through a
learned layer.  Gated attention (tanh times sigmoid) gives every passage a
weight, the weights of a bag sum to one, and a logistic unit scores the
weighted sum.  Only labels of whole documents are learned from; which passages
matter is what the attention learns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import blocks, utf8, word_spans
from adpulse.llm.runtime import folded, prepare
from adpulse.llm.training import labelled_sample

PASSAGE_WORDS = 64       # words of a passage, however long the text
BAG_PASSAGES = 64        # passages of a training text that are learned from, evenly spread; scoring takes all
LONG_TEXT = 1 << 20      # bytes of a text that are encoded at a time
PER_CLASS = 1500         # training documents of each class
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 128, 0.01, 1e-4, 7
FOLDS, HELD_OUT = 3, 1   # crc32 of the id, modulo and remainder of the held-out rows

# Kinds of bytes: space, lower, upper, digit, other letter bytes, then punctuation by itself.
_KINDS = np.zeros(256, np.int64)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KINDS[list(b"0123456789")] = 3
_KINDS[128:] = 4
for _i, _members in enumerate((b".,;:", b"!?", b"#*$%&", b"|<>", b"'\"`()-", b"@/\\_=+~^[]{}")):
    _KINDS[list(_members)] = 5 + _i
N_KINDS = 11
WIDTH = N_KINDS * N_KINDS + 6


def encode(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measures of each passage, its row); every row has a passage, empty ones too."""
    n_rows = len(offsets) - 1
    start, end, row = word_spans(flat, offsets)
    n_words = np.bincount(row, minlength=n_rows)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(n_passages) - n_passages
    n = int(n_passages.sum())
    owner = np.repeat(np.arange(n_rows), n_passages)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(start):
        return out, owner
    nth = np.arange(len(start)) - (np.cumsum(n_words) - n_words)[row]
    passage = base[row] + nth // PASSAGE_WORDS

    # Pairs of kinds, a space standing before each row; a byte belongs to the
    # passage of the last word begun, and none counts before a row's first word.
    kind = _KINDS[flat]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    before[offsets[:-1][offsets[:-1] < len(flat)]] = 0
    first = np.full(n_rows, -1)
    first[row[::-1]] = start[::-1]
    lead = np.zeros(len(flat) + 1, np.int64)
    np.add.at(lead, offsets[:-1], 1)
    np.add.at(lead, np.where(first >= 0, first, offsets[1:]), -1)
    pair = N_KINDS * before + kind
    pair[np.cumsum(lead[:-1]) > 0] = 0
    pair[start[0]:] += np.repeat(passage, np.diff(np.r_[start, len(flat)])) * (N_KINDS * N_KINDS)
    pair = pair[start[0]:]
    counts = np.bincount(pair, minlength=n * N_KINDS * N_KINDS).reshape(n, -1).astype(np.float32)
    counts[:, 0] = 0                                   # runs of spaces
    out[:, : N_KINDS * N_KINDS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))

    # A hash for each word, from its bytes and their places.
    word_bytes = end - start
    at = np.repeat(start - (np.cumsum(word_bytes) - word_bytes), word_bytes) + np.arange(word_bytes.sum())
    place = (at - np.repeat(start, word_bytes)).astype(np.uint64)
    mixed = (flat[at].astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    word = np.add.reduceat(mixed, np.cumsum(word_bytes) - word_bytes)

    def distinct(code: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
        new = np.r_[True, key[1:] != key[:-1]]
        return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)

    words = np.maximum(np.bincount(passage, minlength=n), 1)
    same = np.r_[False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]
    three = np.flatnonzero(passage[2:] == passage[:-2]) if len(passage) > 2 else np.zeros(0, np.int64)
    k = N_KINDS * N_KINDS
    out[:, k] = np.log1p(np.bincount(passage, minlength=n)) / 5
    out[:, k + 1] = np.bincount(passage, word_bytes, n) / words / 10
    out[:, k + 2] = distinct(word, passage) / words
    out[:, k + 3] = np.bincount(passage, same, n) / words
    windows = np.bincount(passage[three], minlength=n)
    code = word[three] * np.uint64(3) ^ word[three + 1] * np.uint64(5) ^ word[three + 2] * np.uint64(7) if len(three) else np.zeros(0, np.uint64)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    out[:, k + 4] = np.where(windows > 0, distinct(code, passage[three]) / np.maximum(windows, 1), 1) if len(three) else 1
    out[np.bincount(passage, minlength=n) == 0, k + 4] = 0
    out[:, k + 5] = np.bincount(passage, word_bytes > 25, n) / words
    return out, owner


def stretches(flat: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text in stretches of whole passages, ``limit`` bytes or little more each (one passage at least)."""
    at = 0
    while at < len(flat):
        size = limit
        while True:                                    # words that begin here, up to a whole number of passages
            part = flat[at: at + size]
            start, _, _ = word_spans(part, np.array([0, len(part)]))
            if at + size >= len(flat):
                yield part
                return
            whole = (len(start) - 1) // PASSAGE_WORDS * PASSAGE_WORDS        # the last word may go on beyond
            if whole > 0:
                break
            size *= 2
        yield part[: start[whole]]
        at += int(start[whole])


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score; ``constant`` if there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def _long(self, flat: np.ndarray) -> float:
        """The score of one long text, stretch by stretch: attention's sums are carried along, with the highest exponent so far."""
        top, total, pooled = -np.inf, 0.0, 0.0
        for part in stretches(flat, LONG_TEXT):
            x, _ = encode(part, np.array([0, len(part)]))
            h, a = self._attended((x - self.mean) / self.scale)[:2]
            high = max(top, float(a.max()))
            e = np.exp(a - high)
            fade = np.exp(top - high)
            total, pooled, top = total * fade + e.sum(), pooled * fade + e @ h, high
        return float(1 / (1 + np.exp(-np.clip((pooled / total) @ self.weights["c"] + self.weights["b"][0], -30, 30))))

    def _attended(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encoding and attention of each passage, and the two gates."""
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, (t * s) @ w["w"], t, s

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h, a, t, s = self._attended(x)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, len(owner)])
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), size))
        a /= np.repeat(np.add.reduceat(a, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"][0], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "size": size}

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        out = [np.zeros(0)]
        for i, j in blocks(offsets):
            if self.constant is not None:
                out.append(np.full(j - i, self.constant))
                continue
            if j - i == 1 and offsets[j] - offsets[i] > LONG_TEXT:
                out.append(np.array([self._long(flat[offsets[i]: offsets[j]])]))
                continue
            x, owner = encode(flat[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
            out.append(self.forward((x - self.mean) / self.scale, owner)["p"].astype(float))
        return np.concatenate(out)


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Adam on the weighted cross-entropy of the bags; the same bags in the same order give the same model."""
    nothing = Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {})
    if not len(bags):
        nothing.constant = 0.5
        return nothing
    if labels.min() == labels.max():
        nothing.constant = float(labels[0])
        return nothing
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.05
    del every
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    rng = np.random.default_rng(SEED)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
         "w": init(ATTENTION), "c": init(HIDDEN), "b": np.zeros(1, np.float32)}
    model = Model(mean, scale, w)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    weights = weights / weights.mean()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at: at + BATCH]
            x = np.concatenate([bags[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            f = model.forward(x, owner)
            d = ((f["p"] - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            dz = d[:, None] * w["c"]
            dh = f["a"][:, None] * dz[owner]
            da = (f["h"] * dz[owner]).sum(axis=1)
            first = np.cumsum(f["size"]) - f["size"]
            da = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[owner])
            dg = da[:, None] * w["w"]
            dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
            dh += dt @ w["V"].T + ds @ w["U"].T
            dx = dh * (1 - f["h"] ** 2)
            g = {"E": x.T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                g[k] += DECAY * w[k]
                m1[k] = .9 * m1[k] + .1 * g[k]
                m2[k] = .999 * m2[k] + .001 * g[k] ** 2
                w[k] -= rate * (m1[k] / (1 - .9 ** step)) / (np.sqrt(m2[k] / (1 - .999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents outside the held-out fold.

    Their passages are encoded in tasks; the driver gets at most
    2 * ``per_class`` bags of ``BAG_PASSAGES`` passages.
    """
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, folds, held_out, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = utf8(b.column(0))
            bags = []
            for i, j in blocks(offsets):
                x, owner = encode(flat[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                for bag in np.split(x, np.flatnonzero(np.diff(owner)) + 1):
                    if len(bag) > BAG_PASSAGES:
                        bag = bag[np.linspace(0, len(bag) - 1, BAG_PASSAGES).round().astype(int)]
                    bags.append(bag.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), b.column(1), b.column(2)], names=["bag", "label", "weight"])

    rows = sample.mapInArrow(run, "bag binary, label int, weight double").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    return fit(bags, np.array([r.label for r in rows], np.float32), np.array([r.weight for r in rows], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text counts as empty, and an empty one has one empty passage."""
    prepare(docs.sparkSession)
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(*utf8(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, score double")


def predictions(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(doc_id, held_out, score, predicted); a null id is in no fold."""
    return scored.select("doc_id", folded("doc_id", folds, held_out).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least one half."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(*utf8(b.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
