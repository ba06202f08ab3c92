"""Quality rules as a short-circuit cascade.

Each rule rejects a document for one reason.  On a sample, every rule is run on
every document that it would meet: its cost is the time that it took beyond what
is worked out for the document anyway, its selectivity the share that it rejected.  Rules then go by rejections per cost, highest first, and a document
meets the next rule only if it passed those before.  A document is kept if no
rule rejects it, so the order changes the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import SPACES, texts
from adpulse.llm.runtime import prepare

SAMPLE_DOCS = 256        # documents that costs and selectivities are taken from

_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = (bytes(range(a, a + 26)) for a in (65, 97))
_CONTINUATION = bytes(range(0x80, 0xC0))


def _count(data: bytes, members: bytes) -> int:
    return len(data) - len(data.translate(None, members))


class Doc:
    """A text's measures, each worked out when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()           # bytes: the six ASCII spaces only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: all but the spaces and the continuation bytes."""
        return len(self.data.translate(None, SPACES + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return _count(self.data, _SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        """The words as numbers, equal ones alike."""
        index = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        return np.fromiter(map(index.__getitem__, self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        c = self.codes
        if len(c) < 3:
            return 0
        size = int(c.max()) + 1
        window = c[:-2] * size + c[1:-1]
        if size ** 3 >= 1 << 63:
            window = np.unique(window, return_inverse=True)[1]
        window = window * size + c[2:]
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(window, twice)
        covered = np.zeros(len(c), bool)
        for shift in range(3):
            covered[shift: len(c) - 2 + shift] |= hit
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return _count(self.data, _UPPER)

    @cached_property
    def n_lower(self) -> int:
        return _count(self.data, _LOWER)

    @cached_property
    def n_shouts(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        return int((self.codes[1:] == self.codes[:-1]).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells of a Doc whether this rule turns it down."""

    name: str
    rejects: Callable[[Doc], bool]


# The contract's base: too short, or mostly repeated windows.
BASE = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
# Beyond the base; whole numbers only, so that SQL can say the same.
STANDARD = (
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words),
    Rule("symbols", lambda d: 5 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("capitals", lambda d: d.n_upper > d.n_lower),
    Rule("exclamations", lambda d: 4 * d.n_shouts > d.n_words),
    Rule("stutter", lambda d: 4 * d.n_stutters > d.n_words),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float           # seconds a document
    selectivity: float    # share of documents rejected


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> tuple[Rule, ...]:
    """By rejections per cost, highest first; ties keep the order given, rules without an estimate go last."""
    by = {e.name: e.selectivity / max(e.cost, 1e-9) for e in estimates}
    return tuple(sorted(rules, key=lambda r: -by.get(r.name, -1.0)))


def rejected_by(doc: Doc, rules: Sequence[Rule]) -> str | None:
    """The first rule that rejects, None if all pass; later rules are not looked at."""
    return next((r.name for r in rules if r.rejects(doc)), None)


def estimate(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
             base: Sequence[Rule] = (), measured: Sequence[str] = ()) -> list[Estimate]:
    """Cost and selectivity of each rule on the documents of smallest id hash.

    ``measured`` names what is worked out for every document before the rules, and
    costs them nothing; documents that a rule of ``base`` rejects don't meet them,
    and don't count (if it rejects the whole sample, there is no estimate).
    Only sums come back to the driver: one row for each rule and task.  Without
    documents there is no estimate.
    """
    prepare(docs.sparkSession)
    ids = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs).collect()]
    if not ids:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, turned, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for data in texts(b.column(0)):
                known = Doc(data)
                for m in measured:
                    getattr(known, m)
                if any(r.rejects(known) for r in base):
                    continue
                n += 1
                for i, rule in enumerate(rules):
                    doc = Doc(data)                # what is known of a document that comes to the rules, no more
                    doc.__dict__.update(known.__dict__)
                    t = time.perf_counter()
                    turned[i] += rule.rejects(doc)
                    spent[i] += time.perf_counter() - t
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(turned, pa.int64()), pa.array([n] * len(rules), pa.int64())],
                                         names=["name", "spent", "turned", "n"])

    sample = docs.where(F.col(id_col).isin(ids)).select(text_col)
    sums = sample.mapInArrow(run, "name string, spent double, turned long, n long").groupBy("name").agg(F.sum("spent"), F.sum("turned"), F.sum("n"))
    return [Estimate(name, s / n, t / n) for name, s, t, n in sums.collect() if n]


def cascade(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *STANDARD), id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, that every rule lets pass; a null text counts as empty."""
    order = ordered(rules, estimate(docs, rules, id_col, text_col, sample_docs))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([rejected_by(Doc(t), order) is None for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame, rules: Sequence[Rule] = STANDARD, base: Sequence[Rule] = BASE, id_col: str = "doc_id", text_col: str = "text",
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, the base measures, base_failed, kept) of every row; a null text has no words.

    The base measures are worked out for every document; the other rules only
    for those that pass the base, in the order of the estimates.
    """
    order = ordered(rules, estimate(docs, rules, id_col, text_col, sample_docs, base, MEASURES))
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, failed, kept = [], [], []
            for data in texts(b.column(1)):
                doc = Doc(data)
                rows.append([getattr(doc, m) for m in MEASURES])
                failed.append(any(r.rejects(doc) for r in base))
                kept.append(not failed[-1] and rejected_by(doc, order) is None)
            columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                                             names=["doc_id", *MEASURES, "base_failed", "kept"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, {', '.join(f'{m} long' for m in MEASURES)}, base_failed boolean, kept boolean")
