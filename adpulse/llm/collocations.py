"""Phrase collocations by sorted count streams.

Every word occurrence gives one row: the words from it on, ``MAX_WORDS`` at most,
up to the end of its piece.  Sorted by their words, these rows are the count
stream of all orders at once: the occurrences of a phrase of m words are the run
of rows that begin with it.

1. Tasks sort the rows of a block of text and send each distinct row once, with
   its count, to the range of the sort order that it falls in.  Range bounds are
   quantiles of a sample, which decides the balance of the ranges and nothing
   else.  A row that stands everywhere is one entry of each block, and a word
   that very many rows begin with is spread over as many ranges as it needs.
2. Each range is merged into one sorted stream and scanned: runs of at least
   ``min_count`` rows give a phrase and its count.  Only phrases that the rows at
   a range's two ends begin with can go on in the next range; their parts are sent
   whatever their size, and summed.
3. The streams of the phrases that are frequent enough, kept by phrase, are
   merged with those of the candidates in prefix order (a cut's first part; the
   longer phrases that begin with it) and in suffix order (its rest; the longer
   phrases that end in it) by sort-merge joins: both sides sorted and read in
   lockstep, no hash table of counts.

A part of a candidate occurs at least as often as the candidate, so every count
that a score needs is in these streams.  A phrase within a longer one of the same
count is also within one that is a single word longer and of the same count, so
one-word extensions decide what is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import utf8
from adpulse.llm.parts import pack, unpack
from adpulse.llm.runtime import keep, prepare

MIN_COUNT = 100          # occurrences of a candidate
MAX_WORDS = 5            # words of the longest phrase
TOP = 2000               # phrases reported for each language
UNKNOWN = "und"          # language of documents without one
BLOCK_BYTES = 4 << 20    # text that a task sorts at a time
RANGE_BYTES = 8 << 20    # text whose rows a range holds, about
SAMPLE_DOCS = 64         # documents sampled for each range bound, to balance the ranges
_END = b"\xff"           # ends a piece; no byte of UTF-8
_BITS = 21               # of a word's number within a block or range
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_SENT = "range long, lang string, blob binary"
_FOUND = "lang string, m int, phrase string, n long, open boolean"


class Rows:
    """Sorted distinct rows of words with their counts; number 0 is the end of a piece."""

    def __init__(self, words: list[bytes], columns: np.ndarray, counts: np.ndarray):
        self.words, self.columns, self.counts = words, columns, counts      # words: in byte order, from number 1 on

    @classmethod
    def of_texts(cls, texts: list[bytes], max_words: int) -> Rows:
        index: dict[bytes, int] = {_END: 0}
        flat = (b" " + _END + b" ").join(texts).translate(_TABLE).replace(_END, b" " + _END + b" ").split()
        raw = np.fromiter((index.setdefault(w, len(index)) for w in flat), np.int64, len(flat))
        del flat
        words, number = _in_order([w for w in index if w != _END])
        first = np.r_[0, number][raw]
        columns = np.zeros((max_words, len(first)), np.int32)
        columns[0] = first
        for j in range(1, max_words):
            columns[j, :-j] = np.where(columns[j - 1, :-j] > 0, first[j:], 0)
        return cls(words, *_distinct(columns[:, first > 0], None))

    def row(self, i: int) -> tuple[bytes, ...]:
        return tuple(self.words[c - 1] for c in self.columns[:, i].tolist() if c)

    def place(self, bound: tuple[bytes, ...]) -> int:
        """How many rows stand before the bound."""
        lo, hi = 0, self.columns.shape[1]
        while lo < hi:
            mid = (lo + hi) // 2
            if self.row(mid) < bound:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def blob(self, a: int, b: int) -> bytes:
        """The rows from a to b, with the words that they use."""
        part = self.columns[:, a:b]
        used = np.unique(part)
        used = used[used > 0]
        small = np.searchsorted(used, part) + 1
        small[part == 0] = 0
        planes = small.astype(np.uint32).view(np.uint8).reshape(len(part), b - a, 4).transpose(0, 2, 1)     # bytes of one weight pack well together
        return pack(b" ".join([self.words[u - 1] for u in used.tolist()]), planes, self.counts[a:b].astype(np.int64))


def _in_order(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(words in byte order, the number of each word given, from 1 on)."""
    if len(words) >= 1 << _BITS:
        raise ValueError("too many different words for one block or range: lower block_bytes or range_bytes")
    order = sorted(range(len(words)), key=words.__getitem__)
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(1, len(words) + 1)
    return [words[i] for i in order], number


def _keys(columns: np.ndarray) -> list[np.ndarray]:
    """Sort keys, least significant first: three words to a number."""
    keys = []
    for j in range(0, len(columns), 3):
        key = np.zeros(columns.shape[1], np.int64)
        for c in columns[j: j + 3]:
            key = key << _BITS | c
        keys.append(key << _BITS * (3 - len(columns[j: j + 3])))
    return keys[::-1]


def _distinct(columns: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sum of the counts of each."""
    n = columns.shape[1]
    if not n:
        return columns, np.zeros(0, np.int64)
    keys = _keys(columns)
    order = np.lexsort(keys)
    new = np.zeros(n, bool)
    new[0] = True
    while keys:                                    # one sorted key at a time, and no sorted copy of the rows
        key = keys.pop()[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.r_[at, n]) if counts is None else np.add.reduceat(counts[order], at)
    return columns[:, order[at]], total


def merged(blobs: list[bytes], max_words: int) -> Rows:
    """The rows of several blobs as one sorted stream."""
    parts = [unpack(b) for b in blobs]
    lists = [p[0].split(b" ") if p[0] else [] for p in parts]
    index: dict[bytes, int] = {}
    for words in lists:
        for w in words:
            index.setdefault(w, len(index))
    words, number = _in_order(list(index))
    counts = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts])
    columns, at = np.empty((max_words, len(counts)), np.int32), 0
    for i, own in enumerate(lists):
        p, parts[i] = parts[i], None
        new = np.r_[0, number[np.fromiter((index[w] for w in own), np.int64, len(own))]].astype(np.int32)
        small = np.ascontiguousarray(np.frombuffer(p[1], np.uint8).reshape(max_words, 4, -1).transpose(0, 2, 1)).view(np.uint32)
        small = small.reshape(max_words, -1)
        columns[:, at: at + small.shape[1]] = new[small]
        at += small.shape[1]
    return Rows(words, *_distinct(columns, counts))


def phrases(rows: Rows, min_count: int) -> Iterator[tuple[int, bytes, int, bool]]:
    """(words, phrase, count, open) of the runs of a sorted stream.

    Runs that touch either end of the stream are open: they may go on in the
    next range, and come out whatever their count.
    """
    n = rows.columns.shape[1]
    total = np.r_[0, np.cumsum(rows.counts)]
    new = np.zeros(n, bool)
    for m in range(1, len(rows.columns) + 1):
        new[0] = True
        new[1:] |= rows.columns[m - 1, 1:] != rows.columns[m - 1, :-1]
        at = np.flatnonzero(new)
        end = np.r_[at[1:], n]
        count = total[end] - total[at]
        touches = (at == 0) | (end == n)
        for i in np.flatnonzero(((count >= min_count) | touches) & (rows.columns[m - 1, at] > 0)).tolist():
            row = rows.row(int(at[i]))[:m]
            yield m, b" ".join(row), int(count[i]), bool(touches[i])


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, list[bytes]]]:
    """The texts of each language, ``limit`` bytes together at most; a longer text is cut where a piece ends anyway."""
    held, filled = defaultdict(list), 0
    for b in batches:
        flat, offsets = utf8(b.column(1))
        data = flat.tobytes()
        for lang, s, e in zip(b.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
            while s < e:
                cut = e
                if e - s > limit:
                    found = _PIECE_END.search(data, s + limit, e)
                    cut = found.end() if found else e
                if filled and filled + cut - s > limit:
                    yield held
                    held, filled = defaultdict(list), 0
                held[lang].append(data[s:cut])
                filled += cut - s
                s = cut
    if filled:
        yield held


def _bounds(slim: DataFrame, total: int, ranges: int, max_words: int, block_bytes: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Where ranges begin in the order of (lang, words): quantiles of the rows of some documents."""
    docs = slim.count()
    step = max(1, docs // (SAMPLE_DOCS * ranges))
    some = slim.where(F.monotonically_increasing_id() % step == 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block_bytes):
            for lang, texts in held.items():
                rows = Rows.of_texts(texts, max_words)
                size = rows.columns.shape[1]
                n = -(-size * 96 * ranges * step // max(total, 1))          # about 16 points for each range, at 6 bytes a row
                at = [size * i // n for i in range(n)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "row": pa.array([b" ".join(rows.row(int(i))) for i in at], pa.binary())})

    points = sorted((r.lang, tuple(bytes(r.row).split(b" "))) for r in some.mapInArrow(spread, "lang string, row binary").collect())
    picked = [points[len(points) * k // ranges] for k in range(1, ranges)] if points else []
    return sorted(set(picked))


def _streams(slim: DataFrame, min_count: int, max_words: int, block_bytes: int, range_bytes: int) -> DataFrame:
    """(lang, m, phrase, n) of the phrases with ``min_count`` occurrences; m = 0: all words of the language."""
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    bounds = _bounds(slim, total, ranges, max_words, block_bytes) if ranges > 1 else []
    langs = [b[0] for b in bounds]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block_bytes):
            out = []
            for lang, texts in held.items():
                rows = Rows.of_texts(texts, max_words)
                a, n = 0, rows.columns.shape[1]
                first, last = bisect_left(langs, lang), bisect_left(langs, lang + "\0")
                for r in range(first, last):                     # bounds within this language
                    b = rows.place(bounds[r][1])
                    if b > a:
                        out.append((r, lang, rows.blob(a, b)))
                    a = b
                if n > a:
                    out.append((last, lang, rows.blob(a, n)))
            yield pa.RecordBatch.from_pydict({"range": pa.array([x[0] for x in out], pa.int64()), "lang": pa.array([x[1] for x in out], pa.string()),
                                              "blob": pa.array([x[2] for x in out], pa.binary())})

    def scan(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        rows = merged(table.column("blob").to_pylist(), max_words)
        found = [(0, b"", int(rows.counts.sum()), True), *phrases(rows, min_count)]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "m": pa.array([f[0] for f in found], pa.int32()),
                         "phrase": pa.array([f[1] for f in found], pa.binary()).cast(pa.string()), "n": pa.array([f[2] for f in found], pa.int64()),
                         "open": pa.array([f[3] for f in found], pa.bool_())})

    sent = slim.mapInArrow(send, _SENT)
    # As many tasks as ranges, so that a task's share does not grow with the table.
    sent = sent.repartition(max(ranges, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range")
    found = keep(sent.groupBy("range", "lang").applyInArrow(scan, _FOUND), "phrases")
    closed = found.where(~F.col("open")).select("lang", "m", "phrase", "n")
    opened = found.where("open").groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n"))
    return keep(closed.unionByName(opened).where((F.col("n") >= min_count) | (F.col("m") == 0)), "streams")


def _words(column: str, start, length):
    return F.array_join(F.slice(F.split(column, " "), start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Words are split at spaces and tabs, pieces at ``.,;:!?`` and line ends, A-Z
    count as a-z.  A phrase's score is ``floor(1000 a n / (l r))`` at its lowest
    cut.  Null texts count as empty, a null language is ``und``; languages
    without a candidate, and an empty table, give no rows.  Repeated rows count
    as often as they stand there.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    streams = _streams(slim, min_count, max_words, block_bytes, range_bytes)
    counts = streams.where("m > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    longer = streams.where("m > 1").select("lang", "m", "phrase", F.col("n").alias("a"))
    # Prefix order and suffix order: each phrase by all but its last word, and by all but its first.
    grown = [longer.select("lang", _words("phrase", F.lit(at), F.col("m") - 1).alias("phrase"), F.col("a").alias("by")) for at in (1, 2)]
    grown = grown[0].unionByName(grown[1]).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    free = (longer.join(grown.hint("merge"), ["lang", "phrase"], "left")
            .where(F.col("by").isNull() | (100 * F.col("by").cast("decimal(20,0)") < 100 * F.col("a").cast("decimal(20,0)"))).select("lang", "m", "phrase", "a"))
    cuts = free.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", F.lit(1), F.col("k")).alias("left"), _words("phrase", F.col("k") + 1, F.col("m")).alias("right"))
    left, right = (counts.select("lang", F.col("part").alias(s), F.col("part_n").alias(s[0])) for s in ("left", "right"))
    scored = cuts.join(left.hint("merge"), ["lang", "left"]).join(right.hint("merge"), ["lang", "right"])
    totals = streams.where("m = 0").select("lang", "n")
    scored = scored.join(totals, "lang")            # one row a language: sent to every task only if its measured size is small
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    product = F.lit(1000).cast("decimal(4,0)") * (exact("a", 15) * exact("n", 16))
    scored = scored.withColumn("product", product).withColumn("divisor", exact("l", 15) * exact("r", 15)).withColumn("score", F.expr("product div divisor"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    order = [F.col("x.score").desc(), F.col("x.a").desc(), F.col("phrase").asc()]
    ranked = lowest.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
