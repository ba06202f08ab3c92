"""Removal of repeated word windows by a compressed FM-index per shard.

Each word covered by a window of ``window`` words that also starts in a document
with a smaller id goes; windows are judged on the input and never cross documents.

Every window has an anchor: the smallest hash among its runs of five words.
Equal windows have equal anchors, so a window can only repeat where its anchor does.

1. The documents are written once, in parts of a few MB, to a table bucketed by
   part.  The three passes over the texts read it where it lies; what is shuffled
   is anchors, and word numbers around the anchors that documents share.
2. Each part sends its distinct anchors (8 bytes each, packed by bucket) with the
   words of their distinct strings, and each bucket answers which of them occur in
   several documents, and which are in more text than a shard holds (hot ones).
3. Runs of consecutive windows with one shared anchor go, as one string of words
   each, to the anchor's bucket; a part sends equal strings once, with its smallest
   id.  A hot anchor's windows are strings of their own, dealt over all buckets by
   the hash of the window.  There are as many buckets as the parts ask for.
4. A bucket deals its distinct strings into shards of bounded size, at anchors.
   Each shard's strings are the text of an FM-index (``fm_index``).  The strings are
   then streamed against it: backward search gives, word by word, the longest match
   in the shard and the interval of suffixes that begin with it.  Where a match
   reaches ``window`` words its interval is reported, with the smallest id in it.
5. Each part learns which of its windows have a smaller id elsewhere, and cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from adpulse.llm.arrowtext import joined, joined_words, word_list, word_numbers
from adpulse.llm.fm_index import FMIndex
from adpulse.llm.parts import pack, unpack, write_parts
from adpulse.llm.runtime import keep, prepare

WINDOW = 13
ANCHOR = 5                     # words that an anchor hashes
PART_BYTES = 4 << 20           # text of a part (one document at least)
SHARD_WORDS = 1 << 18          # words of an index (one anchor's strings at least)
MAX_RUN = 256                  # windows in one string; longer runs (periodic text) are cut
BUCKET_PARTS = 8               # parts' worth of anchors and strings that a bucket holds, about
_BLOCK = 1 << 20               # words that a pass looks at together
_BLOB_BYTES = 16 << 20         # of blobs whose words are numbered together
_LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
_ONE = np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def _rolled(key: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of ``words`` neighbours."""
    n = len(key) - words + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(words if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + key[j: j + n]
    return _mixed(h)


class _Part:
    """A part's documents in the order of their ids, their words numbered, and their runs of windows."""

    def __init__(self, table: pa.Table, window: int):
        ids = np.asarray(table.column("_id").fill_null(_LAST).to_numpy(), np.int64) if table.num_rows else np.zeros(0, np.int64)
        order = np.lexsort((table.column("_row").to_numpy(), ids))
        self.table, self.ids, self.window = table.take(pa.array(order)), ids[order], window
        self.flat, self.offsets, self.words = word_numbers(self.table.column("_text"))
        self.n, self.small = np.diff(self.offsets), np.zeros(len(self.words), np.int32)
        self.key = np.fromiter(map(xxhash.xxh64_intdigest, word_list(self.words)), np.uint64, len(self.words))
        self._find_runs()

    def _find_runs(self) -> None:
        """(start, end, value): runs of windows [start, end) of one document with one anchor."""
        w, k = self.window, min(ANCHOR, self.window)
        ok = np.ones(len(self.flat), bool)
        for e, n in zip(self.offsets[1:].tolist(), self.n.tolist()):
            ok[e - min(n, w - 1): e] = False
        found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]]
        for at in range(0, len(self.flat), _BLOCK):
            here = ok[at: at + _BLOCK]
            h = _rolled(self.key[self.flat[at: at + _BLOCK + w - 1]], k) & ~_ONE
            span, done = w - k + 1, 1                    # smallest of `span` hashes, by doubling
            while done < span and len(h):
                step = min(done, span - done)
                h = np.minimum(h[:-step], h[step:])
                done += step
            anchor = np.zeros(len(here), np.uint64)
            anchor[: min(len(h), len(here))] = h[: len(here)]
            starts = here.copy()
            starts[1:] &= ~here[:-1] | (anchor[1:] != anchor[:-1])
            s = np.flatnonzero(starts)
            stops = here.copy()
            stops[:-1] &= starts[1:] | ~here[1:]
            found.append([s + at, np.flatnonzero(stops) + 1 + at, anchor[s]])
        start, end, value = (np.concatenate(x) for x in zip(*found))
        pieces = -(-(end - start) // MAX_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(start, pieces) + nth * MAX_RUN
        self.end, self.value = np.minimum(np.repeat(end, pieces), self.start + MAX_RUN), np.repeat(value, pieces)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors in order, the lowest bit set where several ids have it, and the words of each one's distinct strings."""
        order = np.argsort(self.value, kind="stable")
        v, d = self.value[order], self.ids[self.doc[order]]
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        if not len(at):
            return v, np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        start, end = self.start[order], self.end[order] + self.window - 1
        size, number = end - start, np.diff(np.r_[at, len(v)])
        data, seen = self.flat.tobytes(), set()
        for i in np.flatnonzero(np.repeat(number, number) > 1).tolist():     # equal strings count once
            key = data[4 * start[i]: 4 * end[i]]
            if key in seen:
                size[i] = 0
            seen.add(key)
        return v[at] | several.astype(np.uint64), np.add.reduceat(size, at)

    def strings(self, shared: np.ndarray) -> None:
        """Finds the distinct strings of the runs whose anchor is shared.

        ``shared``: anchors in order, the lowest bit set for hot ones; a hot
        anchor's windows are strings of their own, routed by their hash.
        """
        at = np.searchsorted(shared, self.value)
        at[at == len(shared)] = 0
        hit = shared[at] & ~_ONE == self.value
        start, end, doc, route = self.start[hit], self.end[hit], self.doc[hit], self.value[hit]
        hot = shared[at[hit]] & _ONE == 1
        if hot.any():
            n = np.where(hot, end - start, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.repeat(hot, n)
            start, doc, route = np.repeat(start, n) + nth, np.repeat(doc, n), np.repeat(route, n)
            end = np.where(one, start + 1, np.repeat(end, n))
            for i in range(0, len(start), _BLOCK):
                of = np.flatnonzero(one[i: i + _BLOCK]) + i
                h = np.zeros(len(of), np.uint64)
                for j in range(self.window):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + self.key[self.flat[start[of] + j]]
                route[of] = _mixed(h) & ~_ONE
        data, index = self.flat.tobytes(), {}
        spans = zip((4 * start).tolist(), (4 * (end + self.window - 1)).tolist())
        self.which = np.fromiter((index.setdefault(data[s:e], len(index)) for s, e in spans), np.int64, len(start))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(np.r_[-1, self.which])))      # runs lie by id: the first has the smallest
        self.begin, self.size = start[first], end[first] + self.window - 1 - start[first]    # a string stands where its first run does
        self.least, self.route = self.ids[doc[first]], route[first]
        self.run_start, self.run_end, self.run_doc = start, end, doc

    def blob(self, of: np.ndarray) -> bytes:
        """Some of the strings: their words, the number of words of each, smallest ids and routes."""
        size = self.size[of]
        flat = self.flat[np.repeat(self.begin[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        nth = np.arange(len(flat), dtype=np.int32)
        self.small[flat] = nth
        used = np.sort(flat[self.small[flat] == nth])                                  # each word once
        self.small[used] = nth[: len(used)]
        planes = self.small[flat].view(np.uint8).reshape(-1, 4).T                      # bytes of one weight pack well together
        return pack(joined(self.words.take(pa.array(used))), planes, size.astype(np.uint32), self.least[of], self.route[of])

    def covered(self, later: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Which words go: ``later`` runs whole, and of the others the windows that ``bits`` tells, string by string."""
        begins = np.zeros(len(self.flat) + 1, np.int64)
        np.add.at(begins, self.run_start[later], 1)
        np.add.at(begins, self.run_end[later], -1)
        starts = np.cumsum(begins[:-1]) > 0
        n = self.size - (self.window - 1)
        first = np.cumsum(n) - n
        hit = np.r_[0, np.cumsum(bits)]
        some = np.flatnonzero(~later & (hit[first + n] > hit[first])[self.which])
        for i in range(0, len(some), _BLOCK // 8):
            of = some[i: i + _BLOCK // 8]
            k = n[self.which[of]]
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            starts[(np.repeat(self.run_start[of], k) + nth)[bits[np.repeat(first[self.which[of]], k) + nth]]] = True
        upto = np.cumsum(starts)
        gone = upto > 0
        gone[self.window:] = upto[self.window:] > upto[: -self.window]
        return gone


def _read_blob(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, planes, size, least, route = unpack(blob)
    small = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
    return words, small, np.frombuffer(size, np.uint32).astype(np.int64), np.frombuffer(least, np.int64), np.frombuffer(route, np.uint64)


def _renumbered(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """What each blob holds; instead of its words, their numbers from 1 on, the same in all blobs."""
    known, i = pa.array([], pa.large_binary()), 0
    while i < len(blobs):
        some, filled = [], 0
        while i < len(blobs) and filled < _BLOB_BYTES:
            some.append(_read_blob(blobs[i]))
            filled += len(some[-1][0]) + some[-1][1].nbytes
            i += 1
        number, offsets, words = word_numbers(pa.array([x[0] for x in some], pa.large_binary()))
        coded = pa.concat_arrays([known, words]).dictionary_encode()      # known words keep their numbers
        to = coded.indices.to_numpy()[len(known):] + np.int32(1)
        known = coded.dictionary
        for (_, *others), s, e in zip(some, offsets.tolist(), offsets[1:].tolist()):
            yield to[number[s:e]], *others


def smallest_ids(strings: list[np.ndarray], least: np.ndarray, route: np.ndarray, window: int, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """String by string, the smallest id that each window of the distinct strings (word numbers from 1 on) has in any string.

    Strings of one route lie in one shard; a shard holds as many routes as its size allows.
    """
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - (window - 1)
    first = np.cumsum(windows) - windows
    out = np.full(windows.sum(), _LAST, np.int64)
    order = np.argsort(route, kind="stable")
    size = np.fromiter((len(strings[i]) + 1 for i in order.tolist()), np.int64, len(order))
    same = route[order]
    begin = np.flatnonzero(np.r_[True, same[1:] != same[:-1]]) if len(order) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(size)]
    ends = np.r_[begin[1:], len(order)]
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(total[ends], total[begin[i]] + shard_words, "right")))
        members = order[begin[i]: ends[j - 1]].tolist()
        flat = np.concatenate([strings[m] for m in members]).astype(np.int64)
        n = np.fromiter((len(strings[m]) for m in members), np.int64, len(members))
        offsets = np.r_[0, np.cumsum(n)]
        text = np.insert(flat, offsets[1:], 0)                               # 0 ends each string
        index = FMIndex(text, window)
        own = np.insert(np.repeat(least[members], n), offsets[1:], _LAST)    # no window begins at an end of string
        in_group = np.minimum.reduceat(own[index.order], index.group_first)
        length, place = index.matching_statistics(flat, offsets)
        at = np.flatnonzero(length == window)                                # a match of a whole window: its interval is reported
        of = np.searchsorted(offsets, at, "right") - 1
        out[first[members][of] + at - offsets[of]] = in_group[index.group[place[at]]]
        i = j
    return out


# --- Spark jobs ------------------------------------------------------------------

_BLOB = "part long, bucket long, blob binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("part", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())))})


def _by_bucket(value: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in the order given) of the values."""
    bucket = ((value >> _ONE) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b]: cuts[b + 1]]


def _shared_anchors(table: pa.Table, shard_words: int) -> pa.Table:
    """Answers each part which of the anchors it sent are shared; the lowest bit tells hot ones."""
    blobs = [unpack(x) for x in table.column("blob").to_pylist()]
    lists, sizes = [np.frombuffer(a, np.uint64) for a, _ in blobs], [np.frombuffer(s, np.uint32) for _, s in blobs]
    every = np.concatenate(lists)
    once, of, n_parts = np.unique(every & ~_ONE, return_inverse=True, return_counts=True)
    common = n_parts > 1
    common[of[every & _ONE == 1]] = True
    hot = np.bincount(of, np.concatenate(sizes), len(once)) > shard_words
    marked = once | hot.astype(np.uint64)
    out = []
    for part, at in zip(table.column("part").to_pylist(), np.split(of, np.cumsum([len(x) for x in lists])[:-1])):
        at = at[common[at]]
        if len(at):
            out.append((part, table.column("bucket")[0].as_py(), pack(np.sort(marked[at]))))
    return _rows(out)


def _judged(table: pa.Table, window: int, shard_words: int) -> pa.Table:
    """Answers each part which windows of its strings some document with a smaller id has."""
    index: dict[bytes, int] = {}
    which, least, route = [], [], []
    for new, small, size, low, way in _renumbered(table.column("blob").to_pylist()):
        data = new[small].tobytes()
        ends = (4 * np.cumsum(size)).tolist()
        which.append(np.fromiter((index.setdefault(data[e - 4 * n: e], len(index)) for n, e in zip(size.tolist(), ends)), np.int64, len(size)))
        least.append(low)
        route.append(way)
    counts = [len(w) for w in which]
    which, least, route = np.concatenate(which), np.concatenate(least), np.concatenate(route)
    strings = [np.frombuffer(x, np.int32) for x in index]
    low, way = np.full(len(strings), _LAST, np.int64), np.zeros(len(strings), np.uint64)
    np.minimum.at(low, which, least)
    way[which] = route
    smallest = smallest_ids(strings, low, way, window, shard_words)
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - (window - 1)
    first = np.cumsum(windows) - windows
    out, at = [], 0
    for part, n in zip(table.column("part").to_pylist(), counts):
        of, own = which[at: at + n], least[at: at + n]
        at += n
        k = windows[of]
        place = np.repeat(first[of] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        out.append((part, table.column("bucket")[0].as_py(), pack(np.packbits(smallest[place] < np.repeat(own, k)))))
    return _rows(out)


def _cut(docs: DataFrame, finish, schema: StructType, id_col: str, text_col: str, window: int, part_bytes: int, shard_words: int) -> DataFrame:
    """``finish(part, gone)`` of each part, where ``gone`` tells which words go."""
    spark = prepare(docs.sparkSession)
    parts = write_parts(docs, id_col, text_col, part_bytes)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.select("_part").distinct().count() // BUCKET_PARTS))
    slim = parts.select("_part", "_row", "_id", "_text")
    out_schema = to_arrow_schema(schema)

    def number(table: pa.Table) -> int:
        return table.column("_part")[0].as_py()

    def send_anchors(table: pa.Table) -> pa.Table:
        value, size = _Part(table, window).anchors()
        size = np.minimum(size, np.iinfo(np.uint32).max).astype(np.uint32)
        return _rows([(number(table), b, pack(value[at], size[at])) for b, at in _by_bucket(value, buckets)])

    def shared_of(blobs: pa.Table) -> np.ndarray:
        return np.sort(np.concatenate([np.frombuffer(unpack(x)[0], np.uint64) for x in blobs.column("blob").to_pylist()]))

    def send_strings(table: pa.Table, blobs: pa.Table) -> pa.Table:
        if not table.num_rows or not blobs.num_rows:
            return _rows([])
        part = _Part(table, window)
        part.strings(shared_of(blobs))
        return _rows([(number(table), b, part.blob(at)) for b, at in _by_bucket(part.route, buckets)])

    def cut(table: pa.Table, blobs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=out_schema)
        part = _Part(table, window)
        gone = np.zeros(len(part.flat), bool)
        if blobs.num_rows:
            answer = np.asarray(blobs.column("answer").to_numpy(zero_copy_only=False), bool)
            part.strings(shared_of(blobs.filter(pa.array(~answer))))
            answers = blobs.filter(pa.array(answer))
            got = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
            n = part.size - (window - 1)
            first = np.cumsum(n) - n
            bits = np.zeros(n.sum(), bool)
            for b, at in _by_bucket(part.route, buckets):
                k = n[at]
                place = np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                bits[place] = np.unpackbits(np.frombuffer(unpack(got[b])[0], np.uint8), count=len(place)).astype(bool)
            # This part itself has a later run's string under a smaller id.
            gone = part.covered(part.ids[part.run_doc] > part.least[part.which], bits)
        return finish(part, gone)

    found = slim.groupBy("_part").applyInArrow(send_anchors, _BLOB)
    shared = keep(found.groupBy("bucket").applyInArrow(lambda t: _shared_anchors(t, shard_words), _BLOB), "shared_anchors")
    strings = slim.groupBy("_part").cogroup(shared.groupBy("part")).applyInArrow(send_strings, _BLOB)
    judged = keep(strings.groupBy("bucket").applyInArrow(lambda t: _judged(t, window, shard_words), _BLOB), "judged")
    both = shared.withColumn("answer", F.lit(False)).unionByName(judged.withColumn("answer", F.lit(True)))
    return parts.groupBy("_part").cogroup(both.groupBy("part")).applyInArrow(cut, schema)


def _kept_texts(part: _Part, gone: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    return joined_words(part.flat[~gone], np.r_[0, np.cumsum(~gone)][part.offsets], part.words).to_pylist()


def _removed(part: _Part, gone: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(gone)][part.offsets])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
            shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; a null text has no words.

    Ids are compared as longs; a null id comes after all others, and rows with
    one id never cut each other.  Repeated rows come out repeatedly.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_sha256", StringType())])

    def finish(part: _Part, gone: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": part.table.column("c0"), "n_words": pa.array(part.n), "n_removed": pa.array(_removed(part, gone)),
                         "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _kept_texts(part, gone)], pa.string())})

    return _cut(docs.select(id_col, text_col), finish, schema, id_col, text_col, window, part_bytes, shard_words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs``, all columns and rows, without the words of repeated windows.

    A text that loses words is its other words joined by one space (empty if none
    is left); any other text stays as it is, null texts included.  Ids as in
    ``digests``.
    """
    names = docs.columns
    others = [c for c in names if c != text_col]
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema])

    def finish(part: _Part, gone: np.ndarray) -> pa.Table:
        cut = [x.decode("utf-8", "replace") if n else t for x, n, t in zip(_kept_texts(part, gone), _removed(part, gone).tolist(), part.table.column("_text").to_pylist())]
        return pa.Table.from_arrays([pa.array(cut, pa.string()) if c == text_col else part.table.column(f"c{others.index(c)}") for c in names], names=names)

    return _cut(docs, finish, schema, id_col, text_col, window, part_bytes, shard_words)
