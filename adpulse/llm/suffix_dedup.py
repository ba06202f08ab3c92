"""Removal of repeated byte strings by suffix arrays.

Each byte covered by a ``window``-byte string that also starts in a document
with a smaller id goes; strings are judged on the input, and never cross
documents.

Every window has an anchor: the smallest hash among its 16-byte strings.  Equal
windows have equal anchors, so a window can only repeat where its anchor does.

1. ``parts``: the documents are written once, in parts of a few MB, to a table
   bucketed by part.  The three passes over the texts read it where it lies;
   only what follows is shuffled.
2. Each part sends its distinct anchors (8 bytes each, packed by bucket) with the
   bytes of their distinct strings, and each bucket answers which of them occur
   in several documents, and which of these are hot: in more text than a shard
   holds.  There are as many buckets as keep each one's share of the parts bounded.
3. Runs of consecutive windows with one shared anchor go, as one string each, to
   that anchor's bucket; a part sends equal strings once, with its smallest id.
   A hot anchor's windows are dealt over all buckets, each by its own hash.
4. A bucket cuts its distinct strings into shards of bounded size, at anchors.
   Each shard gets a suffix array (Larsson-Sadakane refinement: groups of equal
   prefixes are sorted by the ranks h further on, h doubling, and only groups not
   yet told apart go on) and the common prefixes of neighbours (Kasai).
   Neighbours with ``window`` equal bytes are one class, whose smallest id counts.
   Where an anchor has more strings than a shard holds, its shards are merged:
   binary search finds each shard's classes among those of the others.
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

from adpulse.llm.arrowtext import utf8
from adpulse.llm.parts import pack, unpack, write_parts
from adpulse.llm.runtime import keep, prepare

WINDOW = 50
ANCHOR = 16                    # bytes that an anchor hashes
PART_BYTES = 4 << 20           # text of a part (one document at least)
SHARD_BYTES = 1 << 20    # text of a suffix array; positions and ranks have 21 bits
MAX_RUN = 4096                 # windows in one string; longer runs (periodic text) are cut
HOT_PARTS = 4096               # an anchor in more parts than this, or with more text than a shard holds, is dealt out by window
BUCKET_PARTS = 4               # parts' worth of anchors and strings that a bucket holds, about
_BLOCK = 1 << 20               # positions that a pass looks at together
_LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
_MASK = (1 << 21) - 1


# --- anchors and runs of windows ---------------------------------------------

def _runs_of(data: np.ndarray, ok: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor) of the runs among the windows that begin where ``ok``."""
    n = len(ok)
    padded = np.zeros(n + window + 16, np.uint8)
    padded[: min(len(data), len(padded))] = data[: len(padded)]
    word = np.ndarray((n + window + 8,), "<u8", padded.tobytes(), strides=(1,))
    h = word[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    span, done = window - ANCHOR + 1, 1          # smallest of `span` hashes, by doubling
    while done < span:
        step = min(done, span - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    h = h[:n] & ~np.uint64(1)
    before = np.ones(n, bool)
    before[1:] = ~ok[:-1] | (h[1:] != h[:-1])
    after = np.ones(n, bool)
    after[:-1] = before[1:] | ~ok[1:]
    start, end = np.flatnonzero(ok & before), np.flatnonzero(ok & after) + 1
    return start, end, h[start]


def runs(flat: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor): runs of windows [start, end) with one anchor, in rows laid end to end."""
    found = []
    length = np.diff(offsets)
    ok = np.ones(len(flat), bool)
    for e, n in zip(offsets[1:].tolist(), length.tolist()):
        ok[e - min(n, window - 1): e] = False
    for at in range(0, len(flat), _BLOCK):
        s, e, v = _runs_of(flat[at: at + _BLOCK + window + 16], ok[at: at + _BLOCK], window)
        found.append((s + at, e + at, v))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, end, value = (np.concatenate(x) for x in zip(*found))
    pieces = -(-(end - start) // MAX_RUN)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(start, pieces) + nth * MAX_RUN
        end, value = np.minimum(np.repeat(end, pieces), first + MAX_RUN), np.repeat(value, pieces)
        start = first
    return start, end, value


class _Part:
    """A part's documents laid end to end by id, and their runs."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("_id")
        ids = np.asarray(ids.fill_null(_LAST).to_numpy(), np.int64) if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((table.column("_row").to_numpy(), ids))
        self.table, self.ids, self.window = table.take(pa.array(order)), ids[order], window
        self.flat, self.offsets = utf8(self.table.column("_text"))
        self.start, self.end, self.value = runs(self.flat, self.offsets, window)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, in order, and the bytes of each one's distinct strings.

        The lowest bit of an anchor tells that several ids have it.
        """
        order = np.lexsort((self.ids[self.doc], self.value))
        v, d = self.value[order], self.ids[self.doc][order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return v, np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        start, end = self.start[order], self.end[order] + self.window - 1
        size, data = end - start, self.flat.tobytes()
        number = np.diff(np.r_[at, len(v)])
        seen: set[tuple[int, int]] = set()
        for i in np.flatnonzero(np.repeat(number, number) > 1).tolist():     # equal strings count once
            key = (int(v[i]), xxhash.xxh64_intdigest(data[start[i]: end[i]]))
            if key in seen:
                size[i] = 0
            seen.add(key)
        return v[at] | several.astype(np.uint64), np.add.reduceat(size, at)

    def strings(self, shared: np.ndarray) -> None:
        """Finds the distinct strings of the runs whose anchor is shared.

        ``shared``: anchors in order, the lowest bit set for hot ones; a hot
        anchor's windows are strings of their own, dealt out by their hash.
        """
        data, w = self.flat.tobytes(), self.window
        at = np.searchsorted(shared, self.value)
        at[at == len(shared)] = 0
        hit = (shared[at] & ~np.uint64(1) == self.value) if len(shared) else np.zeros(len(at), bool)
        hot = hit & (shared[at] & np.uint64(1) == 1) if len(shared) else hit
        start, end, doc, value = self.start[hit], self.end[hit], self.doc[hit], self.value[hit]
        if hot.any():
            n = np.where(hot[hit], end - start, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.repeat(hot[hit], n)
            start, doc, value, end = np.repeat(start, n) + nth, np.repeat(doc, n), np.repeat(value, n), np.repeat(end, n)
            end = np.where(one, start + 1, end)
            for i in np.flatnonzero(one):
                value[i] = xxhash.xxh64_intdigest(data[start[i]: start[i] + w]) & ~1
        index: dict[bytes, int] = {}
        self.which = np.fromiter((index.setdefault(data[s: e + w - 1], len(index)) for s, e in zip(start.tolist(), end.tolist())), np.int64, len(start))
        self.string = list(index)
        first = np.unique(self.which, return_index=True)[1]      # rows lie by id: the first has the smallest
        self.least, self.route = self.ids[doc[first]], value[first]
        self.start_, self.end_, self.doc_ = start, end, doc


def _bucketed(value: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions in the order given) for the values of each bucket."""
    bucket = ((value >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    return [(int(bucket[p[0]]), p) for p in np.split(order, cut[1:]) if len(p)]


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"part": pa.int64(), "bucket": pa.int64(), "blob": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)})


def _shared(lists: list[np.ndarray], sizes: list[np.ndarray], hot_parts: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors of all parts, which several documents have, the anchors with the lowest bit set for hot ones)."""
    every = np.concatenate([x & ~np.uint64(1) for x in lists])
    once, of, parts_of = np.unique(every, return_inverse=True, return_counts=True)
    several = np.unique(np.concatenate([x[x & np.uint64(1) == 1] for x in lists])) & ~np.uint64(1)
    common = parts_of > 1
    common[np.searchsorted(once, several)] = True
    size = np.bincount(of, np.concatenate(sizes), len(once))
    return once, common, once | ((parts_of > hot_parts) | (size > shard_bytes)).astype(np.uint64)


# --- suffix arrays -------------------------------------------------------------

def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` ordered by their first ``depth`` bytes (at least).

    Larsson-Sadakane: a rank is the first place of its group; the groups of
    several are sorted by the rank h places on, and h doubles.
    """
    n = len(text)
    if n > _MASK:
        raise ValueError("a shard has at most 2**21 - 1 bytes")
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    prefix = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64) >> np.uint64(24)
    key = np.sort(prefix << np.uint64(21) | np.arange(n, dtype=np.uint64))
    sa = (key & np.uint64(_MASK)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (key[1:] >> np.uint64(21)) != (key[:-1] >> np.uint64(21))
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1     # 0: beyond the end
    h = 5
    while h < depth:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slot = np.flatnonzero(~alone)
        if not len(slot):
            break
        pos = sa[slot]
        key = np.sort((rank[pos] << 42 | rank[np.minimum(pos + h, n)] << 21 | pos).astype(np.uint64))
        pos = (key & np.uint64(_MASK)).astype(np.int64)
        sa[slot] = pos
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (key[1:] >> np.uint64(21)) != (key[:-1] >> np.uint64(21))
        new[slot] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, slot, 0)) + 1
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """For each place in ``sa``, the bytes its suffix shares with the one before, ``cap`` at most.

    Kasai's rule: from one text position to the next the shared length falls by
    one at most, as long as the neighbour carried along still stands before its
    suffix.  Suffixes that are equal beyond the array's depth stand in any order,
    so it may not; the length then starts from zero.  Many stretches of the text
    are walked side by side, and eight bytes are compared at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = np.ndarray((n + cap + 16,), "<u8", np.concatenate((text, np.zeros(cap + 24, np.uint8))).tobytes(), strides=(1,))
    place = np.full(n + 1, n, np.int32)              # in the array; the end of the text bounds nothing
    place[sa] = np.arange(n, dtype=np.int32)
    stride = -(-n // lanes)
    lanes = -(-n // stride)

    def steps(values: np.ndarray, fill: int) -> np.ndarray:
        """What the stretches need at each step, side by side."""
        return np.r_[values, np.full(lanes * stride - n, fill, np.int32)].reshape(lanes, stride).T.copy()

    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    before, own = steps(before, -1), steps(place[:n], 0)
    shared = np.zeros((stride, lanes), np.int32)
    at = np.arange(lanes) * stride
    length, p = np.zeros(lanes, np.int64), np.full(lanes, n - 1, np.int64)
    for step in range(stride):
        length = np.where(place[p + 1] < own[step], np.maximum(length - 1, 0), 0)
        p = before[step].astype(np.int64)
        length[p < 0] = 0
        todo = np.flatnonzero(p >= 0)
        i, j = at[todo] + step, p[todo]
        while len(todo):
            known = length[todo]
            x = word[i + known] ^ word[j + known]
            same = x == 0
            known += np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            length[todo] = known
            same &= known < cap
            todo, i, j = todo[same], i[same], j[same]
        length = np.minimum(length, cap)
        shared[step] = length
    return shared.T.reshape(-1)[:n].astype(np.int64)[sa]


class _Shard:
    """Distinct strings with a suffix array; the smallest id of each window's class."""

    def __init__(self, strings: list[bytes], least: np.ndarray, window: int):
        self.window = window
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        end = np.cumsum(size)
        self.n_windows = size - (window - 1)
        nth = np.arange(self.n_windows.sum()) - np.repeat(np.cumsum(self.n_windows) - self.n_windows, self.n_windows)
        self.place = np.repeat(end - size, self.n_windows) + nth          # of each window, string by string
        id_ = np.full(len(self.text), np.iinfo(least.dtype).max, least.dtype)
        id_[self.place] = np.repeat(least, self.n_windows)
        real = np.zeros(len(self.text), bool)
        real[self.place] = True
        sa = suffix_array(self.text, window)
        self.first = np.flatnonzero(common_prefixes(self.text, sa, window) < window)
        self.least = np.minimum.reduceat(id_[sa], self.first)             # by class
        size = np.diff(np.r_[self.first, len(sa)])
        self.of = np.empty(len(sa), np.int64)
        self.of[sa] = np.repeat(np.arange(len(self.first)), size)
        # Of each class that holds a window, one place to read it, in byte order.
        member = np.flatnonzero(real[sa])
        cls = self.of[sa[member]]
        self.classes, at = np.unique(cls, return_index=True)
        self.spot = sa[member][at]

    def windows(self) -> np.ndarray:
        fixed = np.ndarray((len(self.text) - self.window + 1,), f"S{self.window}", self.text.tobytes(), strides=(1,))
        return fixed[self.spot]

    def result(self) -> np.ndarray:
        """The smallest id of each window, string by string."""
        return self.least[self.of[self.place]]


def _merge(shards: list[_Shard]) -> None:
    """Gives equal classes of different shards the smallest id of all, by binary search."""
    own = [s.least.copy() for s in shards]
    for a in range(len(shards)):
        here = shards[a].windows()
        for b in range(a + 1, len(shards)):
            there = shards[b].windows()
            at = np.minimum(np.searchsorted(here, there), len(here) - 1)
            same = here[at] == there
            ca, cb = shards[a].classes[at[same]], shards[b].classes[same]
            shards[a].least[ca] = np.minimum(shards[a].least[ca], own[b][cb])
            shards[b].least[cb] = np.minimum(shards[b].least[cb], own[a][ca])


def smallest_ids(strings: list[bytes], least: np.ndarray, route: np.ndarray, window: int, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(positions, smallest id of each of their windows) over all the distinct strings."""
    for at, found, n in _smallest(strings, least, route, window, shard_bytes):
        yield at, np.split(found, np.cumsum(n)[:-1])


def _smallest(strings: list[bytes], least: np.ndarray, route: np.ndarray, window: int, shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, smallest id of each of their windows end to end, windows of each) over all the distinct strings.

    Strings with equal routes stay together: in a shard, or in shards that are merged.
    """
    order = np.argsort(route, kind="stable")
    size = np.fromiter(map(len, strings), np.int64, len(strings))[order]
    same = route[order]
    group = np.flatnonzero(np.r_[True, same[1:] != same[:-1]]) if len(order) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(size)]
    ends = np.r_[group[1:], len(order)]
    i = 0
    while i < len(group):
        j = i + 1                                       # as many whole groups as a shard holds
        while j < len(group) and total[ends[j]] - total[group[i]] <= shard_bytes:
            j += 1
        lo, hi = int(group[i]), int(ends[j - 1])
        cuts = [lo]
        while cuts[-1] < hi:                            # one group may need several shards
            cuts.append(max(cuts[-1] + 1, min(hi, int(np.searchsorted(total, total[cuts[-1]] + shard_bytes, "right")) - 1)))
        shards = [_Shard([strings[x] for x in order[a:b]], least[order[a:b]], window) for a, b in zip(cuts, cuts[1:])]
        if len(shards) > 1:
            _merge(shards)
        for a, b, s in zip(cuts, cuts[1:], shards):
            yield order[a:b], s.result(), s.n_windows
        i = j


def _laid(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of ``n`` numbers each, end to end."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


# --- Spark jobs ------------------------------------------------------------------

def _cut(docs: DataFrame, finish, schema: StructType, id_col: str, text_col: str, window: int, part_bytes: int, shard_bytes: int, hot_parts: int) -> DataFrame:
    """``finish(part, removed)`` of each part, where ``removed`` tells which bytes go."""
    spark = prepare(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = write_parts(docs, id_col, text_col, part_bytes)
    buckets = max(partitions, -(-parts.select("_part").distinct().count() // BUCKET_PARTS))
    slim = parts.select("_part", "_row", "_id", "_text")
    blob_schema = "part long, bucket long, blob binary"
    out_schema = to_arrow_schema(schema)

    def anchors(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        value, size = _Part(table, window).anchors()
        size = np.minimum(size, np.iinfo(np.uint32).max).astype(np.uint32)
        return _table([(part, b, pack(value[p], size[p])) for b, p in _bucketed(value, buckets)], ("part", "bucket", "blob"))

    def share(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        blobs = [unpack(x) for x in table.column("blob").to_pylist()]
        lists = [np.frombuffer(x, np.uint64) for x, _ in blobs]
        once, common, marked = _shared(lists, [np.frombuffer(x, np.uint32) for _, x in blobs], hot_parts, shard_bytes)
        bucket = table.column("bucket")[0].as_py()
        out = []
        for p, x in zip(part, lists):
            at = np.searchsorted(once, x & ~np.uint64(1))
            if common[at].any():
                out.append((int(p), bucket, pack(marked[at][common[at]])))
        return _table(out, ("part", "bucket", "blob"))

    def shared_of(blobs: pa.Table) -> np.ndarray:
        lists = [np.frombuffer(unpack(x)[0], np.uint64) for x in blobs.column("blob").to_pylist()]
        return np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)

    def collect(table: pa.Table, blobs: pa.Table) -> pa.Table:
        if not table.num_rows or not blobs.num_rows:
            return _table([], ("part", "bucket", "blob"))
        part = _Part(table, window)
        part.strings(shared_of(blobs))
        size = np.fromiter(map(len, part.string), np.int64, len(part.string))
        out = []
        for b, p in _bucketed(part.route, buckets):
            body = b"".join([part.string[i] for i in p.tolist()])
            out.append((table.column("_part")[0].as_py(), b, pack(size[p].astype(np.uint32), part.least[p], part.route[p], body)))
        return _table(out, ("part", "bucket", "blob"))

    def judge(table: pa.Table) -> pa.Table:
        """For each part's strings, which windows some document with a smaller id has."""
        index: dict[bytes, int] = {}
        which, least, route, count = [], [], [], []
        for x in table.column("blob").to_pylist():
            size, low, value, body = unpack(x)
            end = np.cumsum(np.frombuffer(size, np.uint32), dtype=np.int64)
            begin = (end - np.frombuffer(size, np.uint32)).tolist()
            which.append(np.fromiter((index.setdefault(body[s:e], len(index)) for s, e in zip(begin, end.tolist())), np.int64, len(end)))
            least.append(np.frombuffer(low, np.int64))
            route.append(np.frombuffer(value, np.uint64))
            count.append(len(end))
        which, least, route = np.concatenate(which), np.concatenate(least), np.concatenate(route)
        strings = list(index)
        del index
        once, least = np.unique(least, return_inverse=True)        # ids by their ranks: half the room for each window
        least = least.astype(np.int32)
        low = np.full(len(strings), len(once), np.int32)
        np.minimum.at(low, which, least)
        way = np.zeros(len(strings), np.uint64)
        way[which] = route
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - (window - 1)
        first = np.cumsum(windows) - windows
        smallest = np.empty(windows.sum(), np.int32)
        for at, got, n in _smallest(strings, low, way, window, shard_bytes):
            smallest[_laid(first[at], n)] = got
        out, at = [], 0
        for part, n in zip(table.column("part").to_pylist(), count):
            bits = [np.zeros(0, bool)]
            for i in range(at, at + n, 1 << 14):
                of = which[i: min(i + (1 << 14), at + n)]
                bits.append(smallest[_laid(first[of], windows[of])] < np.repeat(least[i: i + len(of)], windows[of]))
            at += n
            out.append((part, table.column("bucket")[0].as_py(), pack(np.packbits(np.concatenate(bits)))))
        return _table(out, ("part", "bucket", "blob"))

    def cut(table: pa.Table, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(table, window)
        removed = np.zeros(len(part.flat), bool)
        if blobs.num_rows:
            part.strings(shared_of(blobs))
            answer = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
            n = np.fromiter(map(len, part.string), np.int64, len(part.string)) - (window - 1)
            first = np.cumsum(n) - n
            bits = np.zeros(n.sum(), bool)                            # of the windows, string by string
            for b, p in _bucketed(part.route, buckets):
                bits[_laid(first[p], n[p])] = np.unpackbits(np.frombuffer(unpack(answer[b])[0], np.uint8), count=int(n[p].sum())).astype(bool)
            later = part.ids[part.doc_] > part.least[part.which]      # this part has the string under a smaller id
            begins = np.zeros(len(part.flat) + 1, np.int64)
            np.add.at(begins, part.start_[later], 1)
            np.add.at(begins, part.end_[later], -1)
            starts = np.cumsum(begins[:-1]) > 0
            hit = np.r_[0, np.cumsum(bits)]
            some = np.flatnonzero(~later & (hit[first + n] > hit[first])[part.which])
            for i in range(0, len(some), _BLOCK // 16):
                of = some[i: i + _BLOCK // 16]
                k = n[part.which[of]]
                starts[_laid(part.start_[of], k)[bits[_laid(first[part.which[of]], k)]]] = True
            upto = np.cumsum(starts)
            removed = upto > 0
            removed[window:] = upto[window:] > upto[:-window]
        return finish(part, removed)

    found = slim.groupBy("_part").applyInArrow(anchors, blob_schema)
    shared = found.groupBy("bucket").applyInArrow(share, blob_schema)
    shared = keep(shared, "shared_anchors")
    strings = slim.groupBy("_part").cogroup(shared.groupBy("part")).applyInArrow(collect, blob_schema)
    judged = keep(strings.groupBy("bucket").applyInArrow(judge, blob_schema), "judged")
    both = shared.withColumn("answer", F.lit(False)).unionByName(judged.withColumn("answer", F.lit(True)))

    def last(table: pa.Table, blobs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=out_schema)
        answer = blobs.column("answer").to_numpy(zero_copy_only=False).astype(bool) if blobs.num_rows else np.zeros(0, bool)
        return cut(table, blobs.filter(pa.array(~answer)), blobs.filter(pa.array(answer)))

    return parts.groupBy("_part").cogroup(both.groupBy("part")).applyInArrow(last, schema)


def _spans(offsets: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed bytes, maximal runs of them) of each row."""
    gone = np.r_[0, np.cumsum(removed)]
    begin = removed.copy()
    begin[1:] &= ~removed[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(removed)]
    begin[inner] = removed[inner]
    if len(removed):
        begin[0] = removed[0]
    n = np.r_[0, np.cumsum(begin)]
    return np.diff(gone[offsets]), np.diff(n[offsets])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """``docs``, all columns and rows, with the repeated bytes cut out of the text.

    Ids are compared as longs; a null id comes after all others, rows with one
    id never cut each other.  Null texts stay null, short ones (under
    ``window`` bytes) whole, and a text that is cut wholly is empty.  Bytes are
    cut, so a character of which only some bytes repeat goes as a whole.
    """
    names = docs.columns
    others = [c for c in names if c != text_col]
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema])

    def finish(part: _Part, removed: np.ndarray) -> pa.Table:
        left = part.flat[~removed].tobytes()
        ends = np.r_[0, np.cumsum(~removed)][part.offsets].tolist()
        valid = part.table.column("_text").is_valid().to_pylist()
        text = [left[a:b].decode("utf-8", "ignore") if v else None for v, a, b in zip(valid, ends, ends[1:])]
        arrays = [pa.array(text, pa.string()) if c == text_col else part.table.column(f"c{others.index(c)}") for c in names]
        return pa.Table.from_arrays(arrays, names=names)

    return _cut(docs, finish, schema, id_col, text_col, window, part_bytes, shard_bytes, hot_parts)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; a null text counts as empty."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", id_type), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])

    def finish(part: _Part, removed: np.ndarray) -> pa.Table:
        left = part.flat[~removed].tobytes()
        ends = np.r_[0, np.cumsum(~removed)][part.offsets].tolist()
        gone, spans = _spans(part.offsets, removed)
        return pa.table({
            "doc_id": part.table.column("c0"), "n_bytes": pa.array(np.diff(part.offsets)), "n_removed": pa.array(gone), "n_spans": pa.array(spans),
            "kept_sha256": pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
        })

    return _cut(docs.select(id_col, text_col), finish, schema, id_col, text_col, window, part_bytes, shard_bytes, hot_parts)
