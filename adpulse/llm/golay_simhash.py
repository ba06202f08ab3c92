"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits.  It is cut into three segments, of 23, 23
and 18 bits (the last padded with zeros to 23).  The binary Golay code of
length 23 is perfect: each 23-bit word lies within 3 bits of exactly one
codeword.  Decoding a word and its 23 one-bit neighbours gives its set of
nearby codeword indices (one or six of them); the index of any word that
differs in at most one bit is among them.

Two fingerprints at 3 or fewer differing bits spread these over the three
segments in one of two ways (pigeonhole): one segment holds no error, and then
one of the other two holds at most one; or each holds exactly one.  So a
fingerprint is stored under seven keys -- for each ordered pair of segments
(i, j) the bits of i with the index of j, and the index of the first with that
of the second -- and probes the same seven key spaces with all its nearby
indices.  Every link is met under some key, and each meeting is verified by
counting the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import texts
from adpulse.llm.components import connected_components
from adpulse.llm.runtime import free_name, keep, prepare

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42

SEGMENTS = ((0, 23), (23, 23), (46, 18))   # (lowest bit, bits)
GENERATOR = 0b101011100011                 # of the binary Golay code, degree 11

# A stored key with more fingerprints than this is dealt over a grid of tasks,
# stored rows by one axis and probing rows by the other.
GROUP_ROWS = 4096

_BITS64 = np.uint64(64)


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for b in range(12):
        low[np.arange(1 << 12) >> b & 1 == 1] ^= unit[b]
    for b in range(11):
        high[np.arange(1 << 11) >> b & 1 == 1] ^= unit[12 + b]
    error = np.zeros(1 << 11, np.uint32)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return low, high, error


_LOW, _HIGH, _ERROR = _golay_tables()


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each 23-bit word."""
    word = word.astype(np.uint32, copy=False)
    return (word ^ _ERROR[_LOW[word & 0xFFF] ^ _HIGH[word >> 12]]) >> 11


def nearby_indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: the distinct indices of each word and its one-bit neighbours."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.uint32)
    all_ = np.sort(codeword_index(word.astype(np.uint32)[:, None] ^ flips), axis=1)
    new = np.ones(all_.shape, dtype=bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    row, col = np.nonzero(new)
    return row, all_[row, col]


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of a text; zero if it has no word.

    A-Z are lower-cased, shingles are repeated as often as they occur, and a
    text of fewer words than a shingle has is one shingle.
    """
    words = text.lower().split()       # bytes: ASCII letters and the six spaces only
    if not words:
        return 0
    if len(words) <= shingle_words:
        grams, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle_words + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(*id_cols, fp): the signed 64-bit fingerprint of each row; null text counts as empty."""
    prepare(docs.sparkSession)
    narrow = docs.select(*id_cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1]) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle_words) for t in texts(b.column(len(id_cols)))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*id_cols, "fp"])

    return narrow.mapInArrow(run, schema)


def _keys(fp: np.ndarray, probing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of fingerprints: seven stored keys each and, if asked for, all probing ones.

    The lowest bit is 0 for a stored row and 1 for a probing one, so that the
    stored rows of a key come first when sorted; 38 bits above it are the key.
    """
    seg = [(fp >> np.uint64(lo)) & np.uint64((1 << bits) - 1) for lo, bits in SEGMENTS]
    own = [codeword_index(s).astype(np.uint64) for s in seg]
    near = [nearby_indices(s) for s in seg] if probing else []
    rows = np.arange(len(fp))
    keys, owners = [], []

    def put(space: int, high: np.ndarray, index: np.ndarray, row: np.ndarray, probe: int) -> None:
        key = (np.uint64(space) << np.uint64(35)) | (high << np.uint64(12)) | index
        keys.append(key << np.uint64(1) | np.uint64(probe))
        owners.append(row)

    for space, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        put(space, seg[i], own[j], rows, 0)
        if probing:
            row, index = near[j]
            put(space, seg[i][row], index.astype(np.uint64), row, 1)
    put(6, own[0], own[1], rows, 0)
    if probing:
        (row0, index0), (row1, index1) = near[0], near[1]
        count = np.bincount(row1, minlength=len(fp))
        times, begin = count[row0], (np.cumsum(count) - count)[row0]
        pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - begin, times)
        put(6, np.repeat(index0, times).astype(np.uint64), index1[pos].astype(np.uint64), np.repeat(row0, times), 1)
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(firsts: DataFrame, probing: bool) -> DataFrame:
    """(k, fp): the keys of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = np.ascontiguousarray(fp[i: i + 4096])
                key, row = _keys(part.view(np.uint64), probing)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row])], names=["k", "fp"])

    return firsts.select("fp").mapInArrow(run, "k long, fp long")


class _Group:
    """The stored fingerprints of one key and the trees that links join them to."""

    def __init__(self, stored: np.ndarray, max_bits: int):
        self.stored, self.max_bits = np.unique(stored), max_bits
        self.tree = np.arange(len(self.stored))

    def meet(self, probing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges that join whatever the links of these rows with the stored ones join.

        One edge for each row that has a link, and one for each merge of trees:
        never all the links within a group.
        """
        probing, none = np.unique(probing), len(self.stored)
        for i in range(0, len(probing), 512):
            part = probing[i: i + 512]
            close = np.bitwise_count((part[:, None] ^ self.stored).view(np.uint64)) <= self.max_bits
            hit = close.any(axis=1)
            part, close = part[hit], close[hit]
            if not len(part):
                continue
            yield part, self.stored[close.argmax(axis=1)]
            while True:
                lowest = np.where(close, self.tree, none).min(axis=1)
                to = np.minimum(self.tree, np.where(close, lowest[:, None], none).min(axis=0))
                moved = np.flatnonzero(to < self.tree)
                if not len(moved):
                    break
                order = np.lexsort((to[moved], self.tree[moved]))
                old, at = np.unique(self.tree[moved][order], return_index=True)
                new = to[moved][order][at]
                yield self.stored[old], self.stored[new]
                root = np.arange(none)
                root[old] = new
                while (root[root] != root).any():
                    root = root[root]
                self.tree = root[self.tree]


def _links(max_bits: int):
    """From rows sorted by k: edges that connect what the links within each key connect."""

    def edges(parts: list) -> pa.RecordBatch:
        a, b = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, waiting, group = None, [], None      # of the key that a batch ends in
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            key, probe = k >> 1, (k & 1).astype(bool)
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.r_[begin[1:], len(k)]
            n_stored = np.add.reduceat(~probe, begin, dtype=np.int64)
            out: list = []
            busy = np.flatnonzero((np.minimum.reduceat(fp, begin) != np.maximum.reduceat(fp, begin)) & (n_stored > 0))
            busy = busy[(busy > 0) & (busy < len(begin) - 1)]
            single = busy[n_stored[busy] == 1]         # one stored row: all its probing rows at once
            if len(single):
                size = end[single] - begin[single]
                at = np.repeat(begin[single] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                one = np.repeat(fp[begin[single]], size)
                ok = np.bitwise_count((fp[at] ^ one).view(np.uint64)) <= max_bits
                out.append((fp[at][ok], one[ok]))
            for r in busy[n_stored[busy] > 1]:
                cut = begin[r] + n_stored[r]
                out.extend(_Group(fp[begin[r]: cut], max_bits).meet(fp[begin[r]: end[r]]))
            for r in dict.fromkeys((0, len(begin) - 1)):   # these may go on in other batches
                if key[begin[r]] != open_key:
                    open_key, waiting, group = key[begin[r]], [], None
                cut = begin[r] + n_stored[r]
                waiting.append(fp[begin[r]: cut])
                if cut < end[r]:
                    group = group or _Group(np.concatenate(waiting), max_bits)
                    if len(group.stored):
                        out.extend(group.meet(fp[cut: end[r]]))
            if out:
                yield edges(out)

    return run


def _dealt(rows: DataFrame, firsts: DataFrame, group_rows: int) -> DataFrame:
    """Rows with the keys that hold very many stored rows spread over a grid of cells.

    The cell goes above the key's bits.  Each stored row of such a key lies in
    one line of the grid and each probing row in one column, so each pair meets
    in exactly one cell.
    """
    g = F.shiftright("k", 1)
    hot = keep(_key_rows(firsts, False).groupBy(g.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
               .select("g", F.ceil(F.col("n") / group_rows).cast("long").alias("side")), "hot")
    if hot.isEmpty():
        return rows
    side = F.coalesce("side", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), side)
    other = F.explode(F.sequence(F.lit(0), side - 1))
    cell = F.when(F.col("k") % 2 == 0, F.col("own") * F.col("side") + F.col("other")).otherwise(F.col("other") * F.col("side") + F.col("own"))
    return (rows.withColumn("g", g).join(hot, "g", "left")
            .select("k", "fp", own.alias("own"), side.alias("side"), other.alias("other"))
            .select((F.col("k") + F.shiftleft(cell, 40)).alias("k"), "fp"))


def near_duplicates(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(*id_cols, fp, root): each row's fingerprint and the fingerprint that names its component.

    Equal fingerprints are one node.  Texts without a word have fingerprint
    zero and are linked like any other; null texts count as empty.  Repeated
    rows come out repeatedly.  Only ids and fingerprints are shuffled.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the key scheme finds links of {MAX_BITS} bits at most")
    rows = keep(fingerprints(docs, id_cols, text_col, shingle_words), "fingerprints")
    firsts = keep(rows.select("fp").distinct(), "distinct_fingerprints")
    keyed = _dealt(_key_rows(firsts, True), firsts, group_rows)
    edges = keyed.repartition(F.shiftright("k", 1)).sortWithinPartitions("k").mapInArrow(_links(max_bits), "a long, b long")
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    return rows.join(roots, "fp", "left").select(*id_cols, "fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``component_id`` is the smallest id in the component (null if all its ids
    are null), ``fingerprint`` 16 lower-case hex digits.
    """
    rows = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text")), **options)
    rows = keep(rows, "rows")
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    smallest = keep(smallest, "smallest")              # a bare scan: a hot root's rows can be split in the join
    return rows.join(smallest, "root").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component.

    It is the row with the smallest id (a null id comes last), and of rows with
    that id the one with the smallest text hash; repeated rows count once.
    """
    prepare(docs.sparkSession)
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("_text"))
    rows = near_duplicates(hashed, ("doc_id", "_hash"), "_text", **options)
    id_, hash_ = free_name(docs, "id"), free_name(docs, "hash")          # the table may have columns of any name
    chosen = keep(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")).alias("m"))
                  .select(F.col("m.doc_id").alias(id_), F.col("m._hash").alias(hash_)), "chosen")
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    left = docs.join(chosen, docs[id_col].eqNullSafe(F.col(id_)) & (own == F.col(hash_)), "left_semi")
    again = rows.groupBy("doc_id", "_hash").count().where("count > 1").isEmpty()
    return left if again else left.dropDuplicates([id_col, text_col])
