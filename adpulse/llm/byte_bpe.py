"""Byte-level BPE encoding and decoding by monoid tree reduction.

Token lists form a monoid whose product encodes the concatenated bytes.  A piece
(a match of the splitting pattern) is encoded by encoding its halves
recursively and joining them.  To join, a window of tokens around the boundary
is re-encoded, and grown until nothing outside it can change.

Why the window may stop: merges with the lowest rank go first, wherever they
are, so a list of tokens is the encoding of its bytes if and only if each two
neighbours are the encoding of theirs -- the first merge across a boundary in
the whole would also be made with those two alone.  Inside the window, and
inside both sides, neighbours are right by construction.  It remains to look at
the two edges of the window: they are right if the edge token is still the one
that stood there, or if the new pair encodes to itself.

Pieces never merge with one another, so above them the product is plain
concatenation, for encoding and for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from adpulse.llm.arrowtext import utf8
from adpulse.llm.runtime import prepare

LEAF_BYTES = 4            # halves of this size are encoded directly
CACHE_ENTRIES = 200_000   # pieces, windows and leaves that a task remembers
LONG_TEXT = 1 << 20       # beyond this, matches are taken one by one
FOLD_TOKENS = 4096        # tokens at a leaf of the decoding tree

# Character classes as the tokenizer's pattern engine has them, over the range
# where letters and numbers are these; other texts take the full classes.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ſ]")


def _classes(pattern: str, letter: str, number: str, space: str) -> str:
    for inside, name, outside in ((letter, r"\p{L}", f"[{letter}]"), (number, r"\p{N}", f"[{number}]"), (space, r"\s", f"[{space}]")):
        pattern = re.sub(r"\[[^\]]*\]", lambda m, n=name, i=inside: m[0].replace(n, i), pattern)
        out, at = [], 0
        for m in re.finditer(r"\[[^\]]*\]", pattern):
            out += [pattern[at: m.start()].replace(name, outside), m[0]]
            at = m.end()
        pattern = "".join([*out, pattern[at:].replace(name, outside)])
    return pattern.replace(r"\S", f"[^{space}]")


class _Memo(dict):
    """Remembers results; forgets all when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = value
        return value


class Tokenizer:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.full = regex.compile(_classes(pattern, r"\p{L}", r"\p{N}", _SPACE))
        self.plain = re.compile(_classes(pattern, _LETTER, "0-9", _SPACE))
        self.leaf = _Memo(self.merged)
        self.window = _Memo(lambda ids: self.merged(b"".join([self.tokens[i] for i in ids])))
        self.piece = _Memo(self._packed_piece)

    # -- the base: merges of lowest rank first ------------------------------------

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a few bytes, by merging the leftmost pair of lowest rank."""
        if len(data) > 64:
            return self._merged_long(data)
        parts, ranks = [data[i: i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))   # of the part that begins here
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i: end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h: stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple([ranks[data[i: end[i]]] for i in range(n) if alive[i]])

    # -- the tree -----------------------------------------------------------------

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The product: the encoding of the bytes of both."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            new = self.window[left[-a:] + right[:b]]
            outer = left[-a - 1] if a < len(left) else None
            left_done = outer is None or new[0] == left[-a] or self.window[outer, new[0]] == (outer, new[0])
            outer = right[b] if b < len(right) else None
            right_done = outer is None or new[-1] == right[b - 1] or self.window[new[-1], outer] == (new[-1], outer)
            if left_done and right_done:
                return left[:-a] + new + right[b:]
            a = a if left_done else min(2 * a, len(left))
            b = b if right_done else min(2 * b, len(right))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self.leaf[data]
        half = (len(data) + 1) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def _packed_piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)          # a piece that is a token is that token
        ids = (whole,) if whole is not None else self.encode_bytes(data)
        return np.array(ids, "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        find = self.full if _PLAIN.search(text) else self.plain
        pieces = find.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in find.finditer(text))
        return b"".join(map(self.piece.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, concatenated up a tree."""
        if len(ids) <= FOLD_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """One for each worker process, with its memory of pieces."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return Tokenizer(table, pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text as an array; a null text has none.

    ``ranks`` is the content of a vocabulary file of fixed size (about 1 MB); it goes
    to the tasks with the function.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks, pattern)
        for b in batches:
            packed = [tok.encode_packed(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of every array of ids; a null array has none."""
    prepare(encoded.sparkSession)
    narrow = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks, pattern)
        for b in batches:
            data = [tok.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and the ids decoded, in one pass."""
    prepare(docs.sparkSession)
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks, pattern)
        for b in batches:
            flat, offsets = utf8(b.column(1))
            data, ends = flat.tobytes(), offsets.tolist()
            n, ids_sha, text_sha = [], [], []
            for s, e in zip(ends, ends[1:]):
                packed = tok.encode_packed(data[s:e].decode())
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(tok.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
