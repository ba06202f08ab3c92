"""Arrow text columns as flat numpy byte arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the word rule [^\x20\x09-\x0D]+ .
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

# Text bytes that numpy works on at a time; arrays of 8 bytes a position
# then stay in the tens of MB however large a batch is.
BLOCK_BYTES = 1 << 21


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each row's bytes; a null counts as empty."""
    flat, offsets = utf8(column)
    data = flat.tobytes()
    for i in range(len(offsets) - 1):
        yield data[offsets[i]: offsets[i + 1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``limit`` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word in rows laid out one after the other."""
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)   # a row begins here
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number, the rows' offsets among the words, and the distinct words (binary) in the order of their numbers."""
    flat, offsets = utf8(column)
    rows = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(flat))
    lists = pc.ascii_split_whitespace(rows)
    word, ends = lists.flatten().cast(pa.large_binary()), np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64).cumsum()
    some = pc.binary_length(word).to_numpy(zero_copy_only=False) > 0     # white space at the ends of a row gives empty words
    if not some.all():
        word, ends = word.filter(pa.array(some)), np.r_[0, np.cumsum(some)][ends]
    coded = word.dictionary_encode()
    return coded.indices.to_numpy(), np.r_[0, ends].astype(np.int64), coded.dictionary


def joined_words(number: np.ndarray, offsets: np.ndarray, words: pa.Array) -> pa.Array:
    """Rows of words, given by their numbers, each row's joined by one space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(number))), pa.scalar(b" ", words.type))


def joined(words: pa.Array) -> bytes:
    """All words, joined by one space."""
    return joined_words(np.arange(len(words)), np.array([0, len(words)]), words)[0].as_py()


def word_list(words: pa.Array) -> list[bytes]:
    """Words (none is empty or holds white space) one by one; many times as fast as ``to_pylist``."""
    return joined(words).split()


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns at its end (names may repeat)."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
