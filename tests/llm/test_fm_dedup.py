from __future__ import annotations

import hashlib
import heapq
import sys

import numpy as np
import pytest

from adpulse.llm import arrowtext as a
from adpulse.llm import fm_dedup as d
from adpulse.llm import fm_index as f


def brute(rows, window=13):
    first = {}
    key = lambda i: 1 << 70 if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < key(i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    def words(n):
        return " ".join(rng.choice(["der", "häus", "the", "of", "einer", "ndst", "ä", "x" * 9, "\x00", "a.b"], n))

    shared = [words(30) for _ in range(6)]
    rows = []
    for i in range(80):
        t = words(rng.integers(0, 40)) + rng.choice([" ", "\n", " \t "])
        for _ in range(rng.integers(0, 3)):
            t += shared[rng.integers(6)][rng.integers(40):] + " " + words(rng.integers(0, 6)) + "\x0b"
        rows.append((int(i * 7 % 83), t))
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab " * 900), (104, "ab " * 600 + "c"), (104, "ab " * 600 + "c"), (105, rows[3][1]), (2, rows[9][1]),
             (None, rows[12][1]), (None, rows[12][1]), (106, "z " * 12), (107, "z " * 13), (108, "z " * 14), (109, " \t\n ")]
    rows += [(200 + i, "a line that stands in very many rows of the table and is always just the same " + words(4)) for i in range(60)]
    return rows


def test_code_lengths_are_huffman():
    rng = np.random.default_rng(0)
    for n in (2, 3, 10, 300):
        w = rng.integers(1, 1000, n)
        heap = w.tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        lengths = f.code_lengths(w)
        assert int((lengths * w).sum()) == cost and (0.5 ** lengths).sum() == 1


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (70, 3), (1000, 40), (5000, 700)):
        seq = np.r_[np.arange(size), np.minimum(rng.zipf(1.4, max(n - size, 0)), size) - 1]
        rng.shuffle(seq)
        tree = f.WaveletTree(seq, size)
        c, p = rng.integers(0, size, 200), rng.integers(0, len(seq) + 1, 200)
        ranks, stands = tree.rank(c, p)
        assert ranks.tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, p)]
        assert all(s == (seq[b] == a) for a, b, s in zip(c, p, stands) if b < len(seq))


def test_the_index_is_compressed():
    rng = np.random.default_rng(2)
    text = np.r_[np.minimum(rng.zipf(1.5, 100_000), 9000), 0]
    share = np.unique(text, return_counts=True)[1] / len(text)
    entropy = -(share * np.log2(share)).sum()
    assert f.FMIndex(text, 13).tree.n_bytes() * 8 < len(text) * (entropy + 1) * 1.6


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        size, limit = int(rng.integers(1, 8)), int(rng.integers(1, 7))
        strings = [rng.integers(1, size + 1, int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 8)))]
        text = np.concatenate([np.r_[s, 0] for s in strings])
        index = f.FMIndex(text, limit)
        patterns = [rng.integers(0 if trial % 3 == 0 else 1, size + 2, int(rng.integers(0, 25))) for _ in range(9)] + strings
        flat, offsets = np.concatenate(patterns), np.cumsum([0, *map(len, patterns)])
        length, place = index.matching_statistics(flat, offsets)
        for a, b in zip(offsets, offsets[1:]):
            for i in range(a, b):
                x = flat[i: min(b, i + limit)].tolist()
                want = next((k for k in range(len(x), 0, -1) if any(s[j:j + k].tolist() == x[:k] for s in strings for j in range(len(s) - k + 1))), 0)
                assert length[i] == want
                if want == limit:
                    at = index.order[place[i]]
                    assert text[at: at + want].tolist() == x


@pytest.mark.parametrize("shard_words", [d.SHARD_WORDS, 300, 20])
def test_smallest_ids_over_shards(shard_words):
    rng = np.random.default_rng(4)
    pool = [rng.integers(1, 4, 5) for _ in range(3)]
    strings = list({tuple(np.concatenate([pool[i] for i in rng.integers(0, 3, rng.integers(3, 8))]).tolist()) for _ in range(80)})
    route = np.array([hash(s[:5]) & 7 for s in strings], np.uint64)          # whole routes share a shard
    least = rng.integers(0, 1000, len(strings))
    got = d.smallest_ids([np.array(s, np.int32) for s in strings], least, route, 13, shard_words)
    for s, r, g in zip(strings, route, np.split(got, np.cumsum([len(s) - 12 for s in strings])[:-1])):
        pool_ = [(t, i) for t, q, i in zip(strings, route, least) if q == r]
        for k, x in enumerate(g):
            own = min(i for t, i in pool_ if any(t[j:j + 13] == s[k:k + 13] for j in range(len(t) - 12)))
            assert x <= own and (shard_words > 300 or x >= 0)
            if shard_words == 20:
                assert x == own


@pytest.mark.parametrize("options", [{}, {"part_bytes": 900, "shard_words": 60}, {"part_bytes": 2500, "shard_words": 1}])
def test_digests_equal_brute_force(spark, options):
    rows = corpus(np.random.default_rng(7))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _part string").repartition(4)
    got = [tuple(r) for r in d.digests(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)
    small = d.digests(df, window=3, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in small), key=str) == brute(rows, 3)


def test_blocks_and_cut_runs(spark, monkeypatch):
    """Texts across several blocks of a pass, and runs longer than a string may be."""
    import pyarrow as pa

    monkeypatch.setattr(d, "_BLOCK", 50)
    monkeypatch.setattr(d, "MAX_RUN", 7)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b"], 400)), "q " * 300, "a b c " * 5, "short"]
    table = pa.table({"_row": [0, 1, 2, 3], "_id": [5, 6, 7, 8], "_text": texts})
    cut = d._Part(table, 13)
    monkeypatch.undo()
    whole = d._Part(table, 13)
    windows = lambda p: [(i, v) for a, b, v in zip(p.start, p.end, p.value) for i in range(a, b)]
    assert windows(cut) == windows(whole) and len(windows(cut)) == 388 + 288 + 3 and (cut.end - cut.start).max() <= 7


def calls(work):
    """How many calls the interpreter makes."""
    made = 0

    def count(frame, event, arg):
        nonlocal made
        made += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return made


def test_no_step_goes_word_by_word():
    """Words are numbered, and codes found, by operations on whole arrays: the CPU budget leaves no call for each word."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30_000, 2_000)) for _ in range(20)]
    tables = [pa.table({"_row": range(20), "_id": range(i, 20 + i), "_text": texts}) for i in range(4)]
    parts = [d._Part(t, 13) for t in tables]
    n_words = sum(len(p.flat) for p in parts)
    assert n_words == 160_000 and calls(lambda: [d._Part(t, 13) for t in tables]) < n_words / 20
    for p in parts:
        p.strings(np.unique(p.value))
    blobs = [p.blob(np.arange(0, len(p.route), 40)) for p in parts]
    held = sum(len(d._read_blob(b)[0].split()) for b in blobs)
    table = d._rows([(i, 0, b) for i, b in enumerate(blobs)])
    assert held > 10_000 and calls(lambda: d._judged(table, 13, d.SHARD_WORDS)) < 1.5 * held
    assert calls(lambda: [d._kept_texts(p, np.zeros(len(p.flat), bool)) for p in parts]) < n_words / 20
    assert calls(lambda: f.code_lengths(rng.integers(1, 1000, 20_000))) < 2_000


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_blobs_share_numbers(monkeypatch, limit):
    monkeypatch.setattr(d, "_BLOB_BYTES", limit)
    words = [b"a \xff\xfe b", b"b \x1c\x00 a", b"\xc3\xa9 b"]
    none = np.zeros(0, np.int64)
    blobs = [d.pack(w, np.zeros((4, 1), np.uint8), none.astype(np.uint32), none, none.astype(np.uint64)) for w in words]
    assert [x[0].tolist() for x in d._renumbered(blobs)] == [[1, 2, 3], [3, 4, 1], [5, 3]]


def test_words_of_any_bytes():
    """White space is that of the rule, other control characters and bytes that are no UTF-8 belong to words; ends, empty texts and nulls."""
    import pyarrow as pa

    every = bytes(range(256))
    rows = [b"  a\xff b\x0b\x0ca\xff ", None, b"", b" \t\r\n", every, "\u00a0x\u2003y \u0085".encode(), b"b"]
    for column in (pa.array(rows, pa.binary()), pa.chunked_array([pa.array(rows[:3], pa.large_binary()), pa.array(rows[3:], pa.large_binary())]),
                   pa.array([b"cut off", *rows], pa.binary())[1:]):
        number, offsets, words = a.word_numbers(column)
        listed = a.word_list(words)
        want = [(r or b"").split() for r in rows]
        assert [[listed[n] for n in number[s:e]] for s, e in zip(offsets, offsets[1:])] == want and listed == words.to_pylist()
        assert listed == list(dict.fromkeys(w for r in want for w in r))
        assert a.joined_words(number, offsets, words).to_pylist() == [b" ".join(w) for w in want]
    for none in (pa.array([], pa.string()), pa.array([None, " "], pa.string())):
        number, offsets, words = a.word_numbers(none)
        assert not len(number) and offsets.tolist() == [0] * (len(none) + 1) and a.word_list(words) == []
        assert a.joined_words(number, offsets, words).to_pylist() == [b""] * len(none)


def test_texts_are_cut_and_columns_kept(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(2, "und  " + passage + " tail", 5, "k"), (1, "prefix\n" + passage, 6, None), (3, None, None, "z"), (4, passage, 7, "q"), (5, "a  b", 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, c0 string")
    out = d.remove_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {1: rows[1][:1] + ("prefix\n" + passage, 6, None), 2: (2, "und tail", 5, "k"), 3: (3, None, None, "z"), 4: (4, "", 7, "q"), 5: rows[4]}
    assert d.remove_repeats(df.limit(0)).collect() == [] and d.digests(df.limit(0)).collect() == []
