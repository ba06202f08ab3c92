from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from adpulse.llm import suffix_dedup as s


def brute(rows, window=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            k = b[i:i + window]
            d_ = 1 << 70 if d is None else d
            first[k] = min(first.get(k, d_), d_)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < (1 << 70 if d is None else d):
                gone[i:i + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    def words(n):
        return " ".join(rng.choice(["der", "häus", "the", "of", "einer", "ndst", "ä", "x" * 9], n))

    shared = [words(40) for _ in range(5)]
    rows = []
    for d in range(60):
        t = words(rng.integers(0, 60))
        if d % 3 == 0:
            t += shared[rng.integers(5)][rng.integers(30):] + words(5)
        rows.append((int(d * 7 % 61), t))
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab" * 400), (104, "ab" * 300 + "c"), (104, "ab" * 300 + "c"),
             (105, rows[3][1]), (2, rows[9][1]), (None, rows[12][1]), (None, rows[12][1]), (106, "z" * 49), (107, "z" * 50), (108, "z" * 51)]
    return rows


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for text in [b"", b"a", b"banana" * 30, bytes(rng.integers(97, 99, 3000).astype(np.uint8)), b"\x00" * 70, b"ab" * 200]:
        t = np.frombuffer(text, np.uint8)
        sa = s.suffix_array(t, 50)
        assert sorted(sa) == list(range(len(text)))
        heads = [text[i:i + 50] for i in sa]
        if b"\x00" not in text:
            assert heads == sorted(heads)
        lcp = s.common_prefixes(t, sa, 50, lanes=16)
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1]:], text[sa[k]:]
            want = next((i for i in range(50) if a[i:i + 1] != b[i:i + 1] or not a[i:i + 1]), 50)
            assert min(lcp[k], 50) == want or b"\x00" in text


def test_common_prefixes_of_texts_with_repeats_longer_than_the_depth():
    """Ties beyond the array's depth stand in any order, beside neighbours that differ early."""
    rng = np.random.default_rng(11)
    for _ in range(20):
        pool = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(60, 400, 4)]
        text = b"".join(pool[i][rng.integers(0, 9):] + bytes(rng.integers(97, 100, 3).astype(np.uint8)) for i in rng.integers(0, 4, 30))
        t = np.frombuffer(text, np.uint8)
        sa = s.suffix_array(t, 50)
        got = s.common_prefixes(t, sa, 50, lanes=int(rng.integers(1, 40)))
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1]:][:50], text[sa[k]:][:50]
            assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("shard_bytes", [s.SHARD_BYTES, 400, 90])
def test_smallest_ids_over_shards(shard_bytes):
    rng = np.random.default_rng(2)
    pool = [bytes(rng.integers(97, 99, 8).astype(np.uint8)) for _ in range(3)]
    strings = list({b"".join(pool[i] for i in rng.integers(0, 3, rng.integers(7, 12))) for _ in range(80)})
    least = rng.integers(0, 1000, len(strings))
    first = {}
    for x, d in zip(strings, least):
        for i in range(len(x) - 49):
            first[x[i:i + 50]] = min(first.get(x[i:i + 50], 1 << 62), int(d))
    seen = 0
    for at, got in s.smallest_ids(strings, least, np.zeros(len(strings), np.uint64), 50, shard_bytes):
        for i, g in zip(at, got):
            assert g.tolist() == [first[strings[i][k:k + 50]] for k in range(len(strings[i]) - 49)]
            seen += 1
    assert seen == len(strings)


def test_runs_cover_each_window_once_and_agree():
    rng = np.random.default_rng(4)
    docs = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 51, 300, 9000)] + [b"q" * 9000]
    offsets = np.cumsum([0, *map(len, docs)])
    flat = np.frombuffer(b"".join(docs), np.uint8)
    start, end, value = s.runs(flat, offsets, 50)
    windows = [(i, v) for a, b, v in zip(start, end, value) for i in range(a, b)]
    want = [o + i for o, d in zip(offsets, docs) for i in range(len(d) - 49)]
    assert [i for i, _ in windows] == want
    data, by = flat.tobytes(), {}
    for i, v in windows:
        assert by.setdefault(data[i:i + 50], v) == v
    assert (end - start).max() <= s.MAX_RUN


def test_runs_across_block_borders(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (700, 30, 900, 1)]
    offsets, flat = np.cumsum([0, *map(len, docs)]), np.frombuffer(b"".join(docs), np.uint8)
    windows = lambda: [(i, v) for a, b, v in zip(*s.runs(flat, offsets, 50)) for i in range(a, b)]
    whole = windows()
    monkeypatch.setattr(s, "_BLOCK", 64)
    assert windows() == whole and len(whole) == 651 + 851


@pytest.mark.parametrize("options", [{}, {"part_bytes": 700, "shard_bytes": 120, "hot_parts": 2}])
def test_digests_equal_brute_force(spark, options):
    rows = corpus(np.random.default_rng(7))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _part string").repartition(3)
    got = [tuple(r) for r in s.digests(df, **options).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.fixture(scope="module")
def whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("partitions,options", [(1, {}), (2, {}), (3, {"shard_bytes": 16 << 10}), (4, {}), (5, {}), (6, {}), (7, {"part_bytes": 1 << 16}), (8, {})])
def test_whole_table_whatever_the_partitions(spark, whole, partitions, options):
    docs, want = whole
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(tuple(r) for r in s.digests(docs, **options).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_are_cut_and_columns_kept(spark):
    a, b = "prefix one " + "shared passage of more than fifty bytes, really so, " * 2, "and " + "shared passage of more than fifty bytes, really so, " * 2 + "tail"
    df = spark.createDataFrame([(2, b, 5, "k"), (1, a, 6, None), (3, None, None, "z"), (4, a, 7, "q")], "doc_id long, text string, _id long, c0 string")
    got = {r.doc_id: r for r in s.remove_repeats(df).collect()}
    assert s.remove_repeats(df).columns == df.columns
    assert got[1].text == a and got[3].text is None and got[4].text == "" and got[2].text == "andtail"
    assert (got[2]._id, got[2].c0, got[3].c0) == (5, "k", "z")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.digests(df).collect() == []


def part_of(rows):
    return s._Part(pa.table({"_part": [0] * len(rows), "_row": range(len(rows)), "_id": [r[0] for r in rows], "_text": [r[1] for r in rows]}), 50)


def test_an_anchor_with_more_text_than_a_shard_is_hot():
    """A line in every document, each time between other words: few parts, but many strings at its edges."""
    rng = np.random.default_rng(8)
    line = "this very line of boilerplate stands in each and every document of the corpus"
    noise = lambda: "".join(rng.choice(list("abcdefghijkl"), 60))
    parts = [part_of([(100 * p + d, noise() + line + noise()) for d in range(100)]) for p in range(2)]
    lists, sizes = zip(*(p.anchors() for p in parts))
    once, common, marked = s._shared(list(lists), list(sizes), s.HOT_PARTS, 4000)
    hot = once[marked & np.uint64(1) == 1]
    total = {}
    for p in parts:
        data = p.flat.tobytes()
        for v, x in {(v, data[a: b + 49]) for v, a, b in zip(p.value.tolist(), p.start.tolist(), p.end.tolist())}:
            total[v] = total.get(v, 0) + len(x)
    assert sorted(hot.tolist()) == sorted(v for v, n in total.items() if n > 4000) and len(hot)
    # What stays with its anchor fits one shard; a hot anchor's strings have many routes.
    shared = np.sort(marked[common])
    routes = {}
    for p in parts:
        p.strings(shared)
        for r, x in zip(p.route.tolist(), p.string):
            routes.setdefault(r, set()).add(x)
    assert max(sum(map(len, x)) for x in routes.values()) <= 4000


def test_copies_do_not_make_an_anchor_hot():
    part = part_of([(d, "the same text of more than fifty bytes in all of the documents") for d in range(500)])
    value, size = part.anchors()
    assert size.max() < 200 and (value & np.uint64(1) == 1).all()


def test_hot_by_text_equals_brute_force(spark):
    rows = corpus(np.random.default_rng(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in s.digests(df, part_bytes=3000, shard_bytes=300).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
