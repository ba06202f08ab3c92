from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from adpulse.llm import best_fit as bf


def brute(lengths, sources, clusters, capacity):
    """The tightest compatible bin by looking at all of them."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fit = [b for b in range(len(bins)) if 0 < bins[b][0] >= n and s not in bins[b][1] and c not in bins[b][2]]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0], b))
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        out.append((b, capacity - bins[b][0]))
        bins[b][0] -= n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return out


def test_pack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(0, 120))
        lengths = sorted(rng.integers(0, 101, n).tolist(), reverse=True)
        sources, clusters = rng.integers(0, 6, n).tolist(), rng.integers(0, 30, n).tolist()
        assert bf.pack(lengths, sources, clusters, 100) == brute(lengths, sources, clusters, 100)


def test_bins_of_a_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 70)) + [f"u{i}"]), None if i % 9 == 0 else f"s{i % 4 if i % 2 else 0}", 3) for i in range(150)]
    rows += [(200, " ".join(["long"] * 175), "s1", 3), (201, " ".join(["l"] * 100), "s1", 3), (202, None, "s2", 3), (203, "", "s2", 3), (5, rows[5][1], "s7", 3), (5, rows[5][1], "s7", 3), (None, "a b", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int").repartition(3)
    for group in (1000, 30):
        got = bf.pack_documents(df, capacity=50, group_docs=group).collect()
        assert got == [] or {f for f in got[0].asDict()} == {"doc_id", "piece", "bin_id", "bin_offset", "doc_offset", "n_tokens"}
        total = defaultdict(int)
        for r in got:
            total[r.doc_id] += r.n_tokens
        want = defaultdict(int)
        for i, t, _, _ in rows:
            want[i] += len((t or "").split())
        assert total == want
        bins = defaultdict(list)
        for r in got:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.doc_id))
        info = {i: (s, t) for i, t, s, _ in rows if i != 5}
        for items in bins.values():
            items.sort()
            ends = 0
            for offset, n, _ in items:
                assert offset == ends
                ends += n
            assert ends <= 50
            known = [info[d] for _, _, d in items if d in info]
            assert len({s for s, _ in known}) == len(known) and len({(t or "").lower() for _, t in known}) == len(known)
    assert bf.pack_documents(df.limit(0)).collect() == []


def test_near_copies_do_not_share_a_sequence(spark):
    rows = [(i, f"w{i} x", f"s{i}") for i in range(6)] + [(9, "w9 x", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (3, 2), (None, 7)], "doc_id long, cluster long")
    bins = {r.doc_id: r.bin_id for r in bf.pack_documents(df, capacity=50, clusters=near).collect()}
    assert len(bins) == 7 and len({bins[i] for i in (0, 1, 2)}) == 3


def test_equal_rows_are_spread_over_groups(spark):
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("s").alias("source")).repartition(6)
    got = bf.pack_documents(df, capacity=50, group_docs=500).collect()
    assert len(got) == 5000 and len({r.bin_id for r in got}) == 5000            # one source: a sequence for each row
    group = Counter(r.bin_id >> 32 for r in got)
    assert len(group) == 10 and max(group.values()) < 1200
