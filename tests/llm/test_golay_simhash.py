from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from adpulse.llm import golay_simhash as g
from adpulse.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(x, seed=42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(fps[i][0])
    return {fps[i][0]: min(groups[find(i)]) for i in range(len(fps))}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    error = g._ERROR[g._LOW[words & 0xFFF] ^ g._HIGH[words >> 12]]
    assert np.bitwise_count(error).max() == 3
    assert len(np.unique(g.codeword_index(words))) == 4096
    code = words ^ error
    assert len(np.unique(code)) == 4096


def test_keys_meet_for_every_pair_within_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    for x in a:
        y = x
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= np.uint64(1 << int(bit))
        key, row = g._keys(np.array([x, y], np.uint64))
        stored = {int(k) >> 1 for k, r in zip(key, row) if r == 0 and k & np.uint64(1) == 0}
        probing = {int(k) >> 1 for k, r in zip(key, row) if r == 1 and k & np.uint64(1) == 1}
        assert stored & probing


def test_fingerprint_equals_brute_force():
    for t in ["", None, "one", "Two Words", "a b c", "A b C d e f g a b c", "ü Ü x y", "x " * 500, "\n\t a\x0bb\x0cc  d"]:
        assert g.fingerprint((t or "").encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_components_equal_brute_force(spark, monkeypatch, group_rows):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 120)) for _ in range(12)]
    rows, i = [], 0
    for t in base:
        for _ in range(12):
            words = t.split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"n{rng.integers(1000)}"
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, base[0]), (i + 3, base[0]), (i + 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in g.components(df, group_rows=group_rows).collect()}
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_components(fps)
    assert got == {(d, f"{f:016x}", want[d]) for d, f in fps}
    kept = g.keep_one(df, group_rows=group_rows)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_dense_group_of_fingerprints(spark):
    """Many distinct fingerprints within a few bits of one another."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    fps = set()
    while len(fps) < 300:
        x = center
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    firsts = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for size in (4096, 7):
        rows = g._dealt(g._key_rows(firsts, True), firsts, size)
        edges = rows.repartition(F.shiftright("k", 1)).sortWithinPartitions("k").mapInArrow(g._links(3), "a long, b long")
        got = {r.node % 2**64: r.root % 2**64 for r in connected_components(edges).collect()}
        want = brute_components([(f, f) for f in fps])
        classes = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps})
        assert classes(got) == classes(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert g.components(df).collect() == []
    assert g.keep_one(df).collect() == []


def test_null_ids_and_other_columns(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 1), (4, "e f", None)], "doc_id long, text string, root int")
    assert sorted(g.components(df).collect(), key=str) == sorted(
        [(None, f"{brute_fingerprint('a b c d'):016x}", None)] * 2 + [(4, f"{brute_fingerprint('e f'):016x}", 4)], key=str)
    assert g.keep_one(df).count() == 2


def test_keep_one_of_a_table_with_clashing_names(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(5, " ".join(words), "a", 1, 2, "x"), (3, " ".join(words), "b", 3, 4, "y"), (4, "another text altogether", "c", 5, 6, "z"), (None, None, None, 7, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _h int, id int, Hash string")
    out = g.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[1:], key=str)
