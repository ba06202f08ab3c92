from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from adpulse.llm import collocations as c

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_count=100, max_words=5, top=2000):
    n, f = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    inside = defaultdict(int)
    for (lang, p), a in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i:i + m]] = max(inside[lang, p[i:i + m]], a)
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * inside[lang, p] >= 100 * a:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "häus", "straße", "a", "café", "\x00x", "w-w", "#1", " ", "z" * 30]
    fixed = ["in the city of new york", "of the of the of", "one two three four five six"]
    rows = []
    for _ in range(400):
        t = ""
        for _ in range(rng.randrange(12)):
            t += rng.choice([*words, *fixed]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!?"])
        rows.append((rng.choice(["en", "de", "de", None, "Ω", ""]), t))
    rows += [("en", None), (None, ""), ("en", ".,;:!?\n"), ("xx", "hot line of words here. " * 500), ("en", "the of " * 3000)]
    rows += [("en", "a boilerplate line, with two pieces")] * 300
    return rows


@pytest.mark.parametrize("options", [{}, {"block_bytes": 900, "range_bytes": 700}, {"block_bytes": 300, "range_bytes": 200_000}, {"block_bytes": 1 << 20, "range_bytes": 150}])
def test_equal_to_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(lang, t, "p", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    want = brute(rows, 20)
    assert len(want) > 40 and len({r[0] for r in want}) > 3
    assert rows_of(c.collocations(df, min_count=20, **options)) == want
    assert rows_of(c.collocations(df, min_count=40, max_words=3, top=2, **options)) == brute(rows, 40, 3, 2)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert rows_of(c.collocations(df)) == []
    assert rows_of(c.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string"))) == []


def test_ranges_meet_at_bounds_within_a_phrase():
    """Runs cut by a bound are open on both sides and add up."""
    whole = c.Rows.of_texts([b"a b c, a b d, a b e. a c. b"], 5)
    n = whole.columns.shape[1]
    for cut in range(1, n):
        total = Counter()
        for a, b in ((0, cut), (cut, n)):
            for m, p, k, is_open in c.phrases(c.merged([whole.blob(a, b)], 5), 2):
                assert is_open or k >= 2
                total[p] += k
        assert {p: k for p, k in total.items() if k >= 2} == {b"a": 4, b"a b": 3, b"b": 4, b"c": 2}


def test_long_text_is_cut_between_pieces():
    import pyarrow as pa

    text = "one two three. " * 100
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    blocks = [b["en"] for b in c._blocks(iter([batch]), 64)]
    assert len(blocks) > 10 and b"".join(x for b in blocks for x in b) == text.encode()
    assert all(x.endswith(b".") for b in blocks[:-1] for x in b)


def test_products_beyond_64_bits(spark):
    """Only the arithmetic: a, n, l and r of a corpus of 10^13 words."""
    from pyspark.sql import functions as F

    a, n, left, right = 9 * 10**12, 10**13, 9 * 10**12 + 7, 9 * 10**12 + 1
    d = lambda v, p: F.lit(str(v)).cast(f"decimal({p},0)")
    row = spark.range(1).select((F.lit(1000).cast("decimal(4,0)") * (d(a, 15) * d(n, 16))).alias("product"), (d(left, 15) * d(right, 15)).alias("divisor"))
    assert row.select(F.expr("product div divisor").alias("s")).first().s == 1000 * a * n // (left * right)
