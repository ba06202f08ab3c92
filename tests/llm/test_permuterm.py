from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from adpulse.llm import permuterm as p


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=None, min_length=6, min_count=5, ratio=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [v for v in n if distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["letter", "better", "bettter", "aaaaaa", "aaaaaaa", "strasse", "straße", "größte", "grösste", "Señores", "recibido", "received"]
    rows = []
    for d in range(300):
        picked = []
        for _ in range(40):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            if rng.random() < .25:
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abeÉß") + w[i:], w[:i] + rng.choice("atÄ") + w[i + 1:]])
            picked.append(w)
        rows.append((d % 290, rng.choice([" ", ", ", "1", "·"]).join(picked)))
    rows += [(410, "chainaaa " * 5 + "chainaab " * 30 + "chainabb " * 200 + "chainbbb " * 1100)]      # forms of forms
    rows += [(None, "received " * 20), (None, None), (400, ""), (401, "receiveD" * 3000), (402, "x" * 3000 + " " + "x" * 3001), (402, "y" * 95 + " " + "y" * 96 + " " + "y" * 97), (403, "12 §§ ×÷ Ābcdefg")]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    for every in (None, 7):
        want = brute(rows, every)
        assert len(want) > 30 and (every or any(r[1] and r[2] != r[1] for r in want))
        assert rows_of(p.variants(df, corrupt_every=every)) == want
    assert rows_of(p.variants(df, min_length=3, min_count=1, ratio=2)) == brute(rows, None, 3, 1, 2)
    assert rows_of(p.variants(df.limit(0))) == [] and rows_of(p.variants(df.where("doc_id = 400"))) == []


def test_one_edit_apart_counts_once_at_repeated_letters(spark):
    rows = [(1, " ".join(w for w in ("hello" * 2, "helo" + "hello", "hello" + "helllo") for _ in range(9)))]
    got = {r.word: r for r in p.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["hellohello"].n_near == 2 and got["helohello"].n_near == 1 and got["hellohelllo"].n_near == 1
    assert all(r.form is None and r.root == r.word for r in got.values())


def test_groups_are_small_and_no_python_runs(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xE0, 0x100)]]
    rows = [(1, " ".join(f"abc{c}defg" for c in letters if c.isalpha() for _ in range(5)))]
    vocabulary = p.numbered(p.words(spark.createDataFrame(rows, "doc_id long, text string")))
    assert max(r["count"] for r in p.rotations(vocabulary).groupBy("prefix").count().collect()) <= 91
    plan = p.neighbours(vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
