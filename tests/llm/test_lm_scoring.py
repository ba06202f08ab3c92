from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from adpulse.llm import lm_scoring as lm


def reference(texts_: list[str | None], target: list[str | None], prior: float = lm.PRIOR) -> list[tuple[int, float, float]]:
    """The same scores in plain Python."""
    split = lambda t: (t or "").lower().encode().split()
    v = len({w for t in [*texts_, *target] for w in split(t)})

    def model(corpus):
        pair, before, word = Counter(), Counter(), Counter()
        for t in corpus:
            for a, b in zip([b"", *split(t)], split(t)):
                pair[a, b] += 1
                before[a] += 1
                word[b] += 1
        total = sum(word.values())
        return lambda a, b: -np.log2((pair[a, b] + prior * (word[b] + 1) / (total + v)) / (before[a] + prior))

    models = model(target), model(texts_)
    out = []
    for t in texts_:
        c = list(zip([b"", *split(t)], split(t)))
        out.append((len(c), *((sum(m(*x) for x in c) / len(c)) if c else 0.0 for m in models)))
    return out


def check(got: list, docs: list[str | None], target: list[str | None]) -> None:
    got = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    for i, (n, t, g) in enumerate(reference(docs, target)):
        assert got[i].n_tokens == n
        assert [got[i].target_loss, got[i].background_loss, got[i].score] == pytest.approx([t, g, t - g])


def test_scores_equal_plain_python(spark):
    rng = np.random.default_rng(0)
    make = lambda n: " ".join(rng.choice(["The", "of", "a", "über", "x", "y", "zz", "q"], n))
    docs = [make(rng.integers(0, 40)) for _ in range(30)] + [None, "", " \n", "unseen words only", "The\x0bof\x0ca", make(5000), "same same", "same same"]
    target = [make(20) for _ in range(6)] + ["über über extra", None, ""]
    # Columns with the names that the operator uses itself.
    df = spark.createDataFrame([(i, t, "w", None, 1) for i, t in enumerate(docs)], "doc_id long, text string, score string, key string, part int").repartition(3)
    tgt = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for part_bytes in (50, lm.PART_BYTES):
        check(lm.score(df, tgt, part_bytes=part_bytes).collect(), docs, target)


def test_a_pair_in_every_document(spark):
    docs = ["of the"] * 300 + [f"of the w{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(7)
    tgt = spark.createDataFrame([(0, "of the"), (1, "w1 w2")], "item_id long, text string")
    check(lm.score(df, tgt, part_bytes=60).collect(), docs, ["of the", "w1 w2"])


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    assert lm.score(none, none).collect() == []
    assert lm.score(none, some).collect() == []
    check(lm.score(some, none).collect(), ["a b"], [])
    named = spark.createDataFrame([("x", "a b"), (None, "a b"), (None, "a b")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in lm.score(named, some).collect()) == [("", 2), ("", 2), ("x", 2)]
