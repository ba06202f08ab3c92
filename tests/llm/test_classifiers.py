from __future__ import annotations

import zlib

import numpy as np
import pytest

from adpulse.llm import mil_quality as mil
from adpulse.llm import nb_toxicity as nb

RNG = np.random.default_rng(0)
WORDS = ["haus", "the", "of", "einer", "ndst", "tion", "le", "mot", "ä", "für", "red", "blue"]


def make(bad, toxic):
    n = int(RNG.integers(20, 400))
    words = list(RNG.choice(WORDS, n))
    if bad:
        words = [w + "%%%" if RNG.random() < .5 else w.upper() + "!!" for w in words]
    if toxic:
        for _ in range(2):
            words[RNG.integers(n)] = RNG.choice(["stupid", "Moron"])
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, make(i % 4 == 0, i % 5 == 0), int(i % 4 != 0), int(i % 5 == 0)) for i in range(420)]
    docs = spark.createDataFrame([(i, t, i) for i, t, _, _ in rows] + [(None, None, 0), (900, "", 0), (900, "", 0), (901, "x" * 300000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (0, None, None), (900, 7, 7)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: (q, x) for i, _, q, x in rows}


@pytest.mark.parametrize("module, column, folds, held", [(mil, 0, 3, 1), (nb, 1, 5, 0)])
def test_held_out_accuracy_and_all_rows(labelled, module, column, folds, held):
    docs, labels, truth = labelled
    model = module.train(docs, labels)
    got = mil.predictions(module.score(docs, model), folds, held).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*truth, None, 900, 900, 901], key=str)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= .5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
    mine = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in mine]) > .97
    kept = (mil.accepted if module is mil else nb.clean)(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.predicted == (module is mil)), key=str)


def test_held_out_labels_are_never_read(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic")
    a, b = nb.train(docs, labels), nb.train(docs, turned)
    assert np.array_equal(a.codes, b.codes) and np.allclose(a.weights, b.weights)


@pytest.mark.parametrize("module", [mil, nb])
def test_without_labels_or_rows(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, module.train(docs, labels)).collect()} == {.5}
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).collect() == []


def test_passages_have_one_size_and_cover_the_text():
    text = np.frombuffer(("word " * 50000 + "END").encode(), np.uint8)
    x, owner = mil.encode(np.r_[text, text[:50]], np.array([0, len(text), len(text), len(text) + 50]))
    assert np.bincount(owner).tolist() == [-(-50001 // mil.PASSAGE_WORDS), 1, 1]
    assert x.any(axis=1)[owner == 0].all() and not x[owner == 1].any()


def test_ngrams_are_exact():
    text = "Stupid ÄB".encode()
    got = sorted(int(c) for part in nb.ngrams(np.frombuffer(text, np.uint8)) for c in part)
    low = "stupid ÄB".encode().replace(b"B", b"b")
    assert got == sorted(n << 56 | int.from_bytes(low[i:i + n]) for n in range(4, 8) for i in range(len(low) - n + 1))


def test_encoding_does_not_depend_on_neighbours():
    rows = [b"A b% c", b"", b"  lead! two", b"\n", b"tail ", b"x", b"", b"The end. " * 200, b"y|z"]
    offsets = np.cumsum([0, *map(len, rows)])
    x, owner = mil.encode(np.frombuffer(b"".join(rows), np.uint8), offsets)
    for i, r in enumerate(rows):
        alone, _ = mil.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(x[owner == i], alone), r


def test_every_ngram_of_enough_texts_counts(spark):
    """Marks of a rare language count although the frequent one's n-grams alone are more than a thousand."""
    words = np.random.default_rng(3)
    long_mark = "".join(words.choice(list("abcdefghijklmnopqrstuvw"), 400))
    def text(i):
        plain = " ".join(words.choice(WORDS, 30))
        return f"{plain} {long_mark} {plain}" if i % 4 == 0 else f"{plain} zyxbomente {plain}" if i % 20 == 1 else plain
    rows = [(i, text(i), int(i % 4 == 0 or i % 20 == 1)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = nb.train(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    rare = np.concatenate(list(nb.ngrams(np.frombuffer(b"zyxbomente", np.uint8))))
    assert len(model.codes) > 1000 and np.isin(rare, model.codes).all()
    # n-grams of the same texts share their weight.
    weight = model.weights[np.isin(model.codes, rare)]
    assert np.allclose(weight, weight[0]) and weight[0] > 0
    got = {r.doc_id: r.predicted for r in mil.predictions(nb.score(docs, model), nb.FOLDS, nb.HELD_OUT).collect()}
    assert all(got[i] == x for i, _, x in rows)


def test_features_equal_brute_force():
    rng = np.random.default_rng(5)
    text = np.frombuffer(bytes(rng.integers(97, 100, 3000).astype(np.uint8)), np.uint8)
    every = np.unique(np.concatenate(list(nb.ngrams(text))))
    model = nb.Model(rng.choice(every, 500, replace=False), np.zeros(500), 0.0)
    part = text[:400]
    here = np.unique(np.concatenate(list(nb.ngrams(part))))
    assert np.array_equal(model.features(part), np.flatnonzero(np.isin(model.codes, here)))


def tiny_model(rng):
    shapes = {"E": (mil.WIDTH, 5), "e": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "b": (1,)}
    return mil.Model(rng.normal(0, .1, mil.WIDTH), rng.uniform(.5, 2, mil.WIDTH), {k: rng.normal(0, 1, v) for k, v in shapes.items()})


def plain_forward(model, bag):
    """One bag's score in plain Python: gated attention, softmax, weighted sum, logistic unit."""
    import math

    w = {k: v.tolist() for k, v in model.weights.items()}
    product = lambda v, m: [sum(a * b for a, b in zip(v, column)) for column in zip(*m)]
    hidden, logits = [], []
    for x in bag.tolist():
        h = [math.tanh(a + b) for a, b in zip(product(x, w["E"]), w["e"])]
        gate = [math.tanh(t) / (1 + math.exp(-u)) for t, u in zip(product(h, w["V"]), product(h, w["U"]))]
        hidden.append(h)
        logits.append(sum(a * b for a, b in zip(gate, w["w"])))
    e = [math.exp(x) for x in logits]
    z = [sum(a * h[j] for a, h in zip(e, hidden)) / sum(e) for j in range(5)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"])) + w["b"][0])))


def test_forward_pass_equals_plain_python():
    rng = np.random.default_rng(6)
    model = tiny_model(rng)
    bags = [rng.normal(0, 1, (k, mil.WIDTH)) for k in (1, 4, 9)]
    got = model.forward(np.concatenate(bags), np.repeat([0, 1, 2], [1, 4, 9]))["p"]
    assert np.allclose(got, [plain_forward(model, b) for b in bags])


def test_a_long_text_scores_the_same_in_stretches(monkeypatch):
    rng = np.random.default_rng(7)
    model = tiny_model(rng)
    text = "  lead " + " ".join(rng.choice([*WORDS, "bad%%%", "X" * 40, "\n\n"], 9000)) + "  \n"
    flat = np.frombuffer(text.encode(), np.uint8)
    whole = model.score(flat, np.array([0, len(flat)]))
    for size in (100, 3000, 20_000):
        parts = list(mil.stretches(flat, size))
        assert b"".join(p.tobytes() for p in parts) == text.encode() and len(parts) > 2
        monkeypatch.setattr(mil, "LONG_TEXT", size)
        assert np.allclose(model.score(flat, np.array([0, len(flat)])), whole)


def test_a_bad_stretch_of_a_long_text_is_a_passage_of_its_own():
    good, bad = "the of red blue " * 16, "%%% ### $$$ !!! " * 16
    text = good * 300 + bad + good * 300
    x, _ = mil.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    alone, _ = mil.encode(np.frombuffer(bad.encode(), np.uint8), np.array([0, len(bad)]))
    assert len(x) == 601 and np.allclose(x[300], alone[0])


def test_learned_weights_of_toxicity_equal_brute_force(spark):
    """Counts, ratios and the fit, worked out from a plain matrix of all n-grams."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS[:5], 6)) + (" moron" if i % 3 == 0 else "") for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)], float)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = nb.train(docs, labels)
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % nb.FOLDS != nb.HELD_OUT]
    grams = [{int(c) for part in nb.ngrams(np.frombuffer(texts[i].encode(), np.uint8)) for c in part} for i in train]
    codes = sorted({c for g in grams for c in g if sum(c in h for h in grams) >= nb.MIN_DOCS})
    x = np.array([[c in g for c in codes] for g in grams], float)
    y = y[train]
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p, q = (share * y) @ x + nb.SMOOTHING, (share * (1 - y)) @ x + nb.SMOOTHING
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    assert model.codes[np.argsort(model.codes)].tolist() == codes
    # At the minimum of the penalized loss over every n-gram as a column of its own, the slope is zero.
    w = model.weights[np.argsort(model.codes)] / np.where(r == 0, 1, r)
    z = model.intercept + (x * r) @ w
    d = share * (1 / (1 + np.exp(-z)) - y)
    slope = np.r_[(x * r).T @ d + nb.PENALTY * w, d.sum()]
    start = share * (.5 - y)
    assert np.linalg.norm(slope) < 1e-3 * np.linalg.norm(np.r_[(x * r).T @ start, start.sum()])


def test_ngrams_across_block_borders(monkeypatch):
    text = np.frombuffer(bytes(np.random.default_rng(9).integers(97, 123, 700).astype(np.uint8)), np.uint8)
    codes = lambda: np.sort(np.concatenate(list(nb.ngrams(text))))
    whole = codes()
    model = nb.Model(np.unique(whole)[::3], np.ones(len(np.unique(whole)[::3])), -3.0)
    score = model.score(text)
    monkeypatch.setattr(nb, "_BLOCK", 64)
    assert np.array_equal(codes(), whole) and model.score(text) == score
