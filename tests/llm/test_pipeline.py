from __future__ import annotations

import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def passed(spark):
    """The documents before each stage and after the last."""
    from adpulse.llm.runtime import keep, prepare

    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = keep(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_columns_and_narrow_down(passed):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "simhash", "suffix_dedup", "packing"]
    assert all(d.columns == COLUMNS for d in passed[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in passed]
    assert ids[0] > ids[1] > ids[2] >= ids[3] and ids[3] == ids[4] == ids[5]


def test_one_of_each_group_stays(passed):
    from tests.llm.test_golay_simhash import brute_components, brute_fingerprint

    before = [(r.doc_id, brute_fingerprint(r.text)) for r in passed[2].select("doc_id", "text").collect()]
    assert {r.doc_id for r in passed[3].collect()} == set(brute_components(before).values())


def test_repeats_are_cut(passed):
    """Byte for byte what brute force keeps; a character of which only some bytes repeat goes whole."""
    rows = {r.doc_id: (r.text or "").encode() for r in passed[3].collect()}
    first = {}
    for d, b in rows.items():
        for i in range(len(b) - 49):
            first[b[i:i + 50]] = min(first.get(b[i:i + 50], d), d)
    for r in passed[4].collect():
        b = rows[r.doc_id]
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < r.doc_id:
                gone[i:i + 50] = [True] * 50
        assert r.text == bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")


def test_packed_tokens_are_all_there(passed):
    words = sum(len(r.text.encode().split()) for r in passed[4].collect())
    assert sum(r.n_tokens for r in passed[5].collect()) == words


def test_run_equals_the_stages(spark, passed):
    assert cp.run(spark, SF).columns == passed[5].columns
