"""The ``opN_`` queries: each operator over its whole table, with production parameters.

The queries are thin: they read the table, call the operator and derive the
columns asked for.  ``ORACLE_SQL`` holds the DuckDB statement of those that SQL
can say on whole tables; the others are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpulse.llm import best_fit, byte_bpe, collocations, fm_dedup, golay_simhash, kd_topk, lm_scoring, mil_quality, nb_toxicity, page_text, permuterm, rule_cascade, suffix_dedup
from adpulse.llm.runtime import prepare

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    return mil_quality.predictions(mil_quality.score(docs, model), mil_quality.FOLDS, mil_quality.HELD_OUT)


def op2_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nb_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return mil_quality.predictions(nb_toxicity.score(docs, model), nb_toxicity.FOLDS, nb_toxicity.HELD_OUT)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.components(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the benchmark's texts; background: all documents.  Rounded to 6 places, as the SQL is."""
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are the near-duplicate components of the SimHash operator."""
    docs = table(spark, sf_dir, "documents")
    clusters = golay_simhash.components(docs).select("doc_id", F.col("component_id").alias("cluster"))
    return best_fit.pack_documents(docs, clusters=clusters)


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.verdicts(table(spark, sf_dir, "documents"))


def op10_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kd_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op11_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.variants(table(spark, sf_dir, "documents"), corrupt_every=permuterm.CORRUPT_EVERY)


def op12_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mil_quality, op2_nb_toxicity, op3_simhash, op4_suffix_dedup, op5_lm_scoring, op6_best_fit, op7_page_text, op8_byte_bpe,
        op9_rule_cascade, op10_kd_topk, op11_permuterm, op12_fm_dedup, op13_collocations)
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k
              FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
        f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
        r AS (SELECT w.doc_id, w.i FROM w JOIN f USING (k) WHERE f.m < w.doc_id),
        b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM g GROUP BY doc_id, run),
        p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
        k AS (SELECT p.doc_id, sum(e - a) AS gone, count(*) AS spans, max(e) AS last,
                     string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
              FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op5_lm_scoring": r"""
        WITH words AS (SELECT 't' AS side, item_id AS doc, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
                       FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
                       UNION ALL
                       SELECT 'b', doc_id, unnest(ws), unnest(range(1, len(ws) + 1))
                       FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        v AS (SELECT count(DISTINCT w) AS size FROM words),
        pairs AS (SELECT side, doc, coalesce(lag(w) OVER (PARTITION BY side, doc ORDER BY i), '') AS a, w AS b FROM words),
        ab AS (SELECT side, a, b, count(*) AS k FROM pairs GROUP BY side, a, b),
        a_ AS (SELECT side, a, sum(k) AS k FROM ab GROUP BY side, a),
        b_ AS (SELECT side, b, sum(k) AS k FROM ab GROUP BY side, b),
        all_ AS (SELECT s.side, coalesce(sum(k), 0) AS k FROM (SELECT unnest(['t', 'b']) AS side) s LEFT JOIN ab USING (side) GROUP BY s.side),
        cost AS (SELECT all_.side, u.a, u.b,
                        -log2((coalesce(ab.k, 0) + 8.0::DOUBLE * ((coalesce(b_.k, 0) + 1)::DOUBLE / (all_.k + v.size))) / (coalesce(a_.k, 0)::DOUBLE + 8.0)) AS bits
                 FROM (SELECT a, b FROM ab WHERE side = 'b') u CROSS JOIN all_ CROSS JOIN v LEFT JOIN ab ON ab.side = all_.side AND ab.a = u.a AND ab.b = u.b
                 LEFT JOIN a_ ON a_.side = all_.side AND a_.a = u.a LEFT JOIN b_ ON b_.side = all_.side AND b_.b = u.b),
        s AS (SELECT p.doc, count(*) AS n, avg(t.bits) AS t, avg(g.bits) AS g
              FROM pairs p JOIN cost t ON t.side = 't' AND t.a = p.a AND t.b = p.b JOIN cost g ON g.side = 'b' AND g.a = p.a AND g.b = p.b
              WHERE p.side = 'b' GROUP BY p.doc)
        SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(t, 0), 6) AS target_loss, round(coalesce(g, 0), 6) AS background_loss,
               round(coalesce(t - g, 0), 6) AS score
        FROM documents LEFT JOIN s ON s.doc = doc_id""",
    "op9_rule_cascade": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
        q AS (SELECT doc_id, i, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, len(ws) AS n, lag(ws[i]) OVER (PARTITION BY doc_id ORDER BY i) = ws[i] AS stutter FROM p),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS twice FROM q WHERE i <= n - 2),
        r AS (SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS s FROM c WHERE twice) GROUP BY doc_id),
        u AS (SELECT doc_id, count(*) FILTER (WHERE stutter) AS n_stutters FROM q GROUP BY doc_id),
        m AS (SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
                     CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines,
                     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters
              FROM w LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)),
        b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 5 * n_symbols > n_words
                    OR 2 * n_dup_lines > len(lines)
                    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g'))
                    OR 4 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
                    OR 4 * n_stutters > n_words) AS kept
        FROM b""",
    "op10_kd_topk": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # crc32 by its definition, eight shifts for each entry of a table.
    "op11_permuterm": r"""
        WITH RECURSIVE bits(x, k, v) AS (SELECT range, 0, range FROM range(256)
            UNION ALL SELECT x, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
        tab AS MATERIALIZED (SELECT list(v ORDER BY x) AS t FROM bits WHERE k = 8),
        runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
                 FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
                 GROUP BY 1, 2 HAVING length(run) >= 6),
        coded AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
        summed AS (SELECT run, k, xor(list_reduce([CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) for i in range(length(h) // 2)],
                                                  lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS c
                   FROM coded, tab),
        vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n
                  FROM (SELECT k, CASE WHEN c % 199 = 0 THEN substr(run, 1, CAST(c % length(run) AS BIGINT)) || substr(run, CAST(c % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM summed)
                  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
        holes AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS BIGINT)) AS a, substr(word, CAST(i + 1 AS BIGINT)) AS z FROM places),
        gone AS (SELECT DISTINCT word, n, a || z AS cut FROM holes),
        pairs AS (SELECT x.word, y.word AS near, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.z = y.z AND x.i = y.i AND x.word <> y.word
                  UNION ALL SELECT g.word, v.word, v.n FROM gone g JOIN vocab v ON v.word = g.cut
                  UNION ALL SELECT v.word, g.word, g.n FROM gone g JOIN vocab v ON v.word = g.cut),
        best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
        formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
                          CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
        walk(word, cur) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.cur WHERE f.form IS NOT NULL),
        roots AS (SELECT w.word, w.cur AS root FROM walk w JOIN formed f ON f.word = w.cur WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)""",
    "op12_fm_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT doc_id, list(DISTINCT pos) AS places FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS pos FROM win JOIN low USING (k) WHERE m < win.doc_id) GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        hit AS (SELECT doc_id, unnest(places) AS i FROM gone),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
                        FROM documents),
        ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang),
        grams AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
        f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, m, string_split(phrase, ' ') AS w, phrase, a FROM f WHERE m > 1),
        inner_ AS (SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS by_a
                   FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, m, w, a, unnest(range(2, m)) AS k FROM c)) GROUP BY ALL),
        free AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE by_a IS NULL OR 100 * by_a < 100 * a),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
        scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q JOIN total ON total.lang = cuts.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000""",
}
