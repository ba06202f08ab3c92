"""Documents scored by cross-entropy difference (target minus background).

Two bigram models share one vocabulary, every word of either corpus, and are
built alike: the target model from the target table, the background model from
every document.  Each token costs -log2 p under either; a document's score is
the mean difference over its tokens.  The lower, the more the document reads
like the target.

Both models grow with the corpora, so no task and not the driver holds one:

1. The documents are written once, in parts of a few MB, bucketed by part.
2. Each part sends the counts of its distinct words and pairs of words, by a
   64-bit hash, packed by bucket of hashes; a frequent pair stands in a part's
   rows once, however often it occurs there.  The target's tasks send theirs too.
3. A bucket sums the counts of both corpora and answers each part that asked.
   There are as many buckets as keep each one's share of the corpus bounded.
4. Each part scores its documents from the text and the answers it got.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.arrowtext import blocks, texts, utf8
from adpulse.llm.parts import pack, unpack, write_parts
from adpulse.llm.runtime import keep, prepare

PRIOR = 8.0              # weight of the unigram model in a bigram's estimate
PART_BYTES = 4 << 20     # text of a part (one document at least)
BUCKET_PARTS = 8         # parts' worth of counts that a bucket holds, about
_ASKED = "part long, bucket long, blob binary"
_ANSWERED = _ASKED + ", background long, target long, words long"


def _planes(values: np.ndarray) -> np.ndarray:
    """8-byte numbers with their first bytes together, then the second ones ...: small numbers pack well so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


class Tokens:
    """The words of some texts, numbered, with a key for each word and each pair of neighbours.

    Number 0 is the sign that stands before a text's first word.
    """

    def __init__(self, column: pa.Array):
        index: dict[bytes, int] = {b"": 0}
        found = [np.zeros(0, np.int64)]
        for data in texts(column):
            words = data.split()
            found.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        self.n = np.fromiter(map(len, found[1:]), np.int64, len(found) - 1)
        self.ids = np.concatenate(found)
        self.before = np.r_[0, self.ids[:-1]][: len(self.ids)]
        self.before[(np.cumsum(self.n) - self.n)[self.n > 0]] = 0
        self.size = len(index)
        self.word_key = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        self.pair, self.of, self.pair_n = np.unique(self.before * self.size + self.ids, return_inverse=True, return_counts=True)
        self.a, self.b = np.divmod(self.pair, self.size)
        key = self.word_key[self.a] * np.uint64(0x9E3779B97F4A7C15) + self.word_key[self.b]
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        self.pair_key = key ^ key >> np.uint64(32)
        self.word_order, self.pair_order = np.argsort(self.word_key), np.argsort(self.pair_key)

    def slices(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, its words, its pairs), both in the order of their keys."""
        cuts = []
        for order, key in ((self.word_order, self.word_key), (self.pair_order, self.pair_key)):
            cuts.append(np.searchsorted(_bucket(key[order], buckets), np.arange(buckets + 1)))
        for b in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
            yield b, self.word_order[cuts[0][b]: cuts[0][b + 1]], self.pair_order[cuts[1][b]: cuts[1][b + 1]]

    def counts(self, part: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """(part, bucket, blob): keys, how often each occurs, and how often a word stands before another."""
        n, m = (np.bincount(x, minlength=self.size) for x in (self.ids, self.before))
        for b, w, p in self.slices(buckets):
            yield part, b, pack(*(_planes(x) for x in (np.diff(self.word_key[w], prepend=np.uint64(0)), n[w], m[w], np.diff(self.pair_key[p], prepend=np.uint64(0)), self.pair_n[p])))

    def means(self, answers: dict[int, bytes], buckets: int, totals: dict[str, int], prior: float) -> list[np.ndarray]:
        """The mean loss of each text, under the background and the target model."""
        n, before = np.zeros((2, 2, self.size), np.int64)
        pair = np.zeros((2, len(self.pair)), np.int64)
        for b, w, p in self.slices(buckets):
            got = [_numbers(x, np.int64) for x in unpack(answers[b])]
            n[:, w], before[:, w], pair[:, p] = got[:2], got[2:4], got[4:]
        row = np.repeat(np.arange(len(self.n)), self.n)
        out = []
        for i, side in enumerate(("background", "target")):
            cost = losses(pair[i], before[i][self.a], n[i][self.b], totals[side], totals["words"], prior) if len(self.pair) else np.zeros(0)
            out.append(np.bincount(row, cost[self.of], len(self.n)) / np.maximum(self.n, 1))
        return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, so that a bucket's keys lie close together."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _answers(table: pa.Table) -> pa.Table:
    """For each part's words and pairs, in its order, their counts in both corpora; the first row has the bucket's totals."""
    part = table.column("part").to_numpy()
    lists = [[_numbers(x, k) for x, k in zip(unpack(blob), (np.uint64, np.int64, np.int64, np.uint64, np.int64))] for blob in table.column("blob").to_pylist()]
    found, totals = [[] for _ in lists], [0, 0, 0]
    for at, values in ((0, (1, 2)), (3, (4,))):
        size = [len(x[at]) for x in lists]
        key, which = np.unique(np.concatenate([np.cumsum(x[at], dtype=np.uint64) for x in lists]), return_inverse=True)
        target = np.repeat(part < 0, size)
        for v in values:
            value = np.concatenate([x[v] for x in lists])
            both = []
            for side in (~target, target):
                both.append(np.zeros(len(key), np.int64))
                np.add.at(both[-1], which[side], value[side])
                split = np.split(both[-1][which], np.cumsum(size)[:-1])
                for out, x in zip(found, split):
                    out.append(x)
            if v == 1:
                totals = [int(both[0].sum()), int(both[1].sum()), int(np.count_nonzero(both[0] + both[1]))]
    rows = [(int(p), pack(*map(_planes, x))) for p, x in zip(part, found) if p >= 0]
    rows = [(-1, None), *rows]
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary()),
                     **{c: pa.array([t] + [0] * (len(rows) - 1), pa.int64()) for c, t in zip(("background", "target", "words"), totals)}})


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: int, words: int, prior: float) -> np.ndarray:
    """-log2 p(word | word before): bigram counts with the add-one unigram model as prior."""
    unigram = (word + 1) / (total + words)
    return -np.log2((pair + prior * unigram) / (before + prior))


def _asked(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("part", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())))})


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
          prior: float = PRIOR, part_bytes: int = PART_BYTES, bucket_parts: int = BUCKET_PARTS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row.

    Losses are bits a token; a text without a word (or null) has 0 tokens, and
    all three are 0.  Repeated rows count, and come out, as often as they stand
    there.  Without a target every word is as likely there as any other.
    """
    spark = prepare(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lower = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    id_type = lower.schema["doc_id"].dataType
    # The id as it is goes along; the parts' own id is of no use here.
    parts = (write_parts(lower.select(F.lit(0).alias("none"), "doc_id", "text"), "none", "text", part_bytes)
             .select("_part", "_text", F.col("c1").alias("doc_id")))
    buckets = max(partitions, -(-parts.select("_part").distinct().count() // bucket_parts))

    def of_part(table: pa.Table) -> pa.Table:
        return _asked(list(Tokens(table.column("_text")).counts(table.column("_part")[0].as_py(), buckets)))

    def of_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks(utf8(b.column(0))[1], part_bytes):
                yield from _asked(list(Tokens(b.column(0).slice(i, j - i)).counts(-1, buckets))).to_batches()

    asked = (parts.select("_part", "_text").groupBy("_part").applyInArrow(of_part, _ASKED)
             .unionByName(target.select(F.lower(F.col(target_col))).mapInArrow(of_target, _ASKED)))
    answered = keep(asked.groupBy("bucket").applyInArrow(_answers, _ANSWERED), "answers")
    got = answered.agg(*(F.sum(c).alias(c) for c in ("background", "target", "words"))).first()
    totals = {c: got[c] or 0 for c in ("background", "target", "words")}

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("_text"))
        g, t = tokens.means(dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist())), buckets, totals, prior)
        return pa.table({"doc_id": table.column("doc_id"), "n_tokens": tokens.n, "target_loss": t, "background_loss": g, "score": t - g})

    schema = f"doc_id {id_type.simpleString()}, n_tokens long, target_loss double, background_loss double, score double"
    return parts.groupBy("_part").cogroup(answered.where("part >= 0").select("part", "bucket", "blob").groupBy("part")).applyInArrow(finish, schema)
