"""Best-fit packing of documents into sequences, with conflicts.

Each sequence (bin) holds ``capacity`` tokens.  Documents go in by decreasing
length, each to the tightest bin it fits that holds neither a document of its
source nor one of its duplicate cluster.  The bins of a group are ordered by
residual; each carries a bitmap of its sources and one of its clusters, and the
search goes from the first bin that is large enough on to its successors until
one is compatible.

Documents are dealt over groups of bounded size by a hash of their id, so that
a large source or cluster is spread over all groups, and groups are packed in
parallel.  Rows alike in all that packing looks at are counted, and dealt as
numbered bundles of bounded size.  A document longer than a bin is cut: full bins of its own, and a last
piece that is packed like a document.  No token is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.runtime import prepare

CAPACITY = 2048          # tokens of a sequence
GROUP_DOCS = 2048        # documents packed together
BUNDLE = 16              # equal rows that stay together when they are dealt
_WORDS = r"[^\x20\x09-\x0D]+"


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, by conflict-constrained best fit in the order given.

    Items are numbered bits: ``sources`` and ``clusters`` hold small integers.
    Bins of one residual are taken in the order of their making.
    """
    order: list[tuple[int, int]] = []          # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed = []
    for n, s, c in zip(lengths, sources, clusters):
        s_bit, c_bit = 1 << s, 1 << c
        at = bisect_left(order, (n, -1))
        while at < len(order) and (source_bits[order[at][1]] & s_bit or cluster_bits[order[at][1]] & c_bit):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s_bit
        cluster_bits[b] |= c_bit
        placed.append((b, capacity - room))
        if room > n:                           # a full bin takes nothing more
            insort(order, (room - n, b))
    return placed


def _numbered(values: list) -> list[int]:
    index = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return [index[v] for v in values]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source", cluster: object = None, length: object = None, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, doc_offset, n_tokens): where each piece of each row goes.

    ``length`` is a column expression of tokens (default: words of the text) and
    ``cluster`` one of the duplicate cluster (default: a hash of the lower-cased
    text, which tells exact copies only); ``clusters``, a table (doc_id, cluster) of
    near-duplicate clusters, takes its place (an id with several has the smallest,
    an id without one the default).  A null or empty text has length 0 and one piece of no tokens, packed
    like the others; null sources are one source.  ``bin_id`` is unique over all
    groups.  Only ids, lengths and marks are shuffled, never texts.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.regexp_count(text, F.lit(_WORDS)) if length is None else length
    mark = F.xxhash64(F.lower(text)) if cluster is None else cluster
    slim = docs.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("n"), F.col(source_col).cast("string").alias("source"), mark.cast("string").alias("cluster"))
    if clusters is not None:
        near = clusters.select(F.col("doc_id").alias("near_id"), F.col("cluster").cast("string").alias("near")).groupBy("near_id").agg(F.min("near").alias("near"))
        slim = (slim.join(near, F.col("doc_id") == F.col("near_id"), "left")
                .select("doc_id", "n", "source", F.coalesce(F.concat(F.lit("near "), "near"), "cluster").alias("cluster")))
    groups = max(1, -(-docs.select(id_col).count() // group_docs))
    # Equal rows are counted in the tasks; their bundles, like a cluster's copies and rows that
    # repeat an id, are spread by all that is known of them.
    counted = slim.groupBy("doc_id", "n", "source", "cluster").agg(F.count(F.lit(1)).alias("rows"))
    bundles = counted.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BUNDLE))))
    bundles = bundles.withColumn("rows", F.least(F.lit(BUNDLE).cast("long"), F.col("rows") - F.col("nth") * BUNDLE))
    dealt = bundles.withColumn("grp", F.pmod(F.xxhash64("doc_id", "n", "source", "cluster", "nth"), F.lit(groups)))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "bin_id", "bin_offset", "doc_offset", "n_tokens"]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("rows").to_numpy())))
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        group = table.column("grp")[0].as_py()
        n = table.column("n").to_pylist()
        ids, source, mark_ = table.column("doc_id"), table.column("source").to_pylist(), table.column("cluster").to_pylist()
        rest = sorted(range(len(n)), key=lambda i: -(n[i] % capacity if n[i] > capacity else n[i]))
        # A document of whole bins has no last piece.
        rest = [i for i in rest if not (n[i] > capacity and n[i] % capacity == 0)]
        size = [n[i] % capacity if n[i] > capacity else n[i] for i in rest]
        places = pack(size, _numbered([source[i] for i in rest]), _numbered([mark_[i] for i in rest]), capacity)
        rows, next_bin = [], max((b for b, _ in places), default=-1) + 1
        for i, k, (b, offset) in zip(rest, size, places):
            rows.append((i, (n[i] - k) // capacity, b, offset, n[i] - k, k))
        for i in range(len(n)):
            if n[i] > capacity:
                for piece in range(n[i] // capacity):
                    rows.append((i, piece, next_bin, 0, piece * capacity, capacity))
                    next_bin += 1
        rows.sort()
        columns = list(zip(*rows)) if rows else [()] * 6
        out = [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])]
        out[2] = pa.array(np.array(columns[2], np.int64) + (group << 32))
        return pa.Table.from_arrays(out, names=names)

    return dealt.groupBy("grp").applyInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:]))
