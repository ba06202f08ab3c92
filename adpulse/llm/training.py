"""Bounded samples of labelled documents, for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.runtime import folded, keep


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, weight): up to ``per_class`` training documents of each class.

    Only labels of documents outside the held-out fold are looked at, those of
    the smallest id hash first.  ``weight`` gives each class the share in the
    sample that it has among all training labels.  Labels other than 0 and 1 do
    not count, and an id with several labels counts once, by the smallest.  The
    sample has a fixed bound, so its ids may go to every task.
    """
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~folded(id_col, folds, held_out))
              .groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label")))
    usable = keep(usable, "training_labels")
    # One bounded top-k for each class: tasks send their own best, and no class meets whole in one.
    best = [usable.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    chosen = best[0].unionByName(best[1])
    sizes = usable.groupBy("_label").agg(F.count("*").alias("_all"))
    taken = chosen.groupBy("_label").agg(F.count("*").alias("_taken"))
    chosen = keep(chosen.join(sizes, "_label").join(taken, "_label").select("_id", "_label", (F.col("_all") / F.col("_taken")).alias("_weight")), "sample_ids")
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.join(F.broadcast(chosen), "_id")          # 2 * per_class rows of three numbers at most
    # An id that stands in several rows would outweigh the bound: the smallest text of it counts.
    found = found.groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("label"), F.first("_weight").alias("weight"))
    return keep(found.orderBy("_id").select("text", "label", "weight"), "sample")
