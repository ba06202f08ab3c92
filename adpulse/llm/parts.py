"""Documents dealt into parts of bounded size, in a table that later jobs read where it lies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.taskcontext import TaskContext

from adpulse.llm.arrowtext import utf8
from adpulse.session import scratch_path


BUCKET_BYTES = 64 << 20      # text that a bucket of the parts table holds, about


def write_parts(docs: DataFrame, id_col: str, text_col: str, part_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_part, _row, _id, _text, c0, c1, ...) of the documents, bucketed by part.

    A bucket is what one task reads later; there are as many as the bytes of the
    texts ask for, so that a task's share does not grow with the table.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    others = [c for c in docs.columns if c != text_col]
    flat = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"),
                       *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    schema = StructType([StructField("_part", LongType()), StructField("_row", LongType()), *flat.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, filled = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            size = np.diff(utf8(b.column(1))[1]).tolist()
            parts = []
            for n in size:
                if filled and filled + n > part_bytes:
                    part, filled = part + 1, 0
                filled += n
                parts.append(part)
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), rows, *b.columns], names=schema.names)

    spark = docs.sparkSession
    name = f"parts_{uuid.uuid4().hex[:12]}"
    (flat.mapInArrow(deal, schema).write.bucketBy(buckets, "_part").option("compression", "zstd")
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")      # the name only: the files stay
    return table


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays, one after the other, compressed."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def unpack(blob: bytes) -> list[bytes]:
    """The bytes of what was packed, one by one."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(raw[at: at + size])
        at += size
    return out
