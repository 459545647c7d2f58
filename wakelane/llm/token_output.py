"""Token-ID output: Parquet list columns in document order, and reading them back.

Files hold (shard, doc_id, local_start, n_tokens, ids) in ascending doc_id
order; list values are dictionary encoded, falling back to delta encoding (the
v2 page format), in row groups and pages of stated sizes with Parquet's page
index, so that a reader of n_tokens or of a doc_id range skips the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakelane.llm.chunks import id_lists
from wakelane.llm.common import fresh_path, gathered, list_slices, map_arrow, tuned, with_prefix_sum
from wakelane.llm.hf_tokens import encoder
from wakelane.llm.packing import crc_of

#: Writer settings: row groups small enough to skip, pages small enough to seek.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text encoded together.
BATCH_BYTES = 2 << 20
WRITER = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "snappy",
}
FILE_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_tokens(df: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id and writes path in ascending id order.

    Range partitioning spreads ids evenly; texts, not ids, are shuffled. Null
    texts are empty and still get end_id; null ids come first; rows with the
    same id follow each other. Other columns are not read. An empty table
    writes no rows.
    """
    tuned(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        encode, shard, start = encoder(tokenizer_path).encode, TaskContext.get().partitionId(), 0
        for batch in gathered(batches, BATCH_BYTES):
            offsets, ids = encode(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, shard, np.int32)), batch.column(0), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), id_lists(offsets, ids)],
                names=["shard", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    rows.mapInArrow(run, FILE_SCHEMA).write.options(**WRITER).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The files' rows; select n_tokens or doc_id alone and ids are not read."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all taken from the files.

    start needs each file's total only: one row per file is summed up, and
    joined to the narrow digests, never to the ids.
    """

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, values = list_slices(batch.column(3))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), crc_of(values, offsets[:-1].astype(np.int64), np.diff(offsets))], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    first = with_prefix_sum(totals, "shard", "total", "base").select("shard", "base")
    rows = map_arrow(files.select("shard", "doc_id", "local_start", "ids"), digest, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(first, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(df: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the token files into the shared folder and digests them from there."""
    path = fresh_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer_path, path, end_id)
    return document_digests(df.sparkSession, path)
