"""Token ids in ORC files.

Each range of document ids becomes one ORC file, ascending inside and across files: integer columns are run-length
encoded, stripes are read independently, row indexes and Bloom filters on the document id let a reader skip stripes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, small_batches, texts_of
from .fasttok import piece_encoder

#: ORC layout: stripes of 32 MB, a row index entry (and Bloom filter) every 1000 rows.
ORC_OPTIONS = {"orc.stripe.size": str(32 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
_SCHEMA = "doc_id long, file_no int, file_start long, n_ids int, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, blanks_dropped: bool, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` and write rows of doc_id, file_no, file_start (ids before it in its file), n_ids, ids.

    Rows are dealt by ranges of the key, so hot sources or copies don't matter; repeated rows follow one another and a
    null key comes first. Files are only committed when complete, and a lost task's file is written anew. A very
    long text is one row; extra columns are ignored.
    """
    small_batches(docs.sparkSession)

    def encode(batches):
        encoder = piece_encoder(tokenizer, blanks_dropped)
        end, no, start = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.frombuffer(x + end, "<i4") for x in encoder.encode(texts_of(b["text"]))]
            at = np.cumsum([0] + [len(x) for x in ids])
            yield {
                "doc_id": b["doc_id"].cast(pa.int64()),
                "file_no": pa.array(np.full(len(ids), no, np.int32)),
                "file_start": pa.array(start + at[:-1]),
                "n_ids": pa.array(np.diff(at).astype(np.int32)),
                "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(ids))),
            }
            start += int(at[-1])

    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = body.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_batches(ordered, encode, _SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    Stripes are read in parallel; a file's start comes from the running sum over one row a file.
    """
    rows = spark.read.schema(_SCHEMA).orc(path)

    def digest(batches):
        for b in batches:
            ids = b["ids"]
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            yield {
                "doc_id": b["doc_id"],
                "file_no": b["file_no"],
                "file_start": b["file_start"],
                "n_tokens": pa.array(np.diff(at).astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], pa.int64()),
            }

    small_batches(spark)
    thin = map_batches(rows.drop("n_ids"), digest, "doc_id long, file_no int, file_start long, n_tokens long, ids_crc32 long")
    sizes = rows.groupBy("file_no").agg(F.sum("n_ids").alias("_n"))
    # one row a file; a file is a range of documents, so these are few
    before = sizes.select("file_no", (F.sum("_n").over(Window.orderBy("file_no")) - F.col("_n")).alias("_before"))
    return thin.join(before, "file_no").select("doc_id", (F.col("_before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_ids, ids of the wanted documents. The condition reaches the ORC reader: files and stripes are left out by
    their statistics, and row groups by the row index and the Bloom filter on doc_id. Without ids the result is empty.
    """
    return spark.read.schema(_SCHEMA).orc(path).filter(F.col("doc_id").isin([int(i) for i in doc_ids])).select("doc_id", "n_ids", "ids")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, blanks_dropped: bool) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back. An empty table gives an empty result."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, blanks_dropped)
    return read_token_files(docs.sparkSession, path)
