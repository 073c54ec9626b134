"""Token ids as a Parquet data set that can be read in part.

Layout: one row a document in ascending document order, `ids` an integer list
column. List values are dictionary encoded (the dictionary of a row group holds
the ids that occur in it, packed to as many bits as it needs), with delta
encoding as the writer's fallback; row groups and pages have bounded sizes and
the files carry column and offset indexes, so that a range of doc_id reads its
pages only and metadata is read without touching a token.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, scratch_dir, text_chunks
from .tokenize import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Text that one file's documents hold together, about.
FILE_BYTES = 256 << 20
#: Text that is encoded at once; what pieces cost that were not met before is shared by a chunk.
ENCODE_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """doc_id, n_tokens, ids of every row. Null text is empty; every document ends with `end_id`, if one is given.

    Rows keep their order and partition; repeated ids stay repeated rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, limit=ENCODE_BYTES):
            ids, at = encoder(tokenizer).encode(data, offsets, end_id)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(encode), "doc_id bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int | None = 0, files: int | None = None) -> str:
    """Encode `docs` and write them in ascending doc_id order; returns the folder.

    Range partitioning puts equal ids into one file, so the order of files and
    of rows in them is the order of doc_id: nulls first, repeated ids by text.
    `shard` numbers the files' ranges; a range is one file whatever its rows.
    There are as many as shuffle partitions, more where a file would hold over
    FILE_BYTES of text. An empty table makes an empty data set.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    if files is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ranged = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = encode_documents(ranged, tokenizer or default_tokenizer(), end_id).withColumn("shard", F.spark_partition_id())
    options = {
        "maxRecordsPerFile": "0",  # token_index counts rows within a shard's one file
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    rows.write.mode("overwrite").options(**options).parquet(path)
    return path


SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, shard int"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, n_tokens of all documents; the pages of `ids` are not read."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "shard", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, ids of a range of doc_id (both ends included); row groups and pages outside it are skipped by their indexes."""
    out = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        out = out.filter(F.col("doc_id") >= first)
    if last is not None:
        out = out.filter(F.col("doc_id") <= last)
    return out.select("doc_id", "ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files.

    `start` counts the ids of all documents before it: the sum of the files'
    totals before its own, and a running sum inside its file. Only the totals,
    one row a file, meet in one task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(SCHEMA).parquet(path)
    # files are read in pieces; a row's position inside its file keeps repeated ids in the order written
    rows = stored.select("shard", F.col("_metadata.row_index").alias("row"), "doc_id", "ids").mapInArrow(lean(digest), "shard int, row bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    totals = read_metadata(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return out.join(bases, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
