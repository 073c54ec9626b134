"""Helpers that the corpus operators share: table access, the shared scratch folder, Arrow text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel looks at in one go; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch; texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1_000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the cluster names none and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linkblocks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/linkblocks-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back: Spark keeps a Python worker, with all it holds, for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(kernel: Callable) -> Callable:
    """The kernel (batches to batches), releasing memory when its task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def chunked_array(texts: Iterator[pa.Array], kernel: Callable[[np.ndarray, np.ndarray], pa.Array], limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """One array for each array of texts, made by the kernel from text chunks."""
    for text in texts:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        made = [kernel(data, offsets) for _, data, offsets in text_chunks(iter([batch]), limit=limit)]
        yield pa.concat_arrays(made) if made else kernel(np.empty(0, np.uint8), np.zeros(1, np.int64))
    release()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches holding at most `limit` bytes of text, with the UTF-8 bytes and row offsets of their texts; null is empty."""
    for batch in batches:
        col = batch.column(column)
        if col.null_count:
            col = col.fill_null("")
        wide = pa.types.is_large_string(col.type)
        _, off_buf, data_buf = col.buffers()
        if len(col) == 0:
            continue
        off = np.frombuffer(off_buf, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def unit_hash(*cols) -> F.Column:
    """A number in [0, 1) that depends on the values only: 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
