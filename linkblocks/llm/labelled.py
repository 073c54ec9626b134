"""A bounded sample of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int, where: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most `bound` labelled documents, chosen by a hash of doc_id.

    Rows whose doc_id or label is null are left out; of several labels of one
    document the least counts; of rows of documents with one id, all come.
    """
    chosen = labels.select(F.col("doc_id").cast("bigint"), F.col(column).cast("int").alias("label")).dropna()
    if where is not None:
        chosen = chosen.filter(where)
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(unit_hash(F.lit("sample"), F.col("doc_id")), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most `bound` rows of two numbers
