"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_column: str, folds: int, held_out: int, most: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled rows outside the held-out fold: those with the least hash of their id.

    Null labels are left out; of several labels of one id the largest counts.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label_column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the bound also bounds what is broadcast
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
