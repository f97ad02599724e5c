"""Labelled rows: the fold that may be learned from, and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, label) of all rows that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()


def share(labels: DataFrame, label_col: str) -> float | None:
    """Share of label 1 among all learnable rows, sampled or not; None if there is none."""
    return learnable(labels, label_col).agg(F.avg("label")).first()[0]


def sample(labels: DataFrame, label_col: str, per_class: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` learnable rows of each class, by a hash order."""
    known = learnable(labels, label_col)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_documents(docs: DataFrame, chosen: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of the chosen rows; ``chosen`` is bounded by the sample's size and broadcast."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
