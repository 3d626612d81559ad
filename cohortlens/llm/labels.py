"""The labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents that are not held out.

    At most ``most`` labels, those of smallest hash of their id; that bound
    also bounds the broadcast.  Rows that share an id give one text, the least:
    an id that many rows repeat is still one label.
    """
    ids = F.col("doc_id").cast("bigint")
    chosen = (labels.select(ids.alias("__id"), F.col(label).cast("int").alias("label")).filter("__id IS NOT NULL AND label IS NOT NULL")
              .filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(most))
    own = docs.select(ids.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
