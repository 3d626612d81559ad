"""Corpus pipeline: from raw documents to packed training sequences.

Stages, in order: documents predicted toxic go; lines similar to an earlier line
go (documents left without any line go with them); of each group of near copies
the document with the smallest id stays; the rest is mixed to the target weights
of its sources; the mix is packed into sequences.  Every stage but the last
returns the columns of documents.

Defined cases: null and empty texts are scored like any (a text without words is not
toxic), have no lines to lose, are near copies of nothing, are taken by no mix
(their size is 0) and so end with the mix; a null doc_id is never a near copy and is
mixed and packed like others; rows that repeat a doc_id and text lose the same lines, and
the join keeps or drops rows of one doc_id together; equal similarity or size is told apart by doc_id, then by the
text's hash; a null source is a source, the last; whole texts of any length pass all stages;
without documents every stage gives no rows, without labels no document is toxic;
other columns are carried to the mix, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import best_fit_packing, jaccard_join, line_dedup, source_mixing, toxicity
from cohortlens.llm.tables import read, stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the labels teach the classifier."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines similar to an earlier one; a document all of whose lines went goes."""
    cleaned = line_dedup.deduplicated(docs)
    return cleaned.filter((F.col("__kept") > 0) | (F.col("__lines") == 0)).drop("__kept", "__lines")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles reach a similarity of 0.8."""
    return jaccard_join.deduplicated(docs, k=5, num=8, den=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each pass over a document."""
    return source_mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 1024 tokens, with their ids."""
    return best_fit_packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
