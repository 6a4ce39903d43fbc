"""A training corpus from raw documents: five stages, each working on what the one before kept.

All stages but the last return the columns of their input, further ones too. Rows of a null
doc_id are nobody's copy, source or hit and pass all stages but the toxicity of their text;
repeated rows stay repeated and share what is decided for their id; null and empty texts pass;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievecraft.llm import decontaminate, nearcopies, repeats, toxicity
from sievecraft.llm.common import stored, table
from sievecraft.llm.queries import PATTERN, TOKENIZER, bpe


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of this input, lets pass."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class."""
    classes = nearcopies.near_duplicates(docs)
    gone = stored(classes.where(~classes.kept).select("doc_id"), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a smaller doc_id has."""
    return repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hits = stored(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")), "hits")
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.encode_column(docs, TOKENIZER, PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can't express the toxicity model and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
