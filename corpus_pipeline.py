"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes every stage to the
shared folder and reads it again, so that a lost executor costs no more than one stage's tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnmill.llm import decontamination, packing, simhash, suffix_dedup, toxicity
from tarnmill.llm.common import drop_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, calls toxic go.

    Null and empty texts have the score of a text without words and, as that is no toxic one, stay; null or unseen
    languages get the threshold of all languages; repeated rows have one fate; very long texts are scored whole. Labels
    that are null or lack a document are left out. No labels: all stay. Empty table: empty. Extra columns pass through."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least doc_id.

    Null, empty and other texts without words all stay. Null ids sort last; of repeated rows one stays; ties of id are
    broken by a hash of the text. Very long texts are signed whole. Empty table: empty. Extra columns pass through."""
    return simhash.drop_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occurred earlier are cut from the texts; the first occurrence stays.

    Null, empty and short texts are untouched; a document of which nothing is left goes. Null ids come last; rows of
    equal id and text are one document. Very long texts are cut whole. Empty table: empty. Extra columns pass through,
    and n_chars is counted anew where a text was cut."""
    return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, word for word or re-parameterised.

    Null and empty texts and items hold nothing and stay. Repeated rows and equal texts have one fate. Very long texts
    are searched whole. Empty table or benchmark: all stay. Extra columns pass through."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, n_tokens, pack_id, position), by tokens of the default vocabulary.

    Null and empty texts: one row without a window. Repeated rows and null ids are packed like others; a text longer
    than a window makes several pieces. Empty table: empty. Extra columns are not read."""
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if previous is not None:
            drop_written(previous)
        previous = docs
    return STAGES[-1][1](spark, docs, sf_dir)
