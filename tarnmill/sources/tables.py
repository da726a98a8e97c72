"""Readers of the tables, and the views that bind posting concepts to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reports look back from here; nothing reads the wall clock.
AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(days: int = 0) -> Column:
    """The day `days` before the as-of date, as a timestamp without time zone."""
    return F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def outcome(value: Column) -> Column:
    return F.when(value >= 10, "valid").when(value >= 2, "discarded").otherwise("reviewed")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, one row for each processed posting, bound to events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    state = outcome(F.col("value"))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"),
        F.col("event_type").alias("source"),
        state.alias("outcome"),
        F.when(state == "discarded", F.concat(F.lit("reason_"), (k % 5).cast("string"))).otherwise("").alias("rejection_reason"),
        k.alias("k"),
        F.col("ts").alias("processed_at"),
        F.col("value").alias("processing_time_ms"),
    )


JOBS_SQL = """jobs AS (SELECT event_id AS id, 'C' || user_id AS company, event_type AS source,
  CASE WHEN value >= 10 THEN 'valid' WHEN value >= 2 THEN 'discarded' ELSE 'reviewed' END AS outcome,
  CASE WHEN value >= 2 AND value < 10 THEN 'reason_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) ELSE '' END AS rejection_reason,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS processed_at, value AS processing_time_ms FROM events)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with presence of fields, bound to documents and labels: quality stands for salary, toxic for sponsorship."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "text", "lang", "source", "n_chars").join(l, "doc_id", "left")


POSTINGS_SQL = "postings AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of titles: the first eight words of each document."""
    d = table(spark, sf_dir, "documents")
    title = F.regexp_replace(F.regexp_extract("text", r"^\S*(?:\s+\S*){0,7}", 0), r"\s+", " ")  # the rest of a text isn't split
    return d.select("doc_id", F.col("source").alias("company"), title.alias("title"))


TITLES_SQL = r"titles AS (SELECT doc_id, source AS company, array_to_string(list_slice(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 8), ' ') AS title FROM documents)"
