"""Upserts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.functions.text import alnum_key
from tarnmill.operators import upserts
from tarnmill.operators.rollups import source_quality
from tarnmill.plans.registry import register
from tarnmill.sources.tables import JOBS_SQL, TITLES_SQL, jobs, table, titles


@register("k03_upsert_keep_last", f"WITH {JOBS_SQL}, r AS (SELECT company, source, k, row_number() OVER (PARTITION BY company ORDER BY processed_at DESC, id DESC) AS i FROM jobs) SELECT company, source, k FROM r WHERE i = 1")
def k03(spark, sf):
    j = jobs(spark, sf).select("company", "source", "k", "processed_at", "id")
    return upserts.keep_last(j.where("id % 2 = 0"), j.where("id % 2 = 1"), ["company"], ["processed_at", "id"]).select("company", "source", "k")


@register("k05_additive_upsert", f"WITH {JOBS_SQL} SELECT CAST(processed_at AS DATE) AS date, rejection_reason, count(*) AS count FROM jobs WHERE rejection_reason <> '' GROUP BY 1, 2")
def k05(spark, sf):
    j = jobs(spark, sf).where("rejection_reason <> ''").select(F.to_date("processed_at").alias("date"), "rejection_reason", "id", F.lit(1).cast("long").alias("count"))
    part = lambda r: j.where(f"id % 3 = {r}").groupBy("date", "rejection_reason").agg(F.sum("count").alias("count"))
    return upserts.add_counts(upserts.add_counts(part(0), part(1), ["date", "rejection_reason"], "count"), part(2), ["date", "rejection_reason"], "count")


@register("k06_counter_pivot", f"WITH {JOBS_SQL} SELECT company, count(*) FILTER (WHERE source = 'click') AS click, count(*) FILTER (WHERE source = 'view') AS view, max(processed_at) AS last_seen_at FROM jobs WHERE source IN ('click', 'view') GROUP BY 1")
def k06(spark, sf):
    return upserts.counters(jobs(spark, sf), "company", "source", ["click", "view"], "processed_at")


@register("k07_serial_numbers", rf"WITH {TITLES_SQL}, f AS (SELECT min(doc_id) AS doc_id FROM titles GROUP BY regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 100 AS serial FROM f")
def k07(spark, sf):
    t = titles(spark, sf).select("doc_id", alnum_key(F.col("title")).alias("key"))
    return upserts.serials(t, "key", "doc_id", start=101, bucket=300).select("doc_id", "serial")


@register("k21_insert_absent", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'new' END AS v FROM nation")
def k21(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return upserts.insert_absent(n.where("k % 2 = 0"), n.withColumn("v", F.lit("new")), ["k"])


@register("k14_source_report", f"WITH {JOBS_SQL}, s AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE outcome = 'valid') AS valid FROM jobs GROUP BY 1) SELECT string_agg(printf('%-12s %6d %6d', source, total, valid), chr(10) ORDER BY source) AS report FROM s")
def k14(spark, sf):
    return upserts.lines(source_quality(jobs(spark, sf)), F.format_string("%-12s %6d %6d", "source", "total", "valid"), ["source"])
