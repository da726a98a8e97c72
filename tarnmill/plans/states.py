"""Stateful operators over the tables, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.operators import state as s
from tarnmill.plans.registry import register
from tarnmill.sources.tables import AS_OF, JOBS_SQL, as_of, jobs, table

_BREAKER = f"""WITH RECURSIVE {JOBS_SQL}, e AS (SELECT company, epoch_us(processed_at) / 1e6 AS t, (processing_time_ms >= 30)::INT AS ok, row_number() OVER (PARTITION BY company ORDER BY processed_at, (processing_time_ms >= 30)::INT) AS i FROM jobs),
 f AS (SELECT company, 0::BIGINT AS i, 'closed' AS s, 0 AS f, 0 AS n, 0.0::DOUBLE AS since, 0 AS trips FROM (SELECT DISTINCT company FROM e)
 UNION ALL SELECT company, i, CASE WHEN st = 'open' THEN s WHEN st = 'half' THEN CASE WHEN ok = 0 THEN 'open' WHEN hn >= 2 THEN 'closed' ELSE 'half' END ELSE CASE WHEN ok = 1 THEN 'closed' WHEN f + 1 >= 5 THEN 'open' ELSE 'closed' END END,
   CASE WHEN st = 'open' THEN f WHEN st = 'half' OR ok = 1 OR f + 1 >= 5 THEN 0 ELSE f + 1 END, CASE WHEN st = 'open' THEN n WHEN st = 'half' AND ok = 1 AND hn < 2 THEN hn ELSE 0 END,
   CASE WHEN (st = 'half' AND ok = 0) OR (st = 'closed' AND ok = 0 AND f + 1 >= 5) THEN t ELSE since END, trips + CASE WHEN (st = 'half' AND ok = 0) OR (st = 'closed' AND ok = 0 AND f + 1 >= 5) THEN 1 ELSE 0 END
 FROM (SELECT f.company, e.i, f.s, f.f, f.n, f.since, f.trips, e.t, e.ok, CASE WHEN f.s = 'open' AND e.t - f.since >= 3600 THEN 'half' ELSE f.s END AS st, CASE WHEN f.s = 'half' THEN f.n ELSE 0 END + 1 AS hn FROM f JOIN e ON e.company = f.company AND e.i = f.i + 1))
 SELECT company, s AS state, f AS failures, trips FROM f QUALIFY row_number() OVER (PARTITION BY company ORDER BY i DESC) = 1"""


@register("stm06_breaker", _BREAKER)
def stm06(spark, sf):
    e = jobs(spark, sf).select("company", "processed_at", (F.col("processing_time_ms") >= 30).alias("ok"))
    return s.breaker(e, "company", "processed_at", "ok", seconds=3600)


@register("stm07_daily_breaker", f"WITH {JOBS_SQL} SELECT source, CAST(processed_at AS DATE) AS day, count(*) AS sent, count(*) FILTER (WHERE outcome = 'reviewed') AS bounced, (count(*) FILTER (WHERE outcome = 'reviewed') >= 2 AND count(*) FILTER (WHERE outcome = 'reviewed') >= 0.03 * count(*)) OR count(*) >= 120 AS tripped FROM jobs GROUP BY 1, 2")
def stm07(spark, sf):
    d = jobs(spark, sf).groupBy("source", F.to_date("processed_at").alias("day")).agg(F.count("*").alias("sent"), F.count_if(F.col("outcome") == "reviewed").alias("bounced"))
    b = F.col("bounced")
    return d.withColumn("tripped", ((b >= 2) & (b >= 0.03 * F.col("sent"))) | (F.col("sent") >= 120))


@register(
    "stm08_cooldown",
    f"WITH RECURSIVE {JOBS_SQL}, a AS (SELECT DISTINCT source, processed_at FROM jobs WHERE outcome = 'reviewed'), k AS (SELECT source, min(processed_at) AS processed_at FROM a GROUP BY 1 UNION ALL SELECT source, t FROM (SELECT k.source, min(a.processed_at) AS t FROM k JOIN a ON a.source = k.source AND a.processed_at >= k.processed_at + INTERVAL 6 HOUR GROUP BY 1, k.processed_at)) SELECT source, processed_at FROM k",
)
def stm08(spark, sf):
    return s.cooled_down(jobs(spark, sf).where("outcome = 'reviewed'").select("source", "processed_at"), "source", "processed_at", 6)


@register("stm05_retry_due", f"WITH {JOBS_SQL} SELECT id, processed_at + INTERVAL (CASE rejection_reason WHEN 'reason_0' THEN 2 WHEN 'reason_1' THEN 24 WHEN 'reason_2' THEN 12 ELSE 6 END) HOUR AS retry_at FROM jobs WHERE outcome = 'discarded' AND k % 5 < 3 AND processed_at + INTERVAL (CASE rejection_reason WHEN 'reason_0' THEN 2 WHEN 'reason_1' THEN 24 WHEN 'reason_2' THEN 12 ELSE 6 END) HOUR <= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY")
def stm05(spark, sf):
    q = jobs(spark, sf).where("outcome = 'discarded'").select("id", F.col("rejection_reason").alias("failure"), F.col("processed_at").alias("at"), (F.col("k") % 5).alias("attempts"))
    return s.retry_due(q, as_of(2), {"reason_0": 2, "reason_1": 24, "reason_2": 12}).select("id", "retry_at")


@register("stm16_failures_in_a_row", f"WITH {JOBS_SQL}, r AS (SELECT *, sum((outcome = 'valid')::INT) OVER (PARTITION BY company ORDER BY processed_at, id) AS run FROM jobs) SELECT id, CAST(sum((outcome <> 'valid')::INT) OVER (PARTITION BY company, run ORDER BY processed_at, id) AS BIGINT) AS in_a_row FROM r")
def stm16(spark, sf):
    return s.failures_in_a_row(jobs(spark, sf), "company", ["processed_at", "id"], F.col("outcome") == "valid").select("id", "in_a_row")


@register("stm18_prune", f"WITH {JOBS_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY processed_at DESC, id DESC) AS i FROM jobs WHERE processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) SELECT id FROM r WHERE i <= 100")
def stm18(spark, sf):
    return s.newest(s.within_ttl(jobs(spark, sf), "processed_at", as_of(), 7), "source", ["processed_at", "id"], 100).select("id")


@register("stm13_trust", f"WITH {JOBS_SQL} SELECT company, max_by(outcome, (processed_at, id)) AS last_outcome, max(processed_at) < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AS stale FROM jobs GROUP BY 1")
def stm13(spark, sf):
    return jobs(spark, sf).groupBy("company").agg(F.max_by("outcome", F.struct("processed_at", "id")).alias("last_outcome"), (F.max("processed_at") < as_of(3)).alias("stale"))


@register("stm02_dedup_ttl", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_orderkey FROM o WHERE p IS NULL OR p < o_orderdate - INTERVAL 90 DAY")
def stm02(spark, sf):
    """First sight of a key, or again after 90 days without it; the streaming version is in tarnmill.streaming."""
    from pyspark.sql import Window

    p = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", p.alias("p"))
    return o.where(F.col("p").isNull() | (F.col("p") < F.col("o_orderdate") - F.expr("INTERVAL 90 DAYS"))).select("o_orderkey")


@register("stm09_replay", f"WITH {JOBS_SQL} SELECT id AS tx_id, row_number() OVER (PARTITION BY source ORDER BY processed_at, id) AS turn FROM jobs WHERE outcome = 'reviewed' AND k % 5 < 3")
def stm09(spark, sf):
    t = jobs(spark, sf).select(F.col("id").alias("tx_id"), F.col("source").alias("operation"), F.when(F.col("outcome") == "reviewed", "pending").otherwise("committed").alias("status"), F.col("processed_at").alias("created_at"), (F.col("k") % 5).alias("retries"))
    return s.replay(t).select("tx_id", "turn")
