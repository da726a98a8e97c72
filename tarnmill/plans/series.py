"""Time series: process control, decay, forecasts, streaks and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.operators.control import alerts, daily_rates, fill_days, source_stats, spc_report, streaks
from tarnmill.plans.registry import register
from tarnmill.sources.tables import AS_OF, JOBS_SQL, TITLES_SQL, as_of, jobs, table, titles

RATES = f"""{JOBS_SQL}, rates AS (SELECT source, CAST(processed_at AS DATE) AS day, count(*) AS volume, 100.0 * count(*) FILTER (WHERE outcome = 'valid') / count(*) AS rate
  FROM jobs WHERE source NOT IN ('', 'Unknown') AND processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2)"""
_STATS = """stats0 AS (SELECT source, avg(rate) AS mean, coalesce(stddev_samp(rate), 0) AS std, count(*) AS days, CAST(sum(volume) AS BIGINT) AS total_volume, max_by(rate, day) AS current, max_by(volume, day) AS current_volume,
  list(rate ORDER BY day DESC)[2] AS previous, list(rate ORDER BY day DESC)[3] AS before_previous FROM rates GROUP BY 1 HAVING count(*) >= 3),
  stats AS (SELECT *, CASE WHEN std > 0 THEN (current - mean) / std ELSE 0 END AS z, mean + 2 * std AS ucl, greatest(0, mean - 2 * std) AS lcl FROM stats0)"""
_SPC = "SELECT source, round(mean, 1) AS mean_rate, round(std, 1) AS std, round(current, 1) AS current_rate, round(z, 2) AS z_score, round(ucl, 1) AS ucl, round(lcl, 1) AS lcl, days AS days_tracked, total_volume, CASE WHEN z < -2.5 THEN 'critical' WHEN z < -2 THEN 'warning' WHEN current < lcl THEN 'degraded' ELSE 'healthy' END AS status FROM stats"
_ALERTS = """SELECT * FROM (SELECT source, CASE WHEN current_volume = 0 THEN 'outage' WHEN z < -2 THEN 'degradation' WHEN current < lcl AND std > 0 THEN 'anomaly' END AS alert_type,
  CASE WHEN current_volume = 0 THEN 'critical' WHEN z < -2 THEN 'warning' ELSE 'info' END AS severity, round(current, 2) AS current_rate, round(mean, 2) AS baseline_rate,
  CASE WHEN current_volume = 0 THEN 0 WHEN z < -2 THEN 1 ELSE 2 END AS rank FROM stats
  UNION ALL SELECT source, 'recovery', 'info', round(current, 2), round(mean, 2), 2 FROM stats WHERE previous < lcl AND before_previous < lcl AND current >= mean) WHERE alert_type IS NOT NULL"""


def _rates(spark, sf):
    return daily_rates(jobs(spark, sf).where(F.col("processed_at") >= as_of(30)))


def _company_jobs(spark, sf):
    """The same facts with a company for source: many more series, so that alerts occur."""
    return jobs(spark, sf).withColumn("source", F.col("company"))


@register("w01_source_stats", f"WITH {RATES}, {_STATS} SELECT source, round(mean, 6) AS mean, round(std, 6) AS std, days, round(current, 6) AS current, round(z, 6) AS z FROM stats")
def w01(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return source_stats(_rates(spark, sf)).select("source", r("mean"), r("std"), "days", r("current"), r("z"))


@register("w03_alerts", f"WITH {RATES.replace('event_type AS source', chr(39) + 'C' + chr(39) + ' || user_id AS source')}, {_STATS} {_ALERTS}")
def w03(spark, sf):
    found = alerts(source_stats(daily_rates(_company_jobs(spark, sf).where(F.col("processed_at") >= as_of(30)))))
    return found.orderBy("rank", "source", "alert_type")


@register("w04_spc_report", f"WITH {RATES}, {_STATS} {_SPC}")
def w04(spark, sf):
    return spc_report(source_stats(_rates(spark, sf))).orderBy(F.desc("mean_rate"), "source")


@register(
    "w04_spc_lineitem",
    f"WITH rates AS (SELECT l_returnflag || l_linestatus AS source, CAST(l_shipdate AS DATE) AS day, count(*) AS volume, 100.0 * count(*) FILTER (WHERE l_discount >= 0.05) / count(*) AS rate FROM lineitem GROUP BY 1, 2), {_STATS} {_SPC}",
)
def w04_lineitem(spark, sf):
    l = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("source"), F.col("l_shipdate").alias("processed_at"), F.when(F.col("l_discount") >= 0.05, "valid").alias("outcome"))
    return spc_report(source_stats(daily_rates(l)))


@register(
    "w04_spc_filled",
    f"WITH {RATES.replace('event_type AS source', chr(39) + 'C' + chr(39) + ' || user_id AS source').replace('rates AS', 'known AS')}, span AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM known), rates AS (SELECT s.source, d.day, coalesce(k.volume, 0) AS volume, coalesce(k.rate, 0) AS rate FROM (SELECT DISTINCT source FROM known) s CROSS JOIN span d LEFT JOIN known k ON k.source = s.source AND k.day = d.day), {_STATS} {_ALERTS}",
)
def w04_filled(spark, sf):
    """Alerts with days without postings counted, so that outages show."""
    return alerts(source_stats(fill_days(daily_rates(_company_jobs(spark, sf).where(F.col("processed_at") >= as_of(30))))))


@register("w05_trend_data", f"WITH {RATES} SELECT day AS date, volume AS total, round(rate, 1) AS rate FROM rates WHERE source = 'click' AND day >= DATE '{AS_OF}' - 14")
def w05(spark, sf):
    return _rates(spark, sf).where((F.col("source") == "click") & (F.col("day") >= F.date_sub(F.lit(AS_OF).cast("date"), 14))).select(F.col("day").alias("date"), F.col("volume").alias("total"), F.round("rate", 1).alias("rate"))


@register(
    "a32_source_health",
    f"WITH {RATES}, x AS (SELECT source, day, volume, avg(volume) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i, count(*) OVER (PARTITION BY source) AS n FROM rates) SELECT source, volume, round(baseline, 2) AS baseline, CASE WHEN n < 3 THEN 'UNKNOWN' WHEN volume = 0 AND baseline >= 10 THEN 'DOWN' WHEN volume < 0.2 * baseline THEN 'DEGRADED' ELSE 'OK' END AS state FROM x WHERE i = 1",
)
def a32(spark, sf):
    w = Window.partitionBy("source")
    x = _rates(spark, sf).withColumns({"baseline": F.avg("volume").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), "i": F.row_number().over(w.orderBy(F.desc("day"))), "n": F.count("*").over(w)})
    state = F.when(F.col("n") < 3, "UNKNOWN").when((F.col("volume") == 0) & (F.col("baseline") >= 10), "DOWN").when(F.col("volume") < 0.2 * F.col("baseline"), "DEGRADED").otherwise("OK")
    return x.where("i = 1").select("source", "volume", F.round("baseline", 2).alias("baseline"), state.alias("state"))


@register(
    "w12_decay",
    f"WITH {RATES}, x AS (SELECT source, day, avg(rate) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent, sum(rate * volume) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING) AS lifetime FROM rates) SELECT source, day, round(recent, 4) AS recent, round(lifetime, 4) AS lifetime, recent < 0.5 * lifetime AS decayed FROM x",
)
def w12(spark, sf):
    w = Window.partitionBy("source").orderBy("day")
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    x = _rates(spark, sf).select("source", "day", F.avg("rate").over(w.rowsBetween(-6, 0)).alias("recent"), (F.sum(F.col("rate") * F.col("volume")).over(ever) / F.sum("volume").over(ever)).alias("lifetime"))
    return x.select("source", "day", F.round("recent", 4).alias("recent"), F.round("lifetime", 4).alias("lifetime"), (F.col("recent") < 0.5 * F.col("lifetime")).alias("decayed"))


@register(
    "w13_burn_rate",
    f"WITH {RATES}, x AS (SELECT source, day, volume, avg(volume) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS burn, sum(volume) OVER (PARTITION BY source, date_trunc('month', day) ORDER BY day) AS used, count(*) OVER (PARTITION BY source ORDER BY day) AS n FROM rates) SELECT source, day, round(burn, 3) AS burn, CAST(used AS BIGINT) AS used, round((2500 - used) / burn, 2) AS days_left, n >= 3 AND (2500 - used) / burn < date_diff('day', day, last_day(day)) - 2 AS alert FROM x",
)
def w13(spark, sf):
    w = Window.partitionBy("source").orderBy("day")
    month = Window.partitionBy("source", F.trunc("day", "month")).orderBy("day")
    x = _rates(spark, sf).select("source", "day", F.avg("volume").over(w.rowsBetween(-6, 0)).alias("burn"), F.sum("volume").over(month).alias("used"), F.count("*").over(w).alias("n"))
    left = (F.lit(2500) - F.col("used")) / F.col("burn")
    return x.select("source", "day", F.round("burn", 3).alias("burn"), "used", F.round(left, 2).alias("days_left"), ((F.col("n") >= 3) & (left < F.datediff(F.last_day("day"), "day") - 2)).alias("alert"))


@register(
    "a31_streaks",
    f"WITH {JOBS_SQL}, d AS (SELECT DISTINCT company, CAST(processed_at AS DATE) AS day FROM jobs), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY company ORDER BY day) AS INTEGER) AS island FROM d) SELECT company, min(day) AS start, count(*) AS length FROM i GROUP BY company, island",
)
def a31(spark, sf):
    return streaks(jobs(spark, sf).select("company", F.to_date("processed_at").alias("day")).distinct(), ["company"], "day")


@register(
    "a31_cumulative_metrics",
    f"WITH {RATES}, d AS (SELECT day, CAST(sum(volume) AS BIGINT) AS n, sum(rate * volume / 100) AS v FROM rates GROUP BY 1) SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total, round(sum(v) OVER (ORDER BY day) / sum(n) OVER (ORDER BY day), 4) AS accuracy, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 3) AS mean_30 FROM d",
)
def a31_metrics(spark, sf):
    d = _rates(spark, sf).groupBy("day").agg(F.sum("volume").alias("n"), F.sum(F.col("rate") * F.col("volume") / 100).alias("v"))
    w = Window.orderBy("day")  # a row a day
    return d.select("day", F.sum("n").over(w).alias("total"), F.round(F.sum("v").over(w) / F.sum("n").over(w), 4).alias("accuracy"), F.round(F.avg("n").over(w.rowsBetween(-29, 0)), 3).alias("mean_30"))


@register(
    "w07_row_shift",
    rf"WITH {TITLES_SQL}, t AS (SELECT doc_id, split_part(title, ' ', 1) AS w FROM titles), x AS (SELECT doc_id, w, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, lead(w) OVER o AS n1 FROM t WINDOW o AS (PARTITION BY doc_id // 1000 ORDER BY doc_id)) SELECT doc_id, w AS title FROM x WHERE w <> '' AND ((w = p1 AND w = p2) OR (w = p1 AND w = n1))",
)
def w07(spark, sf):
    """Rows whose title repeats over three rows in order, but for the first of them; order is within blocks of ids."""
    o = Window.partitionBy(F.expr("doc_id div 1000")).orderBy("doc_id")
    w = F.col("w")
    x = titles(spark, sf).select("doc_id", F.substring_index("title", " ", 1).alias("w")).withColumns({"p1": F.lag("w").over(o), "p2": F.lag("w", 2).over(o), "n1": F.lead("w").over(o)})
    return x.where((w != "") & (((w == F.col("p1")) & (w == F.col("p2"))) | ((w == F.col("p1")) & (w == F.col("n1"))))).select("doc_id", w.alias("title"))


@register(
    "w11_forward_fill",
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CASE WHEN l_quantity < 25 THEN l_partkey END AS part FROM lineitem) SELECT l_orderkey, l_linenumber, last_value(part IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS part FROM l",
)
def w11(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.when(F.col("l_quantity") < 25, F.col("l_partkey")).alias("part"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return l.select("l_orderkey", "l_linenumber", F.last("part", ignorenulls=True).over(w).alias("part"))


@register(
    "w14_ema",
    f"WITH {JOBS_SQL}, o AS (SELECT source, list(CASE WHEN outcome = 'valid' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY processed_at, id) AS hits FROM jobs GROUP BY 1) SELECT source, list_reduce(list_prepend(0.5::DOUBLE, hits), lambda g, h: round(g * 0.95 + 0.05 * h, 4)) AS ema FROM o",
)
def w14(spark, sf):
    """Exponential mean of success, rounded at every event: an ordered fold."""
    hits = F.sort_array(F.collect_list(F.struct("processed_at", "id", (F.col("outcome") == "valid").cast("double").alias("hit"))))
    return jobs(spark, sf).groupBy("source").agg(hits.alias("hits")).select("source", F.aggregate("hits", F.lit(0.5), lambda g, e: F.round(g * 0.95 + F.lit(0.05) * e["hit"], 4)).alias("ema"))


@register(
    "w15_velocity",
    f"WITH {JOBS_SQL}, r AS (SELECT company, id, processed_at, rejection_reason, row_number() OVER (PARTITION BY company ORDER BY processed_at DESC, id DESC) AS i FROM jobs WHERE rejection_reason <> ''), t AS (SELECT company, count(*) AS total, count(*) FILTER (WHERE i <= 20 AND processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) AS recent FROM r GROUP BY 1), m AS (SELECT company, max(n) AS top FROM (SELECT company, rejection_reason, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT company, total, recent, top, (recent >= 3 AND top >= 3) OR total >= 15 AS block FROM t JOIN m USING (company)",
)
def w15(spark, sf):
    """Rejections of a company among its last 20 that are recent, its commonest reason, and whether both are many."""
    r = jobs(spark, sf).where("rejection_reason <> ''")
    last = F.slice(F.sort_array(F.collect_list("processed_at"), asc=False), 1, 20)
    t = r.groupBy("company").agg(F.count("*").alias("total"), F.size(F.filter(last, lambda x: x >= as_of(10))).cast("long").alias("recent"))
    m = r.groupBy("company", "rejection_reason").agg(F.count("*").alias("n")).groupBy("company").agg(F.max("n").alias("top"))
    return t.join(m, "company").select("company", "total", "recent", "top", (((F.col("recent") >= 3) & (F.col("top") >= 3)) | (F.col("total") >= 15)).alias("block"))


@register("w17_zero_runs", f"WITH {RATES}, x AS (SELECT source, day, rate, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i FROM rates) SELECT source, bool_and(rate = 0) AS three_zero_runs FROM x WHERE i <= 3 GROUP BY 1")
def w17(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("day"))
    return _rates(spark, sf).withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("source").agg(F.bool_and(F.col("rate") == 0).alias("three_zero_runs"))


@register("w18_staleness", f"WITH {JOBS_SQL} SELECT company, max(processed_at) AS last_at, date_diff('second', max(processed_at), TIMESTAMP '{AS_OF}') > 3600 * CASE company WHEN 'C1' THEN 6 WHEN 'C2' THEN 48 ELSE 30 END AS stale FROM jobs GROUP BY 1")
def w18(spark, sf):
    gaps = F.when(F.col("company") == "C1", 6).when(F.col("company") == "C2", 48).otherwise(30)
    last = jobs(spark, sf).groupBy("company").agg(F.max("processed_at").alias("last_at"))
    return last.select("company", "last_at", (F.timestamp_diff("SECOND", F.col("last_at"), as_of()) > 3600 * gaps).alias("stale"))


@register("w19_monthly_reset", f"WITH {JOBS_SQL} SELECT id, source, row_number() OVER (PARTITION BY source, date_trunc('month', processed_at) ORDER BY processed_at, id) AS used_this_month FROM jobs")
def w19(spark, sf):
    w = Window.partitionBy("source", F.date_format("processed_at", "yyyy-MM")).orderBy("processed_at", "id")
    return jobs(spark, sf).select("id", "source", F.row_number().over(w).alias("used_this_month"))
