"""Reports over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.operators.rollups import indexed_percentiles, outcome_counts, pct, share_of, source_quality, weekly
from tarnmill.plans.registry import register
from tarnmill.sources.tables import AS_OF, JOBS_SQL, POSTINGS_SQL, TITLES_SQL, as_of, jobs, postings, table, titles

V = "count(*) FILTER (WHERE outcome = 'valid')"
D = "count(*) FILTER (WHERE outcome = 'discarded')"


def since(days: int) -> str:
    return f"processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


@register("a01_total_jobs", f"WITH {JOBS_SQL} SELECT coalesce(outcome, 'all') AS outcome, count(*) AS n FROM jobs GROUP BY GROUPING SETS ((), (outcome))")
def total_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs(spark, sf).rollup("outcome").agg(F.count("*").alias("n")).withColumn("outcome", F.coalesce("outcome", F.lit("all")))


@register("a02_source_quality", f"WITH {JOBS_SQL} SELECT source, count(*) AS total, {V} AS valid, {D} AS discarded, round(avg(processing_time_ms), 1) AS avg_ms, round(100.0 * {V} / count(*), 1) AS valid_pct FROM jobs WHERE {since(30)} GROUP BY source")
def source_quality_report(spark, sf):
    return source_quality(jobs(spark, sf).where(F.col("processed_at") >= as_of(30))).orderBy(F.desc("valid_pct"), "source")


@register("a03_rejection_funnel", f"WITH {JOBS_SQL}, r AS (SELECT * FROM jobs WHERE outcome = 'discarded' AND {since(7)}) SELECT rejection_reason, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS pct FROM r WHERE rejection_reason <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def rejection_funnel(spark, sf):
    recent = jobs(spark, sf).where((F.col("outcome") == "discarded") & (F.col("processed_at") >= as_of(7)))
    return share_of(recent.where("rejection_reason <> ''"), "rejection_reason", recent, 20)


@register("a04_company_stats", f"WITH {JOBS_SQL} SELECT company, count(*) AS total_seen, {V} AS valid, {D} AS discarded FROM jobs GROUP BY 1 HAVING count(*) >= 2 ORDER BY valid DESC, company LIMIT 50")
def company_stats(spark, sf):
    counted = jobs(spark, sf).groupBy("company").agg(*outcome_counts()).withColumnRenamed("total", "total_seen")
    return counted.where("total_seen >= 2").orderBy(F.desc("valid"), "company").limit(50)


@register("a05_location_distribution", "WITH c AS (SELECT n.n_name AS location_state FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c_acctbal >= 0) SELECT location_state, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM c), 1) AS pct FROM c WHERE location_state <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def location_distribution(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("location_state"))
    valid = table(spark, sf, "customer").where("c_acctbal >= 0").join(nation, "c_nationkey", "left")
    return share_of(valid.where("location_state <> ''"), "location_state", valid, 15)


@register("a06_resume_types", f"WITH {POSTINGS_SQL}, v AS (SELECT CASE WHEN quality = 1 THEN 'SDE' WHEN quality = 0 THEN 'ML' ELSE 'DA' END AS resume_type FROM postings WHERE lang = 'en') SELECT resume_type, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM v), 1) AS pct FROM v GROUP BY 1")
def resume_types(spark, sf):
    valid = postings(spark, sf).where("lang = 'en'").withColumn("resume_type", F.when(F.col("quality") == 1, "SDE").when(F.col("quality") == 0, "ML").otherwise("DA"))
    return share_of(valid, "resume_type", valid)


@register("a07_daily_trend", f"WITH {JOBS_SQL} SELECT CAST(processed_at AS DATE) AS date, {V} AS valid, {D} AS discarded, count(*) AS total FROM jobs WHERE {since(14)} GROUP BY 1")
def daily_trend(spark, sf):
    recent = jobs(spark, sf).where(F.col("processed_at") >= as_of(14))
    return recent.groupBy(F.to_date("processed_at").alias("date")).agg(*outcome_counts()).orderBy("date")


@register("a07_daily_trend_lineitem", "SELECT CAST(l_shipdate AS DATE) AS date, count(*) FILTER (WHERE l_returnflag = 'N') AS valid, count(*) FILTER (WHERE l_returnflag = 'R') AS discarded, count(*) AS total FROM lineitem GROUP BY 1")
def daily_trend_lineitem(spark, sf):
    l = table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag")
    return l.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count_if(F.col("l_returnflag") == "N").alias("valid"), F.count_if(F.col("l_returnflag") == "R").alias("discarded"), F.count("*").alias("total"))


def _percentiles_sql(rows: str, value: str) -> str:
    return f"WITH {rows}, o AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n FROM r WHERE {value} > 0) SELECT coalesce(max(v) FILTER (WHERE i = floor(n * 0.5)), 0) AS p50, coalesce(max(v) FILTER (WHERE i = floor(n * 0.9)), 0) AS p90, coalesce(max(v) FILTER (WHERE i = CASE WHEN n > 100 THEN floor(n * 0.99) ELSE n - 1 END), 0) AS p99, count(*) AS count FROM o"


POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@register("a08_latency_percentiles", _percentiles_sql(f"{JOBS_SQL}, r AS (SELECT * FROM jobs WHERE {since(7)})", "processing_time_ms"))
def latency_percentiles(spark, sf):
    return indexed_percentiles(jobs(spark, sf).where(F.col("processed_at") >= as_of(7)), "processing_time_ms", POINTS)


@register("a08_price_percentiles", _percentiles_sql("r AS (SELECT * FROM lineitem)", "l_extendedprice"))
def price_percentiles(spark, sf):
    return indexed_percentiles(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", POINTS)


@register(
    "a09_feature_vector",
    f"""WITH {JOBS_SQL}, c AS (SELECT company, count(*) AS n, {V} AS v FROM jobs GROUP BY 1), s AS (SELECT source, count(*) AS n, {V} AS v FROM jobs GROUP BY 1),
    l AS (SELECT k, {V} AS v FROM jobs GROUP BY 1)
    SELECT j.id, c.n AS company_times_seen, c.v / c.n::DOUBLE AS company_valid_rate, s.v / s.n::DOUBLE AS source_valid_rate, coalesce(l.v, 0) AS location_job_density,
    length(j.source) AS title_length, CAST(contains(lower(j.source), 'ai') OR contains(lower(j.source), 'ml') AS INTEGER) AS has_ai_ml, CAST(contains(lower(j.source), 'click') OR contains(lower(j.source), 'sde') AS INTEGER) AS has_sde
    FROM jobs j JOIN c USING (company) JOIN s USING (source) LEFT JOIN l USING (k)""",
)
def feature_vector(spark, sf):
    """History of the company, the source and the place of each posting, with keyword flags by substring."""
    j = jobs(spark, sf)
    valid = F.count_if(F.col("outcome") == "valid")
    company = j.groupBy("company").agg(F.count("*").alias("company_times_seen"), (valid / F.count("*")).alias("company_valid_rate"))
    source = j.groupBy("source").agg((valid / F.count("*")).alias("source_valid_rate"))
    place = j.groupBy("k").agg(valid.alias("location_job_density"))
    title = F.lower("source")
    flag = lambda *words: F.greatest(*[F.contains(title, F.lit(w)).cast("int") for w in words])
    out = j.join(company, "company").join(source, "source").join(place, "k", "left")
    return out.select("id", "company_times_seen", "company_valid_rate", "source_valid_rate", F.coalesce("location_job_density", F.lit(0)).alias("location_job_density"), F.length("source").alias("title_length"), flag("ai", "ml").alias("has_ai_ml"), flag("click", "sde").alias("has_sde"))


@register("a10_summary_bundle", f"WITH {JOBS_SQL} SELECT CASE WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(outcome) = 0 THEN 'outcome' WHEN GROUPING(rejection_reason) = 0 THEN 'reason' ELSE 'all' END AS part, coalesce(source, outcome, rejection_reason, '') AS value, count(*) AS n, count(DISTINCT company) AS companies FROM jobs GROUP BY GROUPING SETS ((), (source), (outcome), (rejection_reason))")
def summary_bundle(spark, sf):
    """Counts of the summary in one pass over the fact table."""
    grouped = jobs(spark, sf).groupingSets([[], [F.col("source")], [F.col("outcome")], [F.col("rejection_reason")]], "source", "outcome", "rejection_reason")
    part = F.when(F.grouping("source") == 0, "source").when(F.grouping("outcome") == 0, "outcome").when(F.grouping("rejection_reason") == 0, "reason").otherwise("all")
    return grouped.agg(part.alias("part"), F.count("*").alias("n"), F.countDistinct("company").alias("companies")).select("part", F.coalesce("source", "outcome", "rejection_reason", F.lit("")).alias("value"), "n", "companies")


PRESENT = {"location": "lang IS NOT NULL AND lang <> 'es'", "job_id": "n_chars > 500", "salary": "quality IS NOT NULL", "sponsorship": "toxic IS NOT NULL", "remote": "n_chars % 2 = 0"}


@register(
    "a11_quality_by_source",
    f"WITH {POSTINGS_SQL}, c AS (SELECT source, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE {e}) AS {c}' for c, e in PRESENT.items())} FROM postings GROUP BY 1 HAVING count(*) >= 5) SELECT source, total, {', '.join(f'round(100.0 * {c} / total, 1) AS {c}_pct' for c in PRESENT)}, round(100.0 * ({' + '.join(PRESENT)}) / (5 * total), 1) AS avg_completeness FROM c",
)
def quality_by_source(spark, sf):
    counted = postings(spark, sf).groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.expr(e)).alias(c) for c, e in PRESENT.items()]).where("total >= 5")
    every = F.expr(" + ".join(PRESENT))
    return counted.select("source", "total", *[pct(F.col(c), F.col("total")).alias(f"{c}_pct") for c in PRESENT], pct(every, F.col("total") * 5).alias("avg_completeness")).orderBy(F.desc("avg_completeness"), F.desc("total"), "source")


@register("a13_value_counts", "SELECT 'priority' AS kind, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'segment' AS kind, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 ORDER BY n DESC, value LIMIT 3)")
def value_counts(spark, sf):
    count = lambda df, kind, key: df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    top = count(table(spark, sf, "customer"), "segment", "c_mktsegment").orderBy(F.desc("n"), "value").limit(3)
    return count(table(spark, sf, "orders"), "priority", "o_orderpriority").unionByName(top)


@register("a14_distinct_companies", f"WITH {JOBS_SQL} SELECT source, count(DISTINCT company) AS companies FROM jobs GROUP BY 1")
def distinct_companies(spark, sf):
    return jobs(spark, sf).groupBy("source").agg(F.countDistinct("company").alias("companies"))


@register("a15_monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%b %Y') AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def monthly_counts(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "MMM yyyy").alias("label")).agg(F.count("*").alias("n"))


@register(
    "a16_weekly_cumulative",
    "WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_ending, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT CAST(unnest(generate_series(min(week_ending), max(week_ending), INTERVAL 7 DAY)) AS DATE) AS week_ending FROM w) SELECT c.week_ending, coalesce(w.n, 0) AS n, CAST(sum(coalesce(w.n, 0)) OVER (ORDER BY c.week_ending) AS BIGINT) AS cumulative FROM c LEFT JOIN w USING (week_ending)",
)
def weekly_cumulative(spark, sf):
    return weekly(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@register("a17_cell_counts", "SELECT role, count(*) AS n, count(*) FILTER (WHERE contains(text, '?')) AS questions, count(*) FILTER (WHERE contains(text, '@')) AS addresses, count(*) FILTER (WHERE length(text) > 20) AS filled FROM conversations GROUP BY 1")
def cell_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"), F.count_if(F.contains("text", F.lit("@"))).alias("addresses"), F.count_if(F.length("text") > 20).alias("filled"))


@register("a18_month_span", "SELECT o_orderstatus AS status, greatest(1, (year(max(o_orderdate)) * 12 + month(max(o_orderdate))) - (year(min(o_orderdate)) * 12 + month(min(o_orderdate)))) AS months FROM orders GROUP BY 1")
def month_span(spark, sf):
    months = lambda c: F.year(c) * 12 + F.month(c)
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.greatest(F.lit(1), months(F.max("o_orderdate")) - months(F.min("o_orderdate"))).alias("months"))


@register("a19_conversion_funnel", f"WITH {JOBS_SQL}, t AS (SELECT count(*) AS a, {V} AS b, count(*) FILTER (WHERE outcome = 'valid' AND processing_time_ms >= 50) AS c, count(*) FILTER (WHERE outcome = 'valid' AND processing_time_ms >= 200) AS d, count(*) FILTER (WHERE processing_time_ms >= 100000) AS e FROM jobs) SELECT * FROM (SELECT 1 AS step, 'seen' AS stage, a AS n FROM t UNION ALL SELECT 2, 'valid', b FROM t UNION ALL SELECT 3, 'applied', c FROM t UNION ALL SELECT 4, 'interview', d FROM t UNION ALL SELECT 5, 'offer', e FROM t) WHERE n > 0")
def conversion_funnel(spark, sf):
    valid, ms = F.col("outcome") == "valid", F.col("processing_time_ms")
    t = jobs(spark, sf).agg(F.count("*").alias("a"), F.count_if(valid).alias("b"), F.count_if(valid & (ms >= 50)).alias("c"), F.count_if(valid & (ms >= 200)).alias("d"), F.count_if(ms >= 100000).alias("e"))
    return t.selectExpr("stack(5, 1, 'seen', a, 2, 'valid', b, 3, 'applied', c, 4, 'interview', d, 5, 'offer', e) AS (step, stage, n)").where("n > 0")


@register(
    "a20_blacklist_candidates",
    f"WITH {JOBS_SQL}, c AS (SELECT company, left(split_part(rejection_reason, '(', 1), 60) AS reason, count(*) AS n, min(id) AS first FROM jobs WHERE rejection_reason <> '' GROUP BY 1, 2 HAVING count(*) >= 3), f AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY first) AS r FROM c) SELECT company, reason, n FROM f WHERE r = 1 AND company NOT IN (SELECT company FROM jobs WHERE outcome = 'valid' AND processing_time_ms >= 300)",
)
def blacklist_candidates(spark, sf):
    """First reason that a company was rejected for three times, unless it is on the never list."""
    j = jobs(spark, sf)
    counted = j.where("rejection_reason <> ''").groupBy("company", F.substring(F.substring_index("rejection_reason", "(", 1), 1, 60).alias("reason")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n >= 3")
    firsts = counted.groupBy("company").agg(F.min_by(F.struct("reason", "n"), "first").alias("x")).select("company", "x.*")
    never = j.where("outcome = 'valid' and processing_time_ms >= 300").select("company").distinct()
    return firsts.join(never, "company", "left_anti")


@register(
    "a21_blacklist_review",
    f"WITH {JOBS_SQL}, c AS (SELECT company, rejection_reason AS reason, count(*) AS n FROM jobs WHERE rejection_reason <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, reason) AS i, sum(n) OVER (PARTITION BY company) AS total FROM c) SELECT company, reason AS top_reason, n AS top_count, CAST(total AS BIGINT) AS total, CASE WHEN reason IN ('reason_0', 'reason_1') THEN 'structural' ELSE 'pending' END AS kind, n * 2 < total AS mixed FROM r WHERE i = 1",
)
def blacklist_review(spark, sf):
    counted = jobs(spark, sf).where("rejection_reason <> ''").groupBy("company", F.col("rejection_reason").alias("reason")).agg(F.count("*").alias("n"))
    best = counted.groupBy("company").agg(F.min(F.struct((-F.col("n")).alias("m"), "reason")).alias("x"), F.sum("n").alias("total"))
    top = -F.col("x.m")
    return best.select("company", F.col("x.reason").alias("top_reason"), top.alias("top_count"), "total", F.when(F.col("x.reason").isin("reason_0", "reason_1"), "structural").otherwise("pending").alias("kind"), (top * 2 < F.col("total")).alias("mixed"))


@register("a22_error_patterns", f"WITH {JOBS_SQL} SELECT rejection_reason AS pattern, count(*) AS n FROM jobs WHERE rejection_reason <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def error_patterns(spark, sf):
    return jobs(spark, sf).where("rejection_reason <> ''").groupBy(F.col("rejection_reason").alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(10)


@register("a24_intelligence", f"WITH {JOBS_SQL} SELECT count(DISTINCT company) AS companies, count(DISTINCT source) AS sources, count(DISTINCT k) AS ids, {V} AS accepted, count(*) FILTER (WHERE rejection_reason <> '') AS rejected, round(avg(processing_time_ms), 2) AS avg_ms, max(processed_at) AS last_seen FROM jobs")
def intelligence(spark, sf):
    return jobs(spark, sf).agg(F.countDistinct("company").alias("companies"), F.countDistinct("source").alias("sources"), F.countDistinct("k").alias("ids"), F.count_if(F.col("outcome") == "valid").alias("accepted"), F.count_if(F.col("rejection_reason") != "").alias("rejected"), F.round(F.avg("processing_time_ms"), 2).alias("avg_ms"), F.max("processed_at").alias("last_seen"))


@register("a25_worst_sources", f"WITH {JOBS_SQL} SELECT source, {V} / greatest(1, {V} + {D})::DOUBLE AS quality_ratio FROM jobs GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def worst_sources(spark, sf):
    counted = jobs(spark, sf).groupBy("source").agg(*outcome_counts())
    return counted.select("source", (F.col("valid") / F.greatest(F.lit(1), F.col("valid") + F.col("discarded"))).alias("quality_ratio")).orderBy("quality_ratio", "source").limit(3)


@register("a27_seven_day_sources", f"WITH {JOBS_SQL} SELECT source, {V} AS valid, {D} AS rejected, CAST(floor({V} * 100 / greatest({V} + {D}, 1)::DOUBLE) AS BIGINT) AS pct, count(DISTINCT CAST(processed_at AS DATE)) AS records FROM jobs WHERE {since(7)} GROUP BY 1")
def seven_day_sources(spark, sf):
    recent = jobs(spark, sf).where(F.col("processed_at") >= as_of(7))
    counted = recent.groupBy("source").agg(*outcome_counts(), F.countDistinct(F.to_date("processed_at")).alias("records"))
    return counted.select("source", "valid", F.col("discarded").alias("rejected"), F.floor(F.col("valid") * 100 / F.greatest(F.col("valid") + F.col("discarded"), F.lit(1))).alias("pct"), "records")


@register("a28_best_order", f"WITH {JOBS_SQL}, c AS (SELECT source AS api, round({V} / nullif(count(*), 0)::DOUBLE, 3) AS value_per_credit, min(id) AS ord FROM jobs GROUP BY 1) SELECT api, value_per_credit, row_number() OVER (ORDER BY value_per_credit DESC, ord) AS place FROM c")
def best_order(spark, sf):
    """Sources by value for each credit; equal ones keep their default order. A row for each source: one window."""
    c = jobs(spark, sf).groupBy(F.col("source").alias("api")).agg(F.round(F.try_divide(F.count_if(F.col("outcome") == "valid"), F.count("*")), 3).alias("value_per_credit"), F.min("id").alias("ord"))
    return c.select("api", "value_per_credit", F.row_number().over(Window.orderBy(F.desc("value_per_credit"), "ord")).alias("place"))


@register("a29_reason_counts", "WITH r AS (SELECT left(trim(split_part(split_part(text, '.', 1), ',', 1)), 40) AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def reason_counts(spark, sf):
    reason = F.substring(F.trim(F.substring_index(F.substring_index("text", ".", 1), ",", 1)), 1, 40)
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@register("a33_domain_rollup", r"WITH d AS (SELECT regexp_extract(url, '^https?://(?:www[.])?([^/?#]+)', 1) AS domain FROM pages) SELECT domain, count(*) AS n, -30 * count(*) AS score, count(*) >= 5 AS blocked FROM d GROUP BY 1")
def domain_rollup(spark, sf):
    domain = F.regexp_extract("url", r"^https?://(?:www[.])?([^/?#]+)", 1)
    return table(spark, sf, "pages").groupBy(domain.alias("domain")).agg(F.count("*").alias("n")).select("domain", "n", (F.lit(-30) * F.col("n")).alias("score"), (F.col("n") >= 5).alias("blocked"))


@register("a34_mode_vote", f"WITH {JOBS_SQL}, c AS (SELECT company, source, count(*) AS n, min(id) AS first FROM jobs WHERE source <> 'Unknown' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, first) AS i FROM c) SELECT company, source AS voted, n FROM r WHERE i = 1")
def mode_vote(spark, sf):
    """Most common value of each group; ties go to the one seen first."""
    c = jobs(spark, sf).where("source <> 'Unknown'").groupBy("company", "source").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return c.groupBy("company").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "source")).alias("x")).select("company", F.col("x.source").alias("voted"), (-F.col("x.m")).alias("n"))


@register("a35_word_preferences", rf"WITH {TITLES_SQL}, w AS (SELECT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS word FROM titles) SELECT word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1 HAVING count(*) >= 3")
def word_preferences(spark, sf):
    words = titles(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") > 2).groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")


@register("a37_issue_stats", f"WITH {JOBS_SQL}, l AS (SELECT * FROM jobs ORDER BY id DESC LIMIT 500) SELECT outcome AS issue, count(*) AS n FROM l GROUP BY 1")
def issue_stats(spark, sf):
    return jobs(spark, sf).orderBy(F.desc("id")).limit(500).groupBy(F.col("outcome").alias("issue")).agg(F.count("*").alias("n"))


@register("a38_api_value", f"WITH {JOBS_SQL} SELECT source AS api, strftime(processed_at, '%Y-%m') AS month, count(*) AS calls, {V} AS found, round({V} / nullif(count(*), 0)::DOUBLE, 3) AS value_per_credit FROM jobs GROUP BY 1, 2")
def api_value(spark, sf):
    return jobs(spark, sf).groupBy(F.col("source").alias("api"), F.date_format("processed_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "valid").alias("found"), F.round(F.try_divide(F.count_if(F.col("outcome") == "valid"), F.count("*")), 3).alias("value_per_credit"))


@register("a39_run_summary", f"WITH {JOBS_SQL} SELECT source, {V} AS valid, {D} AS discarded, count(*) FILTER (WHERE outcome = 'reviewed') AS reviewed FROM jobs GROUP BY 1")
def run_summary(spark, sf):
    return jobs(spark, sf).groupBy("source").pivot("outcome", ["valid", "discarded", "reviewed"]).agg(F.count("id")).na.fill(0)


@register("a40_metrics_summary", f"WITH {JOBS_SQL} SELECT count(*) AS total, {V} AS valid, round({V} / count(*)::DOUBLE, 4) AS accuracy, round(100.0 * {V} / count(*), 1) AS pct FROM jobs")
def metrics_summary(spark, sf):
    c = jobs(spark, sf).agg(*outcome_counts())
    return c.select("total", "valid", F.round(F.try_divide("valid", "total"), 4).alias("accuracy"), pct(F.col("valid"), F.col("total")).alias("pct"))


@register("a42_recent_counts", f"WITH {JOBS_SQL}, m AS (SELECT max(processed_at) AS t FROM jobs) SELECT source, count(*) FILTER (WHERE processed_at >= t - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (WHERE processed_at >= date_trunc('day', t)) AS today FROM jobs, m GROUP BY 1")
def recent_counts(spark, sf):
    j = jobs(spark, sf)
    last = F.broadcast(j.agg(F.max("processed_at").alias("t")))
    return j.crossJoin(last).groupBy("source").agg(F.count_if(F.col("processed_at") >= F.col("t") - F.expr("INTERVAL 24 HOURS")).alias("last_24h"), F.count_if(F.to_date("processed_at") >= F.to_date("t")).alias("today"))


@register("a44_applied_companies", f"WITH {JOBS_SQL} SELECT DISTINCT company FROM jobs WHERE outcome = 'valid' AND processing_time_ms >= 100")
def applied_companies(spark, sf):
    return jobs(spark, sf).where("outcome = 'valid' and processing_time_ms >= 100").select("company").distinct()


@register("srt07_companies_to_watch", f"WITH {JOBS_SQL}, c AS (SELECT company, rejection_reason AS reason, count(*) AS n FROM jobs WHERE rejection_reason <> '' GROUP BY 1, 2), r AS (SELECT company, CAST(sum(n) AS BIGINT) AS rejections, max_by(reason, n * 10 - CAST(right(reason, 1) AS INT)) AS top_reason FROM c GROUP BY 1) SELECT * FROM r WHERE rejections >= 2 ORDER BY rejections DESC, company LIMIT 15")
def companies_to_watch(spark, sf):
    c = jobs(spark, sf).where("rejection_reason <> ''").groupBy("company", F.col("rejection_reason").alias("reason")).agg(F.count("*").alias("n"))
    r = c.groupBy("company").agg(F.sum("n").alias("rejections"), F.min_by("reason", F.struct((-F.col("n")).alias("m"), "reason")).alias("top_reason"))
    return r.where("rejections >= 2").orderBy(F.desc("rejections"), "company").limit(15)


@register("srt09_latest_run", f"WITH {JOBS_SQL} SELECT source, max_by(outcome, (processed_at, id)) AS last_outcome, max(processed_at) AS last_at FROM jobs GROUP BY 1")
def latest_run(spark, sf):
    return jobs(spark, sf).groupBy("source").agg(F.max_by("outcome", F.struct("processed_at", "id")).alias("last_outcome"), F.max("processed_at").alias("last_at"))


@register("srt10_newest_kept", f"WITH {JOBS_SQL}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY processed_at DESC, id DESC) AS i FROM jobs) SELECT id, source FROM r WHERE i <= 20")
def newest_kept(spark, sf):
    """A cap on entries: the newest of each source stay."""
    w = Window.partitionBy("source").orderBy(F.desc("processed_at"), F.desc("id"))
    return jobs(spark, sf).withColumn("i", F.row_number().over(w)).where("i <= 20").select("id", "source")
