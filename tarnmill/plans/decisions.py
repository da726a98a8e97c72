"""Whole-row decisions, learned state and audits over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnmill.functions import urls
from tarnmill.functions.places import abroad, in_us, state
from tarnmill.functions.postings import early_career
from tarnmill.operators.rules import cascade
from tarnmill.plans.registry import register
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources.tables import AS_OF, JOBS_SQL, as_of, jobs, table


@register("k01_derived_dims", "SELECT c_custkey, CAST(lower(c_mktsegment) IN ('building', 'machinery') AS INTEGER) AS is_remote, CAST(lower(c_mktsegment) = 'building' AS INTEGER) AS is_sponsored, right(c_name || ', TX', 2) AS location_state FROM customer".replace("\\\\", "\\"))
def k01(spark, sf):
    s = F.lower("c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", s.isin("building", "machinery").cast("int").alias("is_remote"), (s == "building").cast("int").alias("is_sponsored"), state(F.concat("c_name", F.lit(", TX"))).alias("location_state"))


@register("p05_source_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Board' WHEN 'view' THEN 'Feed' ELSE event_type END AS source FROM events")
def p05(spark, sf):
    names = F.create_map(F.lit("click"), F.lit("Board"), F.lit("view"), F.lit("Feed"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), "event_type").alias("source"))


@register("p07_no_future", "SELECT event_id FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-15' + INTERVAL 1 DAY")
def p07(spark, sf):
    return table(spark, sf, "events").where(F.col("ts").isNull() | (F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))).select("event_id")


@register("p09_aliases", seeded_sql([("{w}", "Dev", "Remote"), ("Beta {w}", "Unknown", "Unknown"), ("Unknown", "{w}", "Yes")], "company, title, remote"))
def p09(spark, sf):
    rows = seeded(spark, sf, [("{w}", None, None, "Dev", None, "Remote"), (None, " Beta {w} ", None, None, "", None), ("", None, "{w}", "x", "Yes", None)], "company string, co string, title string, ti string, remote string, remote_status string")
    pick = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit("Unknown"))
    return rows.select("doc_id", pick("company", "co").alias("company"), pick("title", "ti").alias("title"), pick("remote", "remote_status").alias("remote"))


PLACES = [
    ("Austin, TX {w}", 1), ("Unknown", 1), (None, 1), ("Berlin, Germany {w}", 0), ("{w}, Ohio", 1), ("{w}", 0), ("Remote (USA) {w}", 1), ("Toronto, Canada, ON", 0), ("Munich, DE", 0), ("Hyderabad, IN", 0), ("Dublin, CA", 1), ("Paris, TX", 1),
    ("Vancouver, WA", 1), ("Vancouver, BC", 0), ("Wilmington, DE", 1), ("{w}, Colorado", 1), ("{w}, Wyoming", 1), ("{w}, Puerto Rico", 1), ("Sydney", 0), ("Singapore", 0), ("{w} Denver", 1), ("US-NM-{w}", 1), ("{w}, Quebec", 0), ("London", 0), ("London, KY", 1),
]


@register("p19_us_places", seeded_sql(PLACES, "place, us"))
def p19(spark, sf):
    return seeded(spark, sf, [(p,) for p, _ in PLACES], "place string").select("doc_id", "place", in_us(F.col("place")).cast("int").alias("us"))


TITLES = [("Software Intern {w}", 1), ("Senior Intern Program {w}", 1), ("Senior Graduate Lead {w}", 0), ("New Grad {w} Engineer", 1), ("{w} Engineer", 0), ("Senior New Grad {w}", 1), ("Entry Level {w}", 1), ("Lead {w}, entry level", 0), ("Co-op {w}", 1), ("Internal {w}", 0)]


@register("p20_intern_filter", seeded_sql(TITLES, "title, kept"))
def p20(spark, sf):
    return seeded(spark, sf, [(t,) for t, _ in TITLES], "title string").select("doc_id", "title", early_career(F.col("title")).cast("int").alias("kept"))


ABROAD_CASES = [
    ("Toronto, ON, Canada", "{w}", "https://a.com/", "place: canada"), ("London", "{w}", "https://{l}.co.uk/jobs", "url: united kingdom"), ("Boston, MA", "{w}", "https://{l}.com/", None), ("Unknown", "Software Intern - Germany", "https://{l}.com/", "title: germany"), ("Munich, DE", "{w}", "https://{l}.com/", "place: germany"),
    ("Dublin, OH", "{w}", "https://{l}.com/", None), ("Sydney, Australia", "{w}", "https://{l}.com/", "place: australia"), ("Singapore", "{w}", "https://{l}.com/", "place: singapore"), ("Vancouver, BC", "{w}", "https://{l}.com/", "place: canada"), ("Peterborough CAN", "{w}", "https://{l}.com/", "place: canada"),
    ("{w}, Saskatchewan", "{w}", "https://{l}.com/", "place: canada"), ("Denver, Colorado", "{w}", "https://{l}.com/", None), ("Kraków", "{w}", "https://{l}.com/", "place: poland"), (None, "{w}", "https://{l}.com/", None), ("{w}", "Intern, Poland ({w})", "https://{l}.com/", "title: poland"), ("{w}", "{w}", "https://{l}.ca/jobs", "url: canada"), ("Wilmington, DE", "{w}", "https://{l}.com/", None),
]


@register("p21_abroad", seeded_sql(ABROAD_CASES, "place, title, url, reason"))
def p21(spark, sf):
    """Why a posting is abroad by title, site, and place."""
    d = seeded(spark, sf, [x[:3] for x in ABROAD_CASES], "place string, title string, url string")
    return d.select("doc_id", "place", "title", "url", abroad(F.col("place"), F.col("title"), F.col("url")).alias("reason"))


@register("p25_learned_words", "WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS w FROM part WHERE p_partkey % 400 = 1) SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM w WHERE w <> '' AND contains(lower(p_name), w))")
def p25(spark, sf):
    part = table(spark, sf, "part")
    learned = part.where("p_partkey % 400 = 1").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("w")).where("w <> ''").distinct()
    every = learned.agg(F.collect_set("w").alias("ws"))  # a short learned list
    return part.crossJoin(F.broadcast(every)).where(F.exists("ws", lambda w: F.contains(F.lower("p_name"), w))).select("p_partkey")


@register("p26_learned_members", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p26(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@register("p27_either_way_contained", "SELECT DISTINCT a.n_nationkey FROM nation a, region r WHERE contains(lower(a.n_name), lower(left(r.r_name, 3))) OR contains(lower(r.r_name), lower(a.n_name))")
def p27(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    test = F.contains(F.lower("n_name"), F.lower(F.substring("r_name", 1, 3))) | F.contains(F.lower("r_name"), F.lower("n_name"))
    return n.join(F.broadcast(r), test, "left_semi").select("n_nationkey")


@register("a30_counts_against_before", f"WITH {JOBS_SQL}, d AS (SELECT source, count(*) FILTER (WHERE processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS today, count(*) FILTER (WHERE processed_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) AS before FROM jobs GROUP BY 1) SELECT source, today, before, today = 0 AND before > 0 AS vanished FROM d")
def a30(spark, sf):
    at = F.col("processed_at")
    d = jobs(spark, sf).groupBy("source").agg(F.count_if(at >= as_of(1)).alias("today"), F.count_if((at < as_of(1)) & (at >= as_of(2))).alias("before"))
    return d.withColumn("vanished", (F.col("today") == 0) & (F.col("before") > 0))


@register("a36_queue_size", f"WITH {JOBS_SQL} SELECT count(*) FILTER (WHERE outcome = 'valid' AND k % 10 = 0) AS waiting, count(*) AS total FROM jobs")
def a36(spark, sf):
    return jobs(spark, sf).agg(F.count_if((F.col("outcome") == "valid") & (F.col("k") % 10 == 0)).alias("waiting"), F.count("*").alias("total"))


@register("set07_new_slugs", r"WITH s AS (SELECT DISTINCT regexp_extract(lower(url), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS slug, page_id % 3 AS part FROM pages) SELECT slug FROM s WHERE part = 0 EXCEPT SELECT slug FROM s WHERE part = 1 EXCEPT SELECT slug FROM s WHERE part = 2")
def set07(spark, sf):
    s = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("slug"), (F.col("page_id") % 3).alias("part")).distinct()
    part = lambda i: s.where(F.col("part") == i).select("slug")
    return part(0).join(part(1), "slug", "left_anti").join(part(2), "slug", "left_anti")


@register("set08_ordered_distinct", "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_name, ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w")
def set08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_name"), " ")), " ").alias("words"))


@register("j14_flag_members", "SELECT s_suppkey, s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) AS flagged FROM supplier")
def j14(spark, sf):
    bad = table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("s_nationkey"), F.lit(True).alias("f")).distinct()
    return table(spark, sf, "supplier").join(bad, "s_nationkey", "left").select("s_suppkey", F.coalesce("f", F.lit(False)).alias("flagged"))


@register("j22_corrections", f"WITH {JOBS_SQL}, c AS (SELECT company, max_by(source, (processed_at, id)) AS corrected FROM jobs WHERE outcome = 'reviewed' GROUP BY 1) SELECT j.id, coalesce(c.corrected, j.source) AS source, c.corrected IS NOT NULL AND c.corrected <> j.source AS changed FROM jobs j LEFT JOIN c USING (company)")
def j22(spark, sf):
    j = jobs(spark, sf)
    c = j.where("outcome = 'reviewed'").groupBy("company").agg(F.max_by("source", F.struct("processed_at", "id")).alias("corrected"))
    return j.join(c, "company", "left").select("id", F.coalesce("corrected", "source").alias("source"), F.coalesce(F.col("corrected") != F.col("source"), F.lit(False)).alias("changed"))


@register("j26_reuse_known", f"WITH {JOBS_SQL}, m AS (SELECT id, company, source, CASE WHEN k % 4 = 0 THEN k END AS v, processed_at FROM jobs) SELECT id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY company, source ORDER BY processed_at, id ROWS UNBOUNDED PRECEDING)) AS v FROM m")
def j26(spark, sf):
    w = Window.partitionBy("company", "source").orderBy("processed_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    m = jobs(spark, sf).withColumn("v", F.when(F.col("k") % 4 == 0, F.col("k")))
    return m.select("id", F.coalesce("v", F.last("v", ignorenulls=True).over(w)).alias("v"))


@register("rul27_rank_patterns", f"WITH {JOBS_SQL}, g AS (SELECT source AS pattern, avg(CASE WHEN outcome = 'valid' THEN 1.0 ELSE 0.0 END)::DOUBLE AS rate FROM jobs GROUP BY 1), c AS (SELECT DISTINCT company, source AS pattern FROM jobs WHERE processing_time_ms >= 200), f AS (SELECT DISTINCT company, source AS pattern FROM jobs WHERE processing_time_ms < 2), x AS (SELECT co.company, g.pattern, round(g.rate + CASE WHEN c.company IS NOT NULL THEN 0.5 ELSE 0 END, 6) AS score FROM (SELECT DISTINCT company FROM jobs) co CROSS JOIN g LEFT JOIN c ON c.company = co.company AND c.pattern = g.pattern WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.company = co.company AND f.pattern = g.pattern)) SELECT company, pattern, score, row_number() OVER (PARTITION BY company ORDER BY score DESC, pattern) AS place FROM x")
def rul27(spark, sf):
    """Patterns of each company by their overall rate, more if confirmed there, without those that failed there."""
    j = jobs(spark, sf)
    rate = j.groupBy(F.col("source").alias("pattern")).agg(F.avg((F.col("outcome") == "valid").cast("double")).alias("rate"))
    mine = lambda test, name: j.where(test).select("company", F.col("source").alias("pattern"), F.lit(1).alias(name)).distinct()
    x = j.select("company").distinct().crossJoin(F.broadcast(rate)).join(mine("processing_time_ms >= 200", "ok"), ["company", "pattern"], "left").join(mine("processing_time_ms < 2", "bad"), ["company", "pattern"], "left_anti")
    x = x.withColumn("score", F.round(F.col("rate") + F.when(F.col("ok") == 1, 0.5).otherwise(0.0), 6))
    return x.select("company", "pattern", "score", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("score"), "pattern")).alias("place"))


@register("rul29_auto_blacklist", f"WITH {JOBS_SQL}, r AS (SELECT company, count(*) FILTER (WHERE rejection_reason = 'reason_4') AS permanent, count(*) FILTER (WHERE rejection_reason NOT IN ('', 'reason_0', 'reason_4')) AS counted FROM jobs GROUP BY 1) SELECT company, CASE WHEN permanent >= 1 THEN 'Auto: permanent' WHEN counted >= 4 THEN 'Auto: repeated' END AS blacklisted FROM r WHERE permanent >= 1 OR counted >= 4")
def rul29(spark, sf):
    """A permanent reason at once, others after some; a transient one never."""
    why = F.col("rejection_reason")
    r = jobs(spark, sf).groupBy("company").agg(F.count_if(why == "reason_4").alias("permanent"), F.count_if(~why.isin("", "reason_0", "reason_4")).alias("counted"))
    return r.select("company", cascade([("Auto: permanent", F.col("permanent") >= 1), ("Auto: repeated", F.col("counted") >= 4)]).alias("blacklisted")).where("blacklisted is not null")


@register("rul32_learning", f"WITH {JOBS_SQL} SELECT company, max_by(source, (processed_at, id)) FILTER (WHERE source <> 'view') AS source, count(*) AS encounters, max(processed_at) AS last_seen FROM jobs GROUP BY 1")
def rul32(spark, sf):
    """The last fact that isn't unknown, the number of encounters and the last of them."""
    known = F.when(F.col("source") != "view", F.struct("processed_at", "id"))
    return jobs(spark, sf).groupBy("company").agg(F.max_by("source", known).alias("source"), F.count("*").alias("encounters"), F.max("processed_at").alias("last_seen"))


@register("rul33_sponsorship_upgrade", f"WITH {JOBS_SQL}, s AS (SELECT company, CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS status, (k % 10) / 10.0::DOUBLE AS confidence, id FROM jobs), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE status WHEN 'Yes' THEN 0 WHEN 'No' THEN 1 ELSE 2 END, confidence DESC, id) AS i FROM s) SELECT company, status, confidence FROM r WHERE i = 1")
def rul33(spark, sf):
    """Yes outweighs all, then the more confident; Unknown yields to anything."""
    k = F.col("k")
    status = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("Unknown")
    s = jobs(spark, sf).select("company", "id", status.alias("status"), ((k % 10) / 10.0).alias("confidence"))
    rank = F.when(F.col("status") == "Yes", 0).when(F.col("status") == "No", 1).otherwise(2)
    return s.groupBy("company").agg(F.min_by(F.struct("status", "confidence"), F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), "id")).alias("b")).select("company", "b.status", "b.confidence")


@register("rul34_tiers", f"WITH {JOBS_SQL}, r AS (SELECT company, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, company) AS place FROM jobs GROUP BY 1 HAVING count(*) >= 10) SELECT company, CASE WHEN place <= 3 THEN 1 WHEN place <= 10 THEN 2 ELSE 3 END AS tier FROM r")
def rul34(spark, sf):
    """Three tiers of the companies seen often; the first ten are found by a top-k, not by a sort of all."""
    n = jobs(spark, sf).groupBy("company").agg(F.count("*").alias("n")).where("n >= 10")
    top = n.orderBy(F.desc("n"), "company").limit(10)
    tiers = top.select("company", F.when(F.row_number().over(Window.orderBy(F.desc("n"), "company")) <= 3, 1).otherwise(2).alias("t"))
    return n.join(F.broadcast(tiers), "company", "left").select("company", F.coalesce("t", F.lit(3)).alias("tier"))


@register("stm15_last_thirty", f"WITH {JOBS_SQL}, d AS (SELECT source, CAST(processed_at AS DATE) AS day, count(*) FILTER (WHERE outcome = 'valid') AS valid, count(*) FILTER (WHERE outcome = 'discarded') AS rejected, row_number() OVER (PARTITION BY source ORDER BY CAST(processed_at AS DATE) DESC) AS i FROM jobs GROUP BY 1, 2) SELECT source, day, valid, rejected FROM d WHERE i <= 12")
def stm15(spark, sf):
    d = jobs(spark, sf).groupBy("source", F.to_date("processed_at").alias("day")).agg(F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(F.col("outcome") == "discarded").alias("rejected"))
    return d.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("day")))).where("i <= 12").drop("i")


@register("stm17_bounced_contacts", f"WITH {JOBS_SQL} SELECT company, source, count(*) FILTER (WHERE outcome = 'reviewed') AS bounces, max_by(outcome, (processed_at, id)) AS last_outcome, count(*) FILTER (WHERE outcome = 'reviewed') < 2 AS usable FROM jobs GROUP BY 1, 2")
def stm17(spark, sf):
    bounces = F.count_if(F.col("outcome") == "reviewed")
    return jobs(spark, sf).groupBy("company", "source").agg(bounces.alias("bounces"), F.max_by("outcome", F.struct("processed_at", "id")).alias("last_outcome"), (bounces < 2).alias("usable"))
