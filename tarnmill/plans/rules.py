"""Decisions on postings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnmill.operators import restrictions as t
from tarnmill.operators import rules as r
from tarnmill.plans.registry import register
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources.tables import AS_OF, JOBS_SQL, POSTINGS_SQL, as_of, jobs, postings, table


@r.stage("length")
def _length():
    return F.when(F.coalesce(F.col("n_chars"), F.lit(0)) < 200, "too short").when(F.col("n_chars") > 15000, "too long")


@r.stage("language")
def _language():
    return F.when(~F.col("lang").isin("en", "fr"), F.concat(F.lit("language "), "lang"))


@r.stage("toxic")
def _toxic():
    return F.when(F.col("toxic") == 1, "toxic")


@r.stage("quality")
def _quality():
    return F.when(F.col("quality") == 0, "low quality")


STAGES = ["length", "language", "toxic", "quality"]
_CASCADE = f"{POSTINGS_SQL}, d AS (SELECT doc_id, CASE WHEN n_chars < 200 OR n_chars > 15000 THEN 'length' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' END AS reject_stage, CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 15000 THEN 'too long' WHEN lang NOT IN ('en', 'fr') THEN 'language ' || lang WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low quality' END AS reject_reason FROM postings)"


@register("rul16_cascade", f"WITH {_CASCADE} SELECT doc_id, reject_stage, reject_reason FROM d")
def rul16(spark, sf):
    return r.run_stages(postings(spark, sf), STAGES).select("doc_id", "reject_stage", "reject_reason")


@register("a41_stage_metrics", f"WITH {_CASCADE} SELECT coalesce(reject_stage, 'passed') AS stage, count(*) AS rejects, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 4) AS rate FROM d GROUP BY 1")
def a41(spark, sf):
    return r.stage_metrics(r.run_stages(postings(spark, sf), STAGES))


PRESENCE = {"company": "source IS NOT NULL", "title": "n_chars > 100", "location": "lang <> 'es'", "url": "doc_id % 10 <> 0", "job_id": "doc_id % 3 <> 0", "salary": "quality IS NOT NULL", "sponsorship": "toxic = 0", "remote": "n_chars % 2 = 0"}
_POINTS = " + ".join(f"CASE WHEN {PRESENCE[k]} THEN {w} ELSE 0 END" for k, w in r.WEIGHTS.items())
_SCORED = f"{POSTINGS_SQL}, s AS (SELECT doc_id, round(({_POINTS})::DOUBLE / 10.5 * 100, 1) AS score, list_filter([{', '.join(f'CASE WHEN {PRESENCE[k]} THEN NULL ELSE {chr(39)}{k}{chr(39)} END' for k in r.WEIGHTS)}], lambda x: x IS NOT NULL) AS missing FROM postings), g AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 25 THEN 'D' ELSE 'F' END AS grade FROM s)"


def _scored(spark, sf):
    return postings(spark, sf).select("doc_id", *[c.alias(k) for k, c in r.completeness({k: F.expr(PRESENCE[k]) for k in r.WEIGHTS}).items()])


@register("rul18_quality_rows", f"WITH {_SCORED} SELECT doc_id, score, grade, array_to_string(missing, ',') AS missing FROM g")
def rul18(spark, sf):
    return _scored(spark, sf).withColumn("missing", F.array_join("missing", ","))


@register("a12_grade_histogram", f"WITH {_SCORED} SELECT grade, count(*) AS n, round(avg(score), 1) AS mean_score, min(score) AS min_score, max(score) AS max_score FROM g GROUP BY 1")
def a12_grades(spark, sf):
    return _scored(spark, sf).groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


@register("a12_missing_fields", f"WITH {_SCORED}, m AS (SELECT unnest(missing) AS field FROM g) SELECT field, count(*) AS n FROM m GROUP BY 1")
def a12_missing(spark, sf):
    return _scored(spark, sf).select(F.explode("missing").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


#: (sentence, restriction, sponsorship, whether the graduation year is too late, pay an hour)
PAGES = [
    ("Must be a US citizen. Pay is $45/hr.", "citizenship", "Unknown", 0, "45"),
    ("You will obtain a security clearance; we will sponsor visas.", "clearance", "Yes", 0, ""),
    ("We are unable to sponsor. Undergraduates only.", "undergraduate only", "No", 0, ""),
    ("Graduating in December 2028 or spring 2029. Earn $22.50 per hour or $30 an hour.", "graduation year", "Unknown", 1, "22.5,30"),
    ("Graduation 2026 to graduate 2029. Sponsorship is available.", None, "No", 0, ""),
    ("PhD candidates only, no CPT.", "phd only", "Unknown", 0, ""),
    ("$500/hr and $0.5/hr are out of range", None, "Unknown", 0, ""),
    ("Undergraduates only; graduate students are also welcome", None, "Unknown", 0, ""),
    ("Requires a PhD or equivalent", None, "Unknown", 0, ""),
    ("A degree in mechanical engineering is required. US persons only.", "degree field", "Unknown", 0, ""),
    ("Subject to export control", "us person", "Unknown", 0, ""),
    ("Candidates graduate by December 2026 at the latest", "graduation date", "Unknown", 0, ""),
    ("Permanent work authorization is a must", "permanent authorization", "Unknown", 0, ""),
    ("A programme for high school students", "high school", "Unknown", 0, ""),
    ("Currently enrolled in a Bachelor's degree program", "undergraduate only", "Unknown", 0, ""),
    ("You are a rising junior or senior", "undergraduate only", "Unknown", 0, ""),
    ("Pursuing an undergraduate or Master's degree", None, "Unknown", 0, ""),
    ("Preferred majors: mechanical or electrical engineering.", "preferred degree", "Unknown", 0, ""),
    ("Preferred majors: mechanical engineering, computer science.", None, "Unknown", 0, ""),
    ("Students at a university in Canada", "enrolled elsewhere", "Unknown", 0, ""),
    ("Students at a university in the United States", None, "Unknown", 0, ""),
    ("We do not accept OPT for this role", "cpt/opt", "Unknown", 0, ""),
    ("Bachelor's degrees only", "bachelor only", "Unknown", 0, ""),
    ("Class of 2029 preferred", "graduation year", "Unknown", 1, ""),
    ("Graduation in 2028 or later", None, "Unknown", 0, ""),
    ("BS, MS or PhD students", None, "Unknown", 0, ""),
    ("TS/SCI and polygraph", "clearance", "Unknown", 0, ""),
    ("We do not offer visa sponsorship at this time", None, "No", 0, ""),
    ("H-1B candidates get a sponsor here", None, "Yes", 0, ""),
    (None, None, "Unknown", None, None),
]


@register("rul01_restrictions", seeded_sql(PAGES, "page, restriction, sponsorship, too_late, pay"))
def rul01(spark, sf):
    """A sentence of each kind of restriction, or of what lifts one, between two copies of a document's text."""
    d = seeded(spark, sf, [(x[0],) for x in PAGES], "page string").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    p = F.concat(F.substring("text", 1, 4000), F.lit(" . "), F.col("page"), F.lit(" . "), F.substring("text", 1, 1000))
    pay = F.array_join(F.transform(r.hourly_pay(p), lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ",")
    return d.select("doc_id", "page", t.restriction(p).alias("restriction"), t.sponsorship(p).alias("sponsorship"), t.graduation_year(t.squeezed(p)).cast("int").alias("too_late"), pay.alias("pay"))


@register("u02_rejection_log", seeded_sql([(x[0], x[1]) for x in PAGES if x[1] in ("citizenship", "clearance", "high school", "cpt/opt")], "page, restriction"))
def u02(spark, sf):
    """Rejections with the passage that caused them; the passage must be of the sentence."""
    rows = [(x[0],) for x in PAGES if x[1] in ("citizenship", "clearance", "high school", "cpt/opt")]
    d = seeded(spark, sf, rows, "page string")
    passage = t.matched_passage(F.concat(F.lit("before . "), F.col("page"), F.lit(" . after")))
    return d.select("doc_id", "page", F.when(F.contains(F.concat(F.lit("before . "), t.squeezed(F.col("page")), F.lit(" . after")), passage) & (passage != ""), t.restriction(F.col("page"))).alias("restriction"))


@register("m08_salary", r"WITH d AS (SELECT doc_id, left(text, 50) || ' pays $' || (doc_id % 60) || '/hr to $' || (doc_id % 60 + 10) || ' per hour' AS page FROM documents), x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(page), '\$(\d{1,3}(?:\.\d{1,2})?)\s*(?:/|per|an)\s*h(?:ou)?r', 1), lambda v: v::DOUBLE), lambda v: v > 1 AND v < 200) AS pay FROM d) SELECT doc_id, list_min(pay) AS low, list_max(pay) AS high, coalesce(list_max(pay) < 25, FALSE) AS reject, coalesce(pay[1] < 25, FALSE) AS reject_by_first FROM x")
def m08(spark, sf):
    """Pay bounds; a posting goes if its highest pay is under 25, or, by the other rule, its first."""
    page = F.concat(F.substring("text", 1, 50), F.lit(" pays $"), (F.col("doc_id") % 60).cast("string"), F.lit("/hr to $"), (F.col("doc_id") % 60 + 10).cast("string"), F.lit(" per hour"))
    d = table(spark, sf, "documents").select("doc_id", r.hourly_pay(page).alias("pay"))
    return d.select("doc_id", F.array_min("pay").alias("low"), F.array_max("pay").alias("high"), F.coalesce(F.array_max("pay") < 25, F.lit(False)).alias("reject"), F.coalesce(F.try_element_at("pay", F.lit(1)) < 25, F.lit(False)).alias("reject_by_first"))


@register("p10_contract", f"WITH {JOBS_SQL} SELECT id, CASE WHEN id % 17 = 0 THEN 'company missing' WHEN id % 13 = 0 THEN 'url not http' WHEN id % 11 = 0 THEN 'resume type unknown' END AS fault FROM jobs")
def p10(spark, sf):
    j = jobs(spark, sf)
    row = {"company": F.when(F.col("id") % 17 != 0, F.col("company")), "title": F.col("source"), "url": F.when(F.col("id") % 13 == 0, "ftp://x").otherwise("https://x"), "resume_type": F.when(F.col("id") % 11 == 0, "XX").otherwise("SDE"), "outcome": F.col("outcome")}
    return j.select("id", r.contract_fault(row).alias("fault"))


@register("rul24_guarded_cleanup", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND (SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) / count(*)::DOUBLE FROM orders) <= 0.2")
def rul24(spark, sf):
    return r.guarded(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey") % 10 == 0)


@register("p29_expiry", f"WITH {JOBS_SQL} SELECT id, date_diff('day', CAST(processed_at AS DATE), DATE '{AS_OF}') AS age FROM jobs j WHERE outcome = 'reviewed' AND date_diff('day', CAST(processed_at AS DATE), DATE '{AS_OF}') >= 2 AND NOT EXISTS (SELECT 1 FROM jobs p WHERE p.company = j.company AND p.processing_time_ms >= 300)")
def p29(spark, sf):
    j = jobs(spark, sf)
    kept = j.where("processing_time_ms >= 300").select("company").distinct()
    age = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("processed_at"))
    return j.where("outcome = 'reviewed'").join(kept, "company", "left_anti").select("id", age.alias("age")).where("age >= 2")


@register("rul26_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity * 2 >= 75 THEN 'High' WHEN l_quantity * 2 >= 50 THEN 'Medium' ELSE 'Low' END AS label FROM lineitem")
def rul26(spark, sf):
    n = F.col("l_quantity") * 2
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(n >= 75, "High").when(n >= 50, "Medium").otherwise("Low").alias("label"))
