"""Decisions on whole postings over all documents: seeds of every kind of row, each with a word of the document in it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnmill.functions import html, urls
from tarnmill.functions.places import pick_first
from tarnmill.operators import decisions as d
from tarnmill.operators import history, upserts
from tarnmill.plans.registry import register
from tarnmill.plans.rules import _SCORED, _scored
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources.tables import AS_OF, JOBS_SQL, jobs, postings

BLACKLIST = ["Evil Corp", "Bad Works"]
_INTERN = "Software Engineer Intern {w}"
_URL = "https://{l}.com/jobs/12345"
#: (company, title, location, url, job_id, page, age, decision of a row, decision of a row of a feed)
ROWS = [
    ("{w} Labs", _INTERN, "Austin, TX", _URL, "R-1", "We build things. $40/hr", 2, None, None),
    ("{w} Labs", _INTERN, "Austin, TX", "ftp://{l}.com/x", "R-2", "We build things.", 2, "bad url", "bad url"),
    ("Evil Corp", _INTERN, "Austin, TX", _URL, "R-3", "We build things.", 2, "blacklisted company", "blacklisted company"),
    ("Careers", _INTERN, "Austin, TX", _URL, "R-4", "We build things.", 2, "company", "company"),
    ("{w} Inc", "Senior Software Engineer {w}", "Austin, TX", _URL, "R-5", "We build things.", 2, "title not for beginners", "title not for beginners"),
    ("{w} Care", "Nurse Intern {w}", "Austin, TX", _URL, "R-6", "We help people.", 2, "title not technical", "title not technical"),
    ("{w} Soft", "Software Intern Spring {w}", "Austin, TX", _URL, "R-7", "We build things.", 2, "season", "season"),
    ("{w} University", "Software Intern {w} (current students)", "Austin, TX", _URL, "R-8", "We teach.", 2, "students of the university only", "students of the university only"),
    ("{w} Nord", _INTERN, "Toronto, Canada", _URL, "R-9", "We build things.", 2, "abroad", "abroad"),
    ("{w} Gone", _INTERN, "Denver, Colorado", _URL, "R-10", "This job is closed.", 2, "dead page", "dead page"),
    ("{w} Old", _INTERN, "Austin, TX", _URL, "R-11", "We build things.", 60, "too old", "too old"),
    ("{w} Guard", _INTERN, "Austin, TX", _URL, "R-12", "Must be a US citizen.", 2, "restricted: citizenship", "restricted"),
    ("{w} Cheap", _INTERN, "Austin, TX", _URL, "R-13", "Pay is $15/hr.", 2, "low pay", "low pay"),
    ("{w} Vague", _INTERN, "Unknown", _URL, "N/A", "We build things.", 2, "score", None),
    ("{w} Late", _INTERN, "Austin, TX", _URL, "R-14", "For summer 2024.", 2, None, "season of the page"),
    ("{w} Slow", _INTERN, "Austin, TX", _URL, "R-15", "We build things.", 9, None, "too old"),
]
_KINDS = "company string, title string, location string, url string, job_id string, page string, age int"
_NAMES = "company, title, location, url, job_id, page, age"
_GATES = "('bad url', 'blacklisted company', 'company', 'title not for beginners', 'title not technical', 'season', 'students of the university only')"


def _rows(spark, sf):
    rows = seeded(spark, sf, [r[:7] for r in ROWS], _KINDS)
    nth = F.row_number().over(Window.partitionBy(history.pair_key(F.col("company"), F.col("title"))).orderBy("doc_id"))
    return rows.withColumn("duplicate", nth > 1), {c: F.col(c) for c in _NAMES.split(", ")}


def _decided(column: int, first: str) -> str:
    seeds = seeded_sql([(*r[:7], r[column]) for r in ROWS], _NAMES + ", reason")
    key = r"regexp_replace(lower(trim(regexp_replace(company, '(?i),?\s*(?:inc|llc|ltd|corp|l\.?p)\.?\s*$', ''))), '[^a-z0-9]', '', 'g')"
    return f"WITH s AS ({seeds}), n AS (SELECT *, row_number() OVER (PARTITION BY {key}, lower(title) ORDER BY doc_id) AS nth FROM s), r AS (SELECT doc_id, CASE WHEN reason IN {first} THEN reason WHEN nth > 1 THEN 'duplicate' ELSE reason END AS reason FROM n) SELECT doc_id, reason IS NULL AS accepted, reason FROM r"


@register("rul20_row_decision", _decided(7, _GATES))
def rul20(spark, sf):
    """Gates, duplicates of the batch, place, page and score in order; the first that holds discards."""
    rows, row = _rows(spark, sf)
    reason = d.row_decision(row, F.col("duplicate"), BLACKLIST)
    return rows.select("doc_id", reason.alias("reason")).select("doc_id", F.col("reason").isNull().alias("accepted"), "reason")


@register("rul30_feed_decision", _decided(8, "('too old', 'blacklisted company')"))
def rul30(spark, sf):
    """The checks in the order of a feed's rows."""
    rows, row = _rows(spark, sf)
    reason = d.feed_decision(row, F.col("duplicate"), BLACKLIST)
    return rows.select("doc_id", reason.alias("reason")).select("doc_id", F.col("reason").isNull().alias("accepted"), "reason")


SCORES = [("{w}", "Software Engineer Intern", "Austin, TX", "R-{w}", 7, 7), ("{w}", "Software Engineer Intern", "Unknown", "R-{w}", 4, 5), ("Unknown", "Dev", "Austin, TX", "N/A", 0, 2), ("{w}", "Dev", None, "HASH_{w}", 2, 3), (None, None, None, None, 0, 0), ("N/A", "Software Engineer Intern", "Reno, NV", "R-1", 4, 4)]


@register("rul19_acceptance", "SELECT *, score >= 4 AS accepted FROM (" + seeded_sql(SCORES, "company, title, location, job_id, score, score_plain") + ")")
def rul19(spark, sf):
    rows = seeded(spark, sf, [r[:4] for r in SCORES], "company string, title string, location string, job_id string")
    row = {c: F.col(c) for c in ("company", "title", "location", "job_id")}
    score = d.acceptance_score(row)
    return rows.select("doc_id", *row, score.alias("score"), d.acceptance_score(row, False).alias("score_plain"), (score >= 4).alias("accepted"))


#: (company, title, location, url, job_id, shifted, repeated, action, issue, value)
AUDIT = [
    ("{w}", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", False, False, None, None, None),
    ("{w}", "Account Executive {w}", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", False, False, "delete", "other title", None),
    ("Fort {w} Defense", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", False, False, "delete", "clearance company", None),
    ("{w} Staffing", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", False, False, "delete", "staffing agency", None),
    ("{w}", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", True, False, "delete", "row shift", None),
    ("{w}", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "R-1", False, True, "delete", "repeated id", None),
    ("acmecorp", "Software Intern {w}", "Austin, TX", "https://acme.com/jobs/12345", "R-1", False, False, "fix", "company name", "Acme Corp"),
    ("{w}", "Software Intern", "Austin, TX", "https://{l}.com/jobs/12345", "N/A", False, False, "fix", "id from url", "12345"),
    ("{w}", "Dev", "Austin, TX", "search:none", "R-1", False, False, "fix", "search link", "search:?q={w}%20Dev"),
    ("{w}", "Dev", "Austin, TX", "search:?q=Other%20Dev", "R-1", False, False, "fix", "search link of another company", "search:?q={w}%20Dev"),
    ("{w}", "Software Intern", "click to apply", "https://{l}.com/jobs/12345", "R-1", False, False, "fix", "garbage location", "Unknown"),
    ("{w}", "Software Intern", "NJ Princeton", "https://{l}.com/jobs/12345", "R-1", False, False, "fix", "state first", "Princeton, NJ"),
    ("{w}", "Software Intern", "Austin, TX", "https://others.com/jobs/12345", "R-1", False, False, "flag", "url of another company", "others"),
    ("{w}", "Software Intern", "Austin, TX", "https://greenhouse.io/jobs/12345", "R-1", False, False, None, None, None),
]


@register("rul22_quality_gate", seeded_sql([r[7:] for r in AUDIT], "action, issue, value"))
def rul22(spark, sf):
    """Eleven checks of kept rows: what to delete, to put right or to report."""
    rows = seeded(spark, sf, [r[:7] for r in AUDIT], "company string, title string, location string, url string, job_id string, shifted boolean, repeated boolean")
    row = {c: F.col(c) for c in ("company", "title", "location", "url", "job_id")}
    found = d.quality_issues(row, ["defense"], {"acmecorp": "Acme Corp"}, urls.BOARD_HOSTS, F.col("shifted"), F.col("repeated"))
    return rows.select("doc_id", *[c.alias(n) for n, c in found.items()])


#: (reason, title, location, age, trusted, applied, always, rule)
DISCARDED = [
    ("Security clearance", "Dev {w}", "Austin, TX", 5, True, False, False, "trusted company"), ("Security clearance", "Dev {w}", "Austin, TX", 5, False, True, False, "applied before"), ("Security clearance", "Dev {w}", "Austin, TX", 5, False, False, False, None),
    ("Security clearance", "Dev {w}", "Austin, TX", 5, True, False, True, None), ("International", "Dev {w}", "{w}, Indiana", 5, False, False, False, "us after all"), ("International", "Dev {w}", "Pune, India", 5, False, True, False, None), ("Canada", "Dev", "Toronto, ON", 5, False, False, False, None),
    ("Not a CS role", "Software Developer {w}", "Unknown", 5, False, False, False, "technical title"), ("Low score", "Data Engineer {w}", "Unknown", 5, False, True, False, "company applied to"), ("Low score", "Gardener {w}", "Unknown", 5, False, True, False, None), ("Not a CS role", "Software Developer {w}", "Unknown", 61, False, False, False, None),
]


@register("rul23_rescue", seeded_sql(DISCARDED, "reason, title, location, age, trusted, applied, always, rule"))
def rul23(spark, sf):
    rows = seeded(spark, sf, [r[:7] for r in DISCARDED], "reason string, title string, location string, age int, trusted boolean, applied boolean, always boolean")
    row = {c: F.col(c) for c in ("reason", "title", "location", "age")}
    return rows.withColumn("rule", d.rescue(row, F.col("trusted"), F.col("applied"), F.col("always")))


#: (address, mx, provider, catch_all, smtp, hint, threshold, confidence, status, source, send_ok)
ADDRESSES = [
    ("noreply@{l}.io", True, "exists", False, "safe", "api_verified", None, 0, "rejected", "suspicious", False), ("{l}", True, "exists", False, "safe", None, None, 0, "rejected", "suspicious", False), ("a@{l}.io", False, "exists", False, "safe", None, None, 0, "rejected", "no mail server", False),
    ("a@{l}.io", True, "exists", False, "unknown", "api_verified", None, 90, "verified", "provider", True), ("a@{l}.io", True, "exists", False, "unknown", "pattern_guess", 88, 85, "verified", "provider", False), ("a@{l}.io", True, "not_exists", False, "safe", None, None, 0, "rejected", "provider", False),
    ("a@{l}.io", True, "unknown", True, "safe", "pattern_cache", None, 50, "manual_review", "catch-all", False), ("a@{l}.io", True, "unknown", False, "safe", "pattern_cache", None, 80, "verified", "smtp", True), ("a@{l}.io", True, "unknown", False, "safe", None, 60, 75, "verified", "smtp", True),
    ("a@{l}.io", True, "unknown", False, "risky", None, None, 40, "manual_review", "smtp", False), ("a@{l}.io", True, "unknown", False, "unknown", "api_verified", 95, 85, "verified", "api", False), ("a@{l}.io", True, "unknown", False, "unknown", "website_mining", None, 50, "manual_review", "hint", False),
    ("a@{l}.io", True, "unknown", False, "unknown", None, None, 30, "manual_review", "guess", False), (None, True, "exists", False, "safe", None, None, 0, "rejected", "suspicious", False),
]


@register("rul25_address_verdict", seeded_sql([(r[0], *r[7:]) for r in ADDRESSES], "address, confidence, status, source, send_ok"))
def rul25(spark, sf):
    rows = seeded(spark, sf, [r[:7] for r in ADDRESSES], "address string, mx boolean, provider string, catch_all boolean, smtp string, hint string, threshold int")
    seen = {c: F.col(c) for c in ("mx", "provider", "catch_all", "smtp", "hint")}
    return rows.select("doc_id", "address", *[c.alias(n) for n, c in d.address_verdict(F.col("address"), seen, F.col("threshold")).items()])


CARDS = """<table><tr><td data-test-id="job-card"><a href="https://x/view/{w}?a=1">{w} Engineer</a><p>Acme {w} \u00b7 Reno, NV</p></td><td class="big job-card"><div><a href="https://x/view/2">Ops</a></div><p>Beta</p><p>Remote</p></td>
<td data-test-id="job-card"><a href="https://x/view/2?again">Ops again</a></td><td class="card"><a href="https://x/9">no card</a></td><td data-test-id="job-card">no link</td></tr></table>"""


@register("col17_cards", seeded_sql([("{w} Engineer", "Acme {w}", "Reno, NV", "https://x/view/{w}"), ("Ops", "Beta", "Remote", "https://x/view/2")], "title, company, location, url", of=[0, 0], n=2))
def col17(spark, sf):
    return html.cards(seeded(spark, sf, [(CARDS,), (None,)], "html string"), "doc_id", "html")


LINKS = [
    ('<a href="https://own.io/1">x</a><a class="index_origin_k" href="https://{l}.com/a">apply</a>', "https://{l}.com/a"), ('<a href="https://own.io/2">Original job post</a><a href="https://{l}.com/b"><b>Original</b> Job Post</a>', None), ('<a href="https://{l}.com/c">See the original job</a>', "https://{l}.com/c"),
    ('<a href="https://own.io/3">x</a><script>{{"applyLink": "https://{l}.com/d"}}</script>', "https://{l}.com/d"), ("<p>{w}</p>", None), (None, None),
]
LINKS[1] = (LINKS[1][0].replace('<a href="https://own.io/2">Original job post</a>', ""), "https://{l}.com/b")


@register("col28_original_link", seeded_sql(LINKS, "html, link"))
def col28(spark, sf):
    return seeded(spark, sf, [r[:1] for r in LINKS], "html string").withColumn("link", html.original_link(F.col("html"), r"own\.io"))


POSTINGS = [("https://boards.greenhouse.io/{l}/jobs/77", True), ("https://jobs.lever.co/{l}/postings/1", True), ("https://{l}.com/jobs/77", False), ("https://boards.greenhouse.io/{l}/blog/jobs/1", False), ("https://x.myworkdayjobs.com/External/{l}/job/1", True), ("https://x.myworkdayjobs.com/about/job/1", False), ("ftp://greenhouse.io/job/1", False), (None, False)]


@register("col29_posting_urls", seeded_sql(POSTINGS, "url, posting"))
def col29(spark, sf):
    return seeded(spark, sf, [r[:1] for r in POSTINGS], "url string").withColumn("posting", urls.is_posting(F.col("url")))


MANY = [("Reno, NV; Austin, TX", "Reno, NV"), ("{w} or Boise, ID", "Boise, ID"), ("{w}; Boston", "{w}"), (None, None)]
MANY[1] = ("offices: Boise, ID and {w}", "Boise, ID")


@register("str49_first_place", seeded_sql(MANY, "places, place"))
def str49(spark, sf):
    return seeded(spark, sf, [r[:1] for r in MANY], "places string").withColumn("place", pick_first(F.col("places")))


@register("k15_rejection_report", f"WITH {JOBS_SQL}, r AS (SELECT rejection_reason AS reason, count(*) AS n FROM jobs WHERE outcome = 'discarded' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10) SELECT string_agg(printf('%-50s %6d', left(reason, 50), n), chr(10) ORDER BY n DESC, reason) AS report FROM r")
def k15(spark, sf):
    top = jobs(spark, sf).where("outcome = 'discarded'").groupBy(F.col("rejection_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)
    return upserts.lines(top.withColumn("__o", -F.col("n")), F.format_string("%-50s %6d", F.substring("reason", 1, 50), "n"), ["__o", "reason"])


@register("k16_quality_report", f"WITH {_SCORED}, q AS (SELECT s.source, count(*) AS n, round(avg(score), 1) AS mean FROM g JOIN documents s USING (doc_id) GROUP BY 1 ORDER BY mean DESC, source LIMIT 10) SELECT string_agg(printf('%-12s %6d %5.1f', source, n, mean), chr(10) ORDER BY mean DESC, source) AS report FROM q")
def k16(spark, sf):
    by = _scored(spark, sf).join(postings(spark, sf).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean"))
    return upserts.lines(by.orderBy(F.desc("mean"), "source").limit(10).withColumn("__o", -F.col("mean")), F.format_string("%-12s %6d %5.1f", "source", "n", "mean"), ["__o", "source"])


_LAYOUT = "company, source AS title, strftime(processed_at, '%Y-%m-%d') AS applied_on, '' AS url, 'R-' || k AS job_id, 'Unknown' AS job_type, 'Unknown' AS location, 'SDE' AS resume, 'Unknown' AS remote, strftime(processed_at, '%d %b, %Y') AS entry_date, source, 'Unknown' AS sponsorship"


@register("k08_discarded_layout", f"WITH {JOBS_SQL} SELECT id AS serial, coalesce(nullif(rejection_reason, ''), 'Filtered') AS reason, {_LAYOUT} FROM jobs WHERE outcome = 'discarded'")
def k08(spark, sf):
    """Discarded rows in the layout of their tab: a reason, 'Filtered' by default, and defaults for what is missing."""
    return upserts.sheet_layout(jobs(spark, sf).where("outcome = 'discarded'"), F.coalesce(F.nullif("rejection_reason", F.lit("")), F.lit("Filtered")))


@register("k13_reviewed_layout", f"WITH {JOBS_SQL} SELECT id AS serial, 'Does not fit' AS reason, {_LAYOUT} FROM jobs WHERE outcome = 'valid' AND processed_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY")
def k13(spark, sf):
    """Valid rows that nothing came of, in the layout of the tab they move to."""
    old = jobs(spark, sf).where((F.col("outcome") == "valid") & (F.col("processed_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 20 DAYS")))
    return upserts.sheet_layout(old, F.lit("Does not fit"))
