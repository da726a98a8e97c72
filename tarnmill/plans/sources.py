"""Feeds, over payloads of our own with a word of each document in them, and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.functions import text, urls
from tarnmill.operators.upserts import insert_absent
from tarnmill.plans.registry import register
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources import feeds
from tarnmill.sources.tables import AS_OF, JOBS_SQL, TITLES_SQL, as_of, jobs, table, titles

GREENHOUSE = ('{"jobs":[{"title":"Dev {w}","absolute_url":"https://g/1","id":1,"location":{"name":"Austin, TX"}},{"title":"Ops","absolute_url":"https://g/2","id":2,"location":"Remote"}]}', "{broken")
LEVER = '[{"text":"QA {w}","hostedUrl":"","applyUrl":"https://l/a","id":"x","categories":{"location":"NYC"}}]'
ASHBY = '{"jobs":[{"title":"ML {w}","id":"77","locationName":"Boston"}]}'
SMART = '{"content":[{"name":"PM {w}","id":"5","location":{"city":"Reno","region":"NV","country":"us"}},{"name":"XX","id":"6","location":{"city":"Lyon","country":"fr"}},{"name":"YY","id":"7","location":{"country":"US"}}]}'
WORKDAY = '{"jobPostings":[{"title":"DBA {w}","externalPath":"/job/{w}","locationsText":"2 Locations","bulletFields":["x","R-100"]},{"title":"DBA {w}","externalPath":"/job/{w}","locationsText":"2 Locations","bulletFields":["x","R-100"]}]}'
WORKABLE = '{"results":[{"title":"UX {w}","shortcode":"{w}","location":{"city":"Troy","region":"NY"}},{"title":"UI","shortcode":"AB13","location":"Remote"}]}'
RIPPLING = '[{"name":"FE {w}","url":"https://r/1","uuid":"u1","workLocation":{"label":"Erie, PA"}}]'
BOARDS = [("Acme", "greenhouse", GREENHOUSE[0]), ("Bad", "greenhouse", GREENHOUSE[1]), ("Lev", "lever", LEVER), ("Ash", "ashby", ASHBY), ("Sma", "smartrecruiters", SMART), ("Wod", "workday", WORKDAY), ("Wor", "workable", WORKABLE), ("Rip", "rippling", RIPPLING)]
_BOARD_ROWS = [
    (5, "Wod {w}", "DBA {w}", "2 Locations", "https://wod.example.com/job/{w}", "R-100"), (6, "Wor {w}", "UX {w}", "Troy, NY", "https://apply.example.com/wor/{w}", "{w}"), (6, "Wor {w}", "UI", "Remote", "https://apply.example.com/wor/AB13", "AB13"),
    (7, "Rip {w}", "FE {w}", "Erie, PA", "https://r/1", "u1"), (0, "Acme {w}", "Dev {w}", "Austin, TX", "https://g/1", "1"), (0, "Acme {w}", "Ops", "Remote", "https://g/2", "2"), (2, "Lev {w}", "QA {w}", "NYC", "https://l/a", "x"),
    (3, "Ash {w}", "ML {w}", "Boston", "https://jobs.ashbyhq.com/ash/77", "77"), (4, "Sma {w}", "PM {w}", "Reno, NV", "https://jobs.example.com/sma/5", "5"), (4, "Sma {w}", "YY", "Unknown", "https://jobs.example.com/sma/7", "7"),
]


_BOARD_SQL = seeded_sql([r[1:] for r in _BOARD_ROWS], "company, title, location, url, job_id", of=[r[0] for r in _BOARD_ROWS], n=len(BOARDS), ids=False)


@register("s20_board_fan_in", f"WITH b AS ({_BOARD_SQL}) SELECT DISTINCT * FROM b WHERE company LIKE 'Wod %' UNION ALL SELECT * FROM b WHERE company NOT LIKE 'Wod %'")
def s20(spark, sf):
    """A payload for each document, one of seven kinds of boards; postings found by several searches of a board count once."""
    loads = seeded(spark, sf, [(f"{c} {{w}}", c.lower(), kind, body) for c, kind, body in BOARDS], "company string, slug string, kind string, body string")
    return feeds.fan_in([feeds.board(loads.where(F.col("kind") == kind).select("company", "slug", "body"), kind) for kind in feeds.BOARDS])


COMMENTS = [("{w} | Remote (US) | Software Engineer | https://acme.example/{l}\nmore",), ("{w} | Paris | Cook",), ("{w} | SF\nWe seek a developer",)]


@register("s14_hiring_lines", seeded_sql([("{w}", "Remote (US)", "Software Engineer", "https://acme.example/{l}"), ("{w}", "SF", "", "none")], "company, location, title, url", of=[0, 2], n=3, ids=False))
def s14(spark, sf):
    return feeds.hiring_lines(seeded(spark, sf, COMMENTS, "text string"))


TABLE = ["| Company | Role | Location | Link | Age |", "|---|---|---|---|---|", "| [{w}](https://a) | Dev | NYC | [Apply](https://x/1) | 2d |", "| ↳ | {w} Ops | SF | [Apply](https://x/2) | 3d |", "| Beta | QA | LA | 🔒 | 9d |", "| | SRE | LA | [Apply](https://x/3) | 1d |", "{w} plain text"]


@register("col15_markdown_table", seeded_sql([(3, "{w}", "Dev", "NYC", "https://x/1", "2d"), (4, "{w}", "{w} Ops", "SF", "https://x/2", "3d"), (6, "Beta", "SRE", "LA", "https://x/3", "1d")], "line, company, title, location, url, age", of=[0, 0, 0], n=1))
def col15(spark, sf):
    """A page of lines for each document."""
    pages = seeded(spark, sf, [("\n".join(TABLE),)], "page string")
    lines = pages.select("doc_id", F.posexplode(F.split("page", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return feeds.markdown_rows(lines, doc="doc_id")


_LOG = "CASE doc_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' ELSE 'ERROR' END"


@register("s30_log_tail", f"WITH e AS (SELECT event_id AS doc_id, ts, event_type FROM events), l AS (SELECT date_trunc('second', ts) AS \"at\", strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || {_LOG} || ' | ' || event_type || ' ' || doc_id AS text FROM e) SELECT \"at\", left(text, 120) AS text FROM l WHERE \"at\" >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AND contains(text, '| ERROR |') ORDER BY \"at\" DESC, text LIMIT 50")
def s30(spark, sf):
    """The last errors of a log with a line for each event, of the last 72 hours."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts", "event_type")
    lines = e.select(F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.expr(_LOG), F.concat_ws(" ", "event_type", "doc_id")).alias("text"))
    return feeds.error_tail(feeds.recent_log_lines(lines, F.lit(AS_OF).cast("timestamp"), 72), 50).withColumn("at", F.col("at").cast("timestamp_ntz"))


@register("s03_sheet_rows", seeded_sql([("{w}", "Dev", "https://{l}", "Unknown", "valid"), ("Beta", "Unknown", "", "{w}", "valid")], "company, title, url, source, outcome", of=[0, 1], n=3))
def s03(spark, sf):
    rows = [(["ok", "{w}", "Dev", "", "https://{l}"],), (["", "Beta", "", "x", "", "{w}"],), (["", "", "", ""],)]
    t = seeded(spark, sf, rows, "cells array<string>").where(F.exists(F.slice("cells", 1, 4), lambda c: F.trim(c) != ""))
    return t.select("doc_id", *[c.alias(n) for n, c in feeds.decode_row(F.col("cells"), {"company": 1, "title": 2, "url": 4, "source": 5}, {"title": "Unknown", "source": "Unknown"}).items()], F.lit("valid").alias("outcome"))


@register("s06_tabs", "SELECT n_name AS company, NULL AS status, 'nations' AS _src FROM nation UNION ALL SELECT c_name, c_mktsegment, 'customers' FROM customer WHERE trim(c_name) <> ''")
def s06(spark, sf):
    names = {"n_name": "company", "c_name": "company", "c_mktsegment": "status"}
    tabs = [feeds.map_columns(table(spark, sf, "nation"), names, "nations"), feeds.map_columns(table(spark, sf, "customer"), names, "customers")]
    return feeds.fan_in(tabs).where(F.trim("company") != "").select("company", "status", "_src")


@register("s07_known_keys", f"WITH {JOBS_SQL} SELECT 'company' AS kind, count(DISTINCT company) AS n FROM jobs UNION ALL SELECT 'id', count(DISTINCT k) FROM jobs")
def s07(spark, sf):
    j = jobs(spark, sf)
    keys = feeds.known_keys([j.where(F.col("outcome") == o) for o in ("valid", "discarded", "reviewed")], {"company": F.col("company"), "id": F.col("k")})
    count = lambda name: keys[name].agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count("company").unionByName(count("id"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', ''), '://www\.', '://')"


@register("s08_url_keys", f"SELECT DISTINCT {_CLEAN} AS url FROM pages WHERE url IS NOT NULL AND trim(url) <> ''")
def s08(spark, sf):
    """URLs of the rows that are there, cleaned: one column is read."""
    u = table(spark, sf, "pages").where(F.trim("url") != "").select(urls.clean_url(F.col("url")).alias("url"))
    return u.distinct()


@register("s09_pair_keys", rf"WITH {TITLES_SQL} SELECT DISTINCT regexp_replace(lower(company), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS pair FROM titles WHERE trim(company) <> '' AND trim(title) <> ''")
def s09(spark, sf):
    """Keys of company and title of the rows that have both."""
    t = titles(spark, sf).where((F.trim("company") != "") & (F.trim("title") != ""))
    return t.select(F.concat_ws("_", text.alnum_key(F.col("company")), text.alnum_key(F.col("title"))).alias("pair")).distinct()


@register("s10_id_keys", "SELECT DISTINCT lower(CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS job_id FROM events WHERE json_extract_string(props, '$.k') NOT IN ('', 'N/A')")
def s10(spark, sf):
    """Ids of the rows that have one."""
    k = F.lower(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select(k.alias("job_id")).where(~F.col("job_id").isin("", "n/a")).distinct()


@register("s21_slug_merge", "SELECT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS slug, CASE WHEN min(page_id % 3) = 0 THEN 'static' ELSE 'learned' END AS origin FROM pages GROUP BY 1")
def s21(spark, sf):
    p = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("slug"), "page_id")
    static = p.where("page_id % 3 = 0").select("slug", F.lit("static").alias("origin")).distinct()
    learned = p.where("page_id % 3 <> 0").select("slug", F.lit("learned").alias("origin")).distinct()
    return insert_absent(static, learned, ["slug"])


@register("s04_backfill", seeded_sql([("{w}", "Dev", "Unknown", "valid"), ("{w}", "Ops", "old", "discarded")], "company, title, reason, outcome", of=[0, 2], n=3).replace("doc_id,", "doc_id AS seq,", 1))
def s04(spark, sf):
    tab = seeded(spark, sf, [(["", "{w}", "Dev"], "valid"), (["", " ", "", "", "x"], "valid"), (["{w}", "Ops", "old"], "discarded")], "cells array<string>, tab string").withColumnRenamed("doc_id", "seq")
    part = lambda name, layout: (tab.where(F.col("tab") == name), layout)
    return feeds.backfill({"valid": part("valid", {"company": 1, "title": 2, "reason": 9}), "discarded": part("discarded", {"company": 0, "title": 1, "reason": 2})}, {"reason": "Unknown"})


@register("s29_state_map", f"WITH {JOBS_SQL} SELECT source, count(*) AS runs, round(100.0 * count(*) FILTER (WHERE outcome = 'valid') / count(*), 1) AS rate FROM jobs GROUP BY 1 HAVING count(*) >= 2")
def s29(spark, sf):
    """Rows out of a state document that holds a map of sources."""
    doc = jobs(spark, sf).groupBy("source").agg(F.struct(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "valid").alias("valid")).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("source", "s"))).alias("doc"))
    rows = doc.select(F.explode("doc").alias("source", "s")).where("s.runs >= 2")
    return rows.select("source", "s.runs", F.round(F.lit(100.0) * F.col("s.valid") / F.col("s.runs"), 1).alias("rate"))


@register("s33_salvage", seeded_sql([('{"a": "{w}"}',), ('{"b": {"c": 2}}',)], "object", of=[0, 0], n=2, ids=False))
def s33(spark, sf):
    return feeds.salvage(seeded(spark, sf, [('[{"a": "{w}"}, {broken, {"b": {"c": 2}}',), (None,)], "text string"))


@register("s25_unseen", f"WITH {JOBS_SQL} SELECT id FROM jobs j WHERE processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND NOT EXISTS (SELECT 1 FROM jobs o WHERE o.k = j.k AND o.company = j.company AND o.processed_at < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND o.processed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 9 DAY)")
def s25(spark, sf):
    """What a ledger of the last seven days doesn't hold."""
    j, at = jobs(spark, sf), F.col("processed_at")
    return j.where(at >= as_of(2)).join(j.where((at < as_of(2)) & (at >= as_of(9))).select("k", "company"), ["k", "company"], "left_anti").select("id")
