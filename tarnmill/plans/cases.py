"""Functions on the fields of postings over all documents: seeds of cases, each with a word of the document's own, and
the values they should give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.functions import dates
from tarnmill.functions import pages as g
from tarnmill.functions import postings as p
from tarnmill.functions import text, urls
from tarnmill.plans.registry import register
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources.tables import table

_KIND = {str: "string", int: "int", bool: "boolean", float: "double"}


def cases(name: str, inputs: list[str], outputs: dict, rows: list[tuple]) -> None:
    """Registers a query of the outputs for every document, from the inputs of the seed row of its number with its own
    word put in; the rest of each row is what is expected."""
    n = len(inputs)

    def query(spark, sf):
        kinds = ", ".join(f"{c} {next((_KIND[type(r[i])] for r in rows if r[i] is not None), 'string')}" for i, c in enumerate(inputs))
        return seeded(spark, sf, [r[:n] for r in rows], kinds).select("doc_id", *inputs, *[f(F.col("x"), F.col("y") if "y" in inputs else None).alias(c) for c, f in outputs.items()])

    register(name, seeded_sql(rows, ", ".join([*inputs, *outputs])))(query)


flag = lambda c: c.cast("int")

cases("str11_clean_title", ["x"], {"clean": lambda x, y: p.clean_title(x)}, [
    ("[REQ-12] {w} Engineer Intern - Summer 2026", "{w} Engineer Intern"), ("R12345: {w} Developer | Remote {w}", "{w} Developer"), ("{w} Engineer - {w} Engineer", "{w} Engineer"),
    ("{w} Intern (PhD level)", "{w} Intern"), ("SWE 2026", "SWE 2026"), ("  {w}   Ops, ", "{w} Ops"), (None, None),
])
cases("str10_dedup_company", ["x"], {"key": lambda x, y: p.dedup_company(x)}, [("Facebook, Inc.", "meta"), ("Alphabet", "google"), ("{w}, Co", "{l} co"), ("Amazon Web Services {w}", "amazon"), ("{w}!", "{l}")])
cases("p13_company_fault", ["x"], {"fault": lambda x, y: p.company_fault(x), "junk": lambda x, y: flag(p.junk_company(x))}, [("{w}", None, 0), ("Careers", "placeholder", 1), (None, "placeholder", 1), ("12345", "digits", 0), ("{w} Software Engineer Intern", "a title", 0), ("averylongslugwithout{l}", "a slug", 0)])
cases("str13_university_only", ["x", "y"], {"restricted": lambda x, y: flag(p.university_only(x, y))}, [("{w} University", "{w} (current students)", 1), ("{w} University", "{w}", 0), ("Acme", "Students only", 0)])
cases("str14_technical", ["x"], {"technical": lambda x, y: flag(p.is_technical(x))}, [("Software Engineer, Sales {w}", 1), ("Sales and Marketing {w}", 0), ("Data {w} sales", 0), ("Cloud security {w}", 1), ("{w}", 0)])
cases("str16_internship", ["x", "y"], {"fault": lambda x, y: p.internship_fault(x, y)}, [("Senior Intern", "", "senior"), ("Data Intern", None, None), ("{w} role", "This internship is paid {w}", None), ("{w} role", "Permanent {w}", "no internship")])
cases("str17_season", ["x", "y"], {"fault": lambda x, y: p.season_fault(x, y)}, [("Intern Spring", "", "spring"), ("Intern {w}", "{w}: Summer 2024 and Fall of 2025", "past season"), ("Intern Summer 2026", "fall 2024", None), ("Intern", None, None)])
cases("str19_job_type_name", ["x"], {"kind": lambda x, y: p.job_type_name(x)}, [("Internships", "Internship"), (" CO-OP", "Co-op"), ("fulltime", "Full-Time"), ("temporary", "Contract"), ("x", "Unknown"), (None, "Unknown")])
cases("str22_clean_job_id", ["x"], {"id": lambda x, y: p.clean_job_id(x), "sponsor": lambda x, y: p.yes_no(x)}, [("Click here", "N/A", "Unknown"), (" R-{w} ", "R-{w}", "Unknown"), ("HASH_9", "N/A", "Unknown"), ("yes", "yes", "Yes"), (None, "N/A", "Unknown"), ("N", "N", "No")])
cases("str32_legal_entity", ["x"], {"name": lambda x, y: p.legal_entity(x)}, [("US12 The {w} Group", "{w}"), ("Bar LLC DBA {w} Labs", "{w} Labs"), ("{w} Holdings", "{w}"), ("{w}, Inc.", "{w}")])
cases("str34_looks_like_title", ["x"], {"title": lambda x, y: flag(p.looks_like_title(x))}, [("Software {w} Engineer", 1), ("Intern {w}", 0), ("{w}", 0)])
cases("str36_common_substring", ["x", "y"], {"n": lambda x, y: p.common_substring(x, y)}, [("zz{w}", "--{w}", 7), ("aaaa", "aa", 2), ("abc", "xyz", 0), ("", "a", 0), ("banana", "ananas", 5)])
cases("str41_person_name", ["x", "y"], {"first": lambda x, y: p.person_name(x)["first"], "last": lambda x, y: p.person_name(x)["last"], "initials": lambda x, y: p.person_name(x)["initials"], "shape": lambda x, y: p.shape_of(y, p.person_name(x)), "addresses": lambda x, y: F.array_join(p.addresses(p.person_name(x), F.lit("z.io")), " ")}, [
    ("Dr. Ada {w} (she)", "ada.{l}@z.io", "ada", "{l}", "aq", "<first>.<last>", "ada.{l}@z.io a{l}@z.io ada@z.io adaq@z.io ada_{l}@z.io"),
    ("Bo van {w}, PhD", "b{l}@z.io", "bo", "{l}", "bq", "<f><last>", "bo.{l}@z.io b{l}@z.io bo@z.io boq@z.io bo_{l}@z.io"),
    ("Cy Marsh III", "other@z.io", "cy", "marsh", "cm", None, "cy.marsh@z.io cmarsh@z.io cy@z.io cym@z.io cy_marsh@z.io"),
])
cases("str44_address_shape", ["x"], {"shape": lambda x, y: text.address_shape(x)}, [("ada.{l}", "first.last"), ("ada_{l}", "first_last"), ("aquill", "flast"), ("42", "first")])
cases("p31_suspicious_address", ["x"], {"suspicious": lambda x, y: flag(p.suspicious_address(x))}, [("{l}@z.io", 0), ("noreply@{l}.io", 1), ("a@b", 1), ("a@b.c.d.e.f.io", 1), ("a@b.xyz", 1), (None, 1)])
cases("p17_dead_page", ["x", "y"], {"dead": lambda x, y: flag(p.dead_page(x, y))}, [("https://a/404", "", 1), ("https://{l}/b", "{w}. This job is closed", 1), ("https://a/b", None, 0)])
cases("p24_ambiguous_city", ["x", "y"], {"country": lambda x, y: p.canada_or_us(x, y, F.lit("https://z.com/"))}, [("London", "Ontario {w} office", "CA"), ("London", "canada and usa", "US"), ("Vancouver", "Canadian dollars, CAD only", "CA"), ("Paris", "", "US")])
cases("rul21_trusted_fallback", ["x", "y"], {"taken": lambda x, y: flag(p.trusted_fallback(x == "failed", y, ["acme", "beta"]))}, [("failed", "Acme!", 1), ("failed", "{w}", 0), ("ok", "Acme", 0)])
cases("url19_strip_params", ["x"], {"url": lambda x, y: urls.strip_params(x, ["auth", "utm_source"])}, [("https://z/{w}?auth=1&x=2", "https://z/{w}?x=2"), ("https://z/a?x={w}&auth=1", "https://z/a?x={w}"), ("https://z/a?auth=1", "https://z/a"), ("https://z/a", "https://z/a")])
cases("str23_search_url", ["x"], {"url": lambda x, y: urls.search_url("https://s/?q=", x)}, [("{w} dev", "https://s/?q={w}%20dev"), ("a&{l}", "https://s/?q=a%26{l}")])
cases("str25_sanitize_company", ["x"], {"clean": lambda x, y: text.sanitize_company(x)}, [("{w} &amp; Co.", "{w} &"), ("Z", "Unknown"), (None, "Unknown"), (" {w}  Labs, Inc.", "{w} Labs")])
cases("m09_inline_pay", ["x"], {"reject": lambda x, y: flag(F.coalesce(F.try_element_at(_pay(x), F.lit(1)) < 25, F.lit(False)))}, [("{w} from $20/hr to $40/hr", 1), ("{w} $30 per hour", 0), ("{w}", 0)])


def _pay(c):
    from tarnmill.operators.rules import hourly_pay

    return hourly_pay(c)


PAGE = '<title>Careers</title><h1>{w} Engineer II</h1><p>Company: {w} Labs</p><p>Location: Reno, NV</p><p>Job ID: R-77</p><p>Employment type: Full time</p> posted about 12 days ago'
LD = '<script type="application/ld+json">{"title":"{w} Intern","hiringOrganization":{"name":"{w}"},"jobLocation":{"address":{"addressLocality":"Austin"}},"identifier":{"value":"9"}}</script>📍 Dallas, TX<h1>x</h1>'


def _best(c):
    b = g.most_confident(c, 0.6)
    return F.concat_ws("|", b["value"], b["method"])


cases("col10_page_fields", ["x", "y"], {"title": lambda x, y: g.title(x), "company": lambda x, y: _best(g.company(x, y)), "place": lambda x, y: _best(g.location(x, y)), "id": lambda x, y: _best(g.job_id(x, y)), "kind": lambda x, y: g.employment(x, y), "age": lambda x, y: g.age_days(x)}, [
    (PAGE, "https://jobs.zed.com/x", "{w} Engineer II", "{w} Labs|label", "Reno, NV|label", "R-77|label", "Full-Time", 12),
    (LD, "https://a.org/jobs/new-york/12345", "{w} Intern", "{w}|json-ld", "Austin|json-ld", "9|json-ld", "Unknown", None),
    ("<p>none</p>", "https://www.{l}.io/interns/san-jose/77", None, "{w}|domain", "", "77|url", "Internship", None),
    (None, None, None, "", "", "", "Unknown", None),
])
cases("col23_work_mode", ["x", "y"], {"mode": lambda x, y: g.mode(x, y)}, [("fully remote {w}", "{w}", "Remote"), ("fully remote", "Hybrid, Reno", "Hybrid"), ("office", None, "Unknown")])
cases("col20_failed_address", ["x"], {"address": lambda x, y: g.failed_address(x)}, [("X-Failed-Recipients: A.{w}@z.io", "a.{l}@z.io"), ("Final-Recipient: rfc822; {l}@d.org\nmore", "{l}@d.org"), ("could not be delivered to <{w}@f.com>", "{l}@f.com"), ("mailer-daemon@x.com says g@{l}.net failed", "g@{l}.net"), ("{w}", None)])
cases("rul31_subject_hint", ["x"], {"title": lambda x, y: g.hint(x)["title"], "company": lambda x, y: g.hint(x)["company"]}, [("{w} Engineer @ {w}", "{w} Engineer", "{w}"), ("{w} at Beta Labs", "{w}", "Beta Labs"), ("hello", None, None)])
cases("dt02_feed_age", ["x"], {"days": lambda x, y: g.feed_age(x, F.lit("2024-01-31").cast("date"))}, [("3d", 3), ("2mo", 60), ("Jan 05", 26), ("Feb 20", 345), ("{w}", 999), (None, 999)])
cases("dt14_schedule", ["x"], {"due": lambda x, y: flag(g.schedule_due(x, F.lit("2024-01-31 23:59:00").cast("timestamp_ntz")))}, [("00:01", 1), ("23:57", 1), ("12:00", 0)])
cases("m01_rounding", ["x"], {"up": lambda x, y: F.round(x, 1), "even": lambda x, y: F.bround(x, 1)}, [(2.25, 2.3, 2.2), (0.35, 0.4, 0.4), (2.5, 2.5, 2.5), (-2.25, -2.3, -2.2)])


cases("url18_redirect_guard", ["x", "y"], {"url": lambda x, y: urls.redirect_guard(x, y)}, [("https://{l}.com/1", "https://jobs.{l}.com/2", "https://jobs.{l}.com/2"), ("https://a.com/1", "https://spam.net/", "https://a.com/1"), ("https://x.b.org/1", "https://y.b.org/2", "https://y.b.org/2")])
cases("url08_known_company", ["x"], {"company": lambda x, y: urls.known_company(x, [(r"//careers\.acme\.", "Acme"), (r"beta", "Beta")]), "slug": lambda x, y: urls.board_slug(x)}, [("https://careers.acme.com/beta", "Acme", None), ("https://boards.host.io/beta-{l}/1", "Beta", "beta-{l}"), ("https://{l}.wd5.myworkdayjobs.com/en/x", None, "{l}")])
cases("dt12_zones", ["x"], {"zone": lambda x, y: dates.zone_of(x)}, [("Denver, CO {w}", "America/Denver"), ("Boston", "America/New_York"), (None, "America/New_York")])
cases("dt08_hours_since", ["x"], {"hours": lambda x, y: dates.hours_since(x, F.lit("2024-01-31 00:00:00").cast("timestamp"))}, [("2024-01-30T12:00:00", 12.0), ("2024-01-30T12:00:00+02:00", 14.0), ("2024-01-29", 48.0), ("{w}", None)])
cases("dt15_interval_due", ["x"], {"due": lambda x, y: flag(dates.interval_due(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600))}, [("2024-01-30 23:30:00", 0), ("2024-01-30 22:00:00", 1), (None, 1)])


@register("str35_levenshtein", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, levenshtein(a.n_name, b.n_name) AS edits FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 6")
def str35(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("s")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("t"))
    e = F.levenshtein("s", "t", 6)
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", e.alias("edits")).where("edits >= 0")
