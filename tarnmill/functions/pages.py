"""Fields of a posting from a page, a URL or raw text: candidates with confidences, and the rules to choose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions import html, urls
from tarnmill.functions.text import squeeze, work_mode

Candidate = tuple[Column, float, str]


def candidates(*ways: Candidate) -> Column:
    """Array of struct (value, confidence, method) of the ways that gave something."""
    one = lambda v, c, m: F.when(v.isNotNull() & (F.trim(v) != ""), F.struct(squeeze(v).alias("value"), F.lit(c).alias("confidence"), F.lit(m).alias("method")))
    return F.array_compact(F.array(*[one(*w) for w in ways]))


def most_confident(c: Column, least: float = 0.0) -> Column:
    """The candidate of the highest confidence, the first of equal ones; null if none has `least`."""
    fine = F.filter(c, lambda x: x["confidence"] >= least)
    return F.aggregate(fine, F.when(F.lit(False), F.get(c, 0)), lambda best, x: F.when(best.isNull() | (x["confidence"] > best["confidence"]), x).otherwise(best))


def _labelled(x: Column, label: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, rf"(?i){label}\s*:\s*([^<\n|;]+)", 1)), F.lit(""))


def job_id(page: Column, url: Column) -> Column:
    return candidates((html.json_ld(page)["id"], 0.95, "json-ld"), (F.nullif(urls.job_id_from_url(url), F.lit("N/A")), 0.9, "url"), (_labelled(page, r"(?:job|req(?:uisition)?)\s*(?:id|#)"), 0.75, "label"))


def company(page: Column, url: Column) -> Column:
    site = F.nullif(F.initcap(F.regexp_extract(urls.domain(url), r"^([^.]+)", 1)), F.lit(""))
    return candidates((html.json_ld(page)["company"], 0.95, "json-ld"), (html.meta(page, "og:site_name"), 0.85, "meta"), (_labelled(page, "company"), 0.75, "label"), (site, 0.6, "domain"))


def location(page: Column, url: Column) -> Column:
    in_url = F.nullif(F.initcap(F.regexp_replace(F.regexp_extract(url, r"(?i)/(?:jobs?|locations?)/([a-z]+(?:-[a-z]+)*)/", 1), "-", " ")), F.lit(""))
    pin = F.nullif(F.trim(F.regexp_extract(page, "\U0001f4cd\\s*([^<\\n]+)", 1)), F.lit(""))
    return candidates((html.json_ld(page)["city"], 0.95, "json-ld"), (pin, 0.9, "pin"), (_labelled(page, "location"), 0.8, "label"), (in_url, 0.7, "url"))


def title(page: Column) -> Column:
    """The first of several elements that holds two words and a job word, else the first of two words."""
    all_ = F.array_compact(F.array(html.json_ld(page)["title"], html.meta(page, "og:title"), html.heading(page), html.title(page)))
    fine = F.filter(all_, lambda t: F.size(F.split(F.trim(t), r"\s+")) >= 2)
    jobs = F.filter(fine, lambda t: F.lower(t).rlike("engineer|intern|developer|analyst|scientist|designer"))
    return F.coalesce(F.get(jobs, 0), F.get(fine, 0))


def mode(page: Column, place: Column) -> Column:
    by_place = work_mode(place)
    return F.when(by_place != "Unknown", by_place).otherwise(work_mode(F.substring(page, 1, 500)))


def employment(page: Column, url: Column) -> Column:
    label = F.lower(_labelled(page, r"(?:employment|job) type"))
    return F.when(label.rlike("intern"), "Internship").when(label.rlike("full"), "Full-Time").when(label.rlike("contract"), "Contract").when(F.lower(url).rlike("/intern(?:ship)?s?/"), "Internship").otherwise("Unknown")


def age_days(text: Column) -> Column:
    """Age from 'posted N days ago', unless the passage speaks of updates or deadlines; at most a year."""
    low = F.lower(F.substring(text, 1, 3000))
    n = F.nullif(F.regexp_extract(low, r"posted[^.0-9]{0,15}(\d{1,3})\+?\s*days? ago", 1), F.lit("")).cast("int")
    skip = low.rlike(r"(updated|deadline|closes)[^.]{0,30}posted")
    return F.when((n <= 365) & ~skip, n)


def feed_age(x: Column, as_of: Column) -> Column:
    """'3d', '2mo' or 'Jan 05' as days before the as-of day; what can't be read is 999."""
    low = F.lower(F.trim(x))
    n = F.nullif(F.regexp_extract(low, r"^(\d+)\s*(?:d|mo)", 1), F.lit("")).cast("int")
    day = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.initcap(low), F.year(as_of).cast("string")), F.lit("MMM d yyyy")))
    rolled = F.when(day > as_of, F.add_months(day, -12)).otherwise(day)
    return F.coalesce(F.when(low.rlike(r"^\d+\s*d"), n).when(low.rlike(r"^\d+\s*mo"), n * 30), F.datediff(as_of, rolled), F.lit(999))


def failed_address(message: Column) -> Column:
    """Address of a bounce by headers first, then by wording, then the first in the text that isn't the mailer's."""
    first = lambda p: F.nullif(F.lower(F.regexp_extract(message, p, 1)), F.lit(""))
    rest = F.filter(F.transform(F.regexp_extract_all(message, F.lit(r"([\w.+-]+@[\w-]+\.[\w.]+\w)"), F.lit(1)), lambda a: F.lower(a)), lambda a: ~a.rlike("mailer-daemon|postmaster"))
    return F.coalesce(first(r"(?i)x-failed-recipients:\s*([\w.+-]+@[\w.-]+\w)"), first(r"(?i)final-recipient:\s*rfc822;\s*([\w.+-]+@[\w.-]+\w)"), first(r"(?i)(?:delivered to|delivery to)\s+<?([\w.+-]+@[\w.-]+\w)"), F.get(rest, 0))


def hint(subject: Column) -> Column:
    """Struct (title, company) of 'Title @ Company' or 'Title at Company'."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(subject, r"^(.{3,}?)\s+(?:@|at)\s+([^@]+)$", i)), F.lit(""))
    return F.struct(part(1).alias("title"), part(2).alias("company"))


def schedule_due(at: Column, now: Column, seconds: int = 180) -> Column:
    """Whether a time of day given as HH:MM is within some seconds of now, by the clock."""
    day = F.hour(now) * 3600 + F.minute(now) * 60 + F.second(now)
    wanted = F.substring(at, 1, 2).cast("int") * 3600 + F.substring(at, 4, 2).cast("int") * 60
    gap = F.abs(day - wanted)
    return F.least(gap, 86400 - gap) <= seconds
