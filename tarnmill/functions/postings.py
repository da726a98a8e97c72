"""Cleaning and decisions on the fields of a posting, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import alnum_key, chain, has_any, squeeze

ALIASES = [("alphabet", "google"), ("meta platforms", "meta"), ("facebook", "meta"), ("amazon web services", "amazon")]
JUNK_COMPANIES = ["", "unknown", "n/a", "careers", "jobs", "apply now", "greenhouse", "lever", "workday", "ashby", "login"]
TECH = ["software", "developer", "engineer", "data", "machine learning", "security", "cloud", "programmer", "computer"]
OTHER = ["nurse", "sales", "marketing", "retail", "accounting", "legal", "teacher", "mechanic", "warehouse"]


def clean_title(x: Column) -> Column:
    """A title without codes, years, seasons, degrees, repeated halves and what follows a pipe; under five signs: as it was."""
    c = chain(
        squeeze(x),
        (r"^(?:\[[^\]]*\]|\([^)]*\)|#?[A-Z]{0,3}\d{4,}\s*[-:])\s*", ""),
        (r"\s*\|.*$", ""),
        (r"(?i)\s*[-,(]?\s*(?:summer|fall|autumn|winter|spring)?\s*20[23]\d\)?", ""),
        (r"(?i)\s*\((?:bs|ms|phd|bachelor'?s?|master'?s?)[^)]*\)", ""),
        (r"^(.{5,}?)\s*[-/]\s*\1$", "$1"),
        (r"[-,:;\s]+$", ""),
    )
    c = squeeze(c)
    return F.when(F.length(c) < 5, squeeze(x)).otherwise(c)


def dedup_company(x: Column) -> Column:
    """Key of a company for dedup: the first alias that equals or begins it stands for it."""
    low = squeeze(F.regexp_replace(F.lower(x), r"[^\w\s]", " "))
    out = low
    for name, to in reversed(ALIASES):
        out = F.when((low == name) | low.startswith(name + " "), to).otherwise(out)
    return out


def junk_company(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(JUNK_COMPANIES)


def company_fault(x: Column) -> Column:
    """Why a text is no company, or null."""
    words = F.size(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w.isin("engineer", "intern", "developer", "analyst", "manager", "software")))
    return (
        F.when(junk_company(x), "placeholder")
        .when(F.length(x) > 60, "too long")
        .when(x.rlike(r"^\d+$"), "digits")
        .when(words >= 2, "a title")
        .when((x == F.lower(x)) & (F.length(x) > 20) & ~F.contains(x, F.lit(" ")), "a slug")
    )


def university_only(company: Column, title: Column) -> Column:
    return F.lower(company).rlike(r"universit|college") & F.lower(title).rlike(r"students? only|work[- ]study|current students?")


def is_technical(title: Column) -> Column:
    """More technical words than others, or a technical phrase."""
    low = F.lower(title)
    count = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
    return low.rlike(r"computer science|software engineer") | (count(TECH) > count(OTHER))


def early_career(title: Column) -> Column:
    """Whether a title is for beginners: interns and new graduates always, entry level unless a word of rank is there."""
    low = F.lower(title)
    always = low.rlike(r"\b(?:intern|interns|internship|co-?op|new grad\w*|university graduate)\b")
    entry = low.rlike(r"\b(?:entry[- ]level|early career|junior|associate|graduate|apprentice|trainee)\b")
    return always | (entry & ~low.rlike(r"\b(?:senior|sr|staff|principal|lead|manager|director|head)\b"))


def internship_fault(title: Column, page: Column) -> Column:
    low, text = F.lower(title), F.lower(F.substring(F.coalesce(page, F.lit("")), 1, 2000))
    return (
        F.when(low.rlike(r"\b(senior|lead|manager|director)\b"), "senior")
        .when(low.rlike(r"\bintern(ship)?\b|\bco-?op(s|eratives?)?\b|trainee"), F.lit(None))
        .when(text.rlike(r"internship|\bco-?op (program|position)"), F.lit(None))
        .otherwise("no internship")
    )


def season_fault(title: Column, page: Column, year: int = 2026) -> Column:
    """A season that is over: years named near a season, all before `year`; spring is never wanted."""
    low = F.lower(F.concat_ws(" ", title, F.substring(F.coalesce(page, F.lit("")), 1, 3000)))
    years = F.transform(F.regexp_extract_all(low, F.lit(r"(?:summer|fall|autumn|winter)\s+(?:of\s+)?(20\d\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.lower(title).rlike(r"\bspring\b"), "spring").when((F.size(years) > 0) & (F.array_max(years) < year), "past season")


def job_type_name(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return (
        F.when(low.isin("intern", "internship", "internships"), "Internship")
        .when(low.isin("co-op", "coop", "co op"), "Co-op")
        .when(low.isin("full time", "full-time", "fulltime", "permanent"), "Full-Time")
        .when(low.isin("part time", "part-time"), "Part-Time")
        .when(low.isin("contract", "contractor", "temporary"), "Contract")
        .otherwise("Unknown")
    )


def clean_job_id(x: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when((low == "") | low.rlike("apply|submit|click|here|login") | low.startswith("hash_"), "N/A").otherwise(F.trim(x))


def yes_no(x: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low.isin("yes", "y", "true"), "Yes").when(low.isin("no", "n", "false"), "No").otherwise("Unknown")


def legal_entity(x: Column) -> Column:
    """A company without codes, 'The', 'Group' and what follows DBA."""
    return squeeze(chain(x, (r"^\w{2,4}\d+\s+", ""), (r"(?i)^.*\bd/?b/?a\b\s+", ""), (r"(?i)^the\s+", ""), (r"(?i)\s+(?:group|holdings?|international)$", ""), (r"(?i)[,\s]+(?:inc|llc|ltd|corp|gmbh|plc|s\.a)\.?$", "")))


def looks_like_title(x: Column) -> Column:
    low = F.lower(x)
    n = F.size(F.filter(F.array(*[F.lit(w) for w in ("engineer", "intern", "developer", "analyst", "scientist", "summer", "software")]), lambda w: F.contains(low, w)))
    return n >= 2


def common_substring(a: Column, b: Column, most: int = 40) -> Column:
    """Length of the longest common substring of two short texts of at most `most` signs each.

    A dynamic programme over the signs as nested folds: the state is the row of lengths so far and the best of them."""
    x, y = F.split(F.substring(a, 1, most), ""), F.split(F.substring(b, 1, most), "")
    signs = lambda s: F.filter(s, lambda c: c != "")
    zero = F.transform(signs(y), lambda _: F.lit(0))

    def row(state: Column, c: Column) -> Column:
        new = F.transform(signs(y), lambda d, j: F.when(c == d, F.when(j == 0, 0).otherwise(F.get(state["row"], j - 1)) + 1).otherwise(0))
        return F.struct(new.alias("row"), F.greatest(state["best"], F.coalesce(F.array_max(new), F.lit(0))).alias("best"))

    return F.aggregate(signs(x), F.struct(zero.alias("row"), F.lit(0).alias("best")), row, lambda s: s["best"])


def person_name(x: Column) -> Column:
    """Struct (first, last, initials) of a name without brackets, titles and degrees."""
    c = squeeze(chain(F.coalesce(x, F.lit("")), (r"\([^)]*\)", " "), (r",.*$", ""), (r"(?i)^(?:dr|mr|mrs|ms|prof)\.?\s+", ""), (r"(?i)\s+(?:jr|sr|ii|iii|phd|mba)\.?$", "")))
    parts = F.filter(F.split(F.lower(c), " "), lambda p: p != "")
    first, last = F.coalesce(F.get(parts, 0), F.lit("")), F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-1))).otherwise("")
    return F.struct(first.alias("first"), last.alias("last"), F.concat(F.substring(first, 1, 1), F.substring(last, 1, 1)).alias("initials"))


SHAPES = ["<first>.<last>", "<f><last>", "<first>", "<first><l>", "<first>_<last>"]


def expand(name: Column, shape: str) -> Column:
    steps = [("<first>", name["first"]), ("<last>", name["last"]), ("<f>", F.substring(name["first"], 1, 1)), ("<l>", F.substring(name["last"], 1, 1))]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), s[1]), steps, F.lit(shape))


def addresses(name: Column, domain: Column) -> Column:
    """An address for each shape, best shape first, each once."""
    return F.array_distinct(F.array(*[F.concat(expand(name, s), F.lit("@"), domain) for s in SHAPES]))


def shape_of(address: Column, name: Column) -> Column:
    """The first shape that gives the local part of an address, or null."""
    local = F.substring_index(F.lower(address), "@", 1)
    return F.coalesce(*[F.when(local == expand(name, s), s) for s in SHAPES])


def suspicious_address(x: Column) -> Column:
    low = F.lower(x)
    return F.coalesce(~low.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$") | low.rlike(r"@(?:[^.]+\.){4,}") | low.rlike(r"\.(?:xyz|top|click)$") | low.rlike(r"^(?:no-?reply|test|admin)@"), F.lit(True))


def dead_page(url: Column, page: Column) -> Column:
    low = F.lower(F.coalesce(page, F.lit("")))
    return F.lower(url).rlike(r"/404|error=|expired|/closed") | has_any(low, ["no longer accepting", "position has been filled", "job is closed", "page not found"])


def trusted_fallback(failed: Column, company: Column, trusted: list[str]) -> Column:
    return failed & alnum_key(company).isin([t.lower() for t in trusted])


def canada_or_us(city: Column, page: Column, url: Column) -> Column:
    """Country of an ambiguous city by words for either; a tie is the US."""
    low = F.lower(F.concat_ws(" ", city, page))
    n = lambda words: F.aggregate(F.array(*[F.contains(low, F.lit(w)).cast("int") for w in words]), F.lit(0), lambda s, x: s + x)
    ca = n(["canada", "canadian", "cad "]) + 2 * n(["ontario", "quebec", "alberta"]) + F.when(F.lower(url).rlike(r"\.ca(/|$)"), 3).otherwise(0)
    return F.when(ca > n(["united states", "usa", "u.s.", "usd"]), "CA").otherwise("US")
