"""String functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
ACRONYMS = ["AI", "IBM", "API", "AWS", "HR", "IT", "ML", "QA", "SAP", "UX"]


def chain(x: Column, *steps: tuple[str, str]) -> Column:
    """Regular replacements one after another."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, x)


def has_any(x: Column, words: list[str]) -> Column:
    """Whether any of the words is a part of x, by plain containment."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def alnum_key(x: Column) -> Column:
    """Key of a text: lower case letters and digits of ASCII only; null gives ''."""
    return F.coalesce(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), F.lit(""))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tokenize(x: Column) -> Column:
    """Tokens for similarity: lower case ASCII words of two signs and more that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def strip_emoji(x: Column) -> Column:
    return F.regexp_replace(x, "[\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{FE0F}]+", "")


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(x: Column) -> Column:
    """Latin letters without their accents; other signs stay."""
    return F.translate(x, _ACCENTED, _PLAIN)


def unescape(x: Column) -> Column:
    """The common HTML entities; the ampersand last, so that nothing is decoded twice."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def sanitize_title(x: Column) -> Column:
    """A title for output: entities, emoji, accents, leading labels, trailing places and blanks removed."""
    c = strip_accents(strip_emoji(unescape(x)))
    c = chain(c, (r"(?i)^(?:new|hot|urgent|job|title)\s*[:!-]\s*", ""), (r"\s*[|•·]\s*", " - "), (r"\s+-\s+(?:USA?|Remote|North America)\s*$", ""), (r"[-,;:\s]+$", ""))
    return squeeze(c)


def sanitize_company(x: Column) -> Column:
    """A company for output; under two signs: Unknown."""
    c = squeeze(strip_emoji(unescape(F.coalesce(x, F.lit("")))))
    c = F.regexp_replace(c, r"(?i)[,\s]+(?:inc|llc|ltd|corp|co|gmbh|plc)\.?$", "")
    return F.when(F.length(c) < 2, "Unknown").otherwise(c)


def normalize_company(x: Column) -> Column:
    """Codes in front, legal forms behind and placeholders removed, then capitals set."""
    c = chain(squeeze(F.coalesce(x, F.lit(""))), (r"^[A-Z]{2}\d{2,}[-_ ]+", ""), (r"^\d+[-_ ]+", ""), (r"(?i)^the\s+", ""), (r"(?i)[,\s]+(?:inc|llc|ltd|limited|corp|corporation|company|gmbh|plc)\.?$", ""), (r"\s*\((?:US|USA|UK|Canada|Global)\)$", ""))
    return F.when(F.lower(c).isin("", "n/a", "na", "none", "unknown", "confidential"), "Unknown").otherwise(smart_capitals(c))


def smart_capitals(x: Column) -> Column:
    """Words all in one case get a capital, acronyms all capitals; mixed case stays."""
    word = lambda w: F.when(F.upper(w).isin(ACRONYMS), F.upper(w)).otherwise(F.initcap(w))
    titled = F.array_join(F.transform(F.split(x, " "), word), " ")
    return F.when((x == F.upper(x)) | (x == F.lower(x)), titled).otherwise(x)


def normalize_job_id(x: Column) -> Column:
    """Lower case letters and digits without leading zeros (all zeros stay); N/A gives ''."""
    key = alnum_key(x)
    return F.when(F.upper(F.trim(x)) == "N/A", "").otherwise(F.when(key.rlike("^0+$"), key).otherwise(F.regexp_replace(key, "^0+", "")))


def valid_job_id(x: Column) -> Column:
    """4 to 20 capitals, digits, - and _, with a digit, and no stop word."""
    c = F.regexp_replace(x, "Apply$", "")
    return F.coalesce(c.rlike("^[-_A-Z0-9]{4,20}$") & c.rlike("[0-9]") & ~F.lower(c).isin("apply", "submit", "login", "n/a"), F.lit(False))


ROLES = [
    ("ml", ["machine learning", "deep learning", "computer vision", " nlp", "data scien"], ["sales"]),
    ("data", ["data analyst", "analytics", "business intelligence", "data engineer"], ["sales", "entry clerk"]),
    ("software", ["developer", "software", "sre", "frontend", "devops", "full stack", "backend"], ["sales", "support"]),
    ("hardware", ["hardware", "fpga", "asic", "embedded", "firmware"], []),
]


def role_category(title: Column) -> Column:
    """First category that has a keyword and no exclusion, else 'other'."""
    low = F.lower(title)
    out = F.lit("other")
    for name, words, never in reversed(ROLES):
        test = has_any(low, words)
        out = F.when(test & ~has_any(low, never) if never else test, name).otherwise(out)
    return out


def job_type(title: Column, source: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(F.lower(source) == "newgrad", "Full-Time")
        .when(low.rlike(r"new grad|entry level|full[- ]time"), "Full-Time")
        .when(low.rlike(r"co-?op"), "Co-op")
        .when(low.rlike(r"\bintern(ship)?\b"), "Internship")
        .when(low.rlike(r"fall|winter|spring"), "Off-season")
        .otherwise("Internship")
    )


def resume_type(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike(r"machine learning|deep learning|\bml\b|\bai\b"), "ML").when(low.rlike(r"data|analy"), "DA").otherwise("SDE")


def title_fault(title: Column) -> Column:
    """First reason why a title is no good, or null."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (
        F.when(F.length(low) < 5, "too short")
        .when(low.rlike(r"^(home|careers?|apply|login|search|jobs?)$"), "page word")
        .when(low.rlike(r"\b(nurse|driver|cashier|teacher|chef|plumber)\b"), "other field")
        .when(low.rlike(r"\b(senior|staff|principal|director|vp|head of)\b"), "too senior")
        .when(low.rlike(r"\bunpaid\b"), "unpaid")
        .when(~low.rlike(r"[a-z]"), "no letters")
    )


def address_shape(local: Column) -> Column:
    """Shape of the local part of an address."""
    return F.when(local.rlike(r"^[a-z]+\.[a-z]+$"), "first.last").when(local.rlike(r"^[a-z]+_[a-z]+$"), "first_last").when(local.rlike(r"^[a-z]\.?[a-z]{2,}$"), "flast").otherwise("first")


def fuzzy_company(a: Column, b: Column) -> Column:
    """1 for equal keys, 0.9 for containment, else 1 - edits / longer length."""
    x, y = alnum_key(a), alnum_key(b)
    longest = F.greatest(F.length(x), F.length(y))
    edits = F.round(F.lit(1.0) - F.levenshtein(x, y) / longest, 4)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(edits)


def overlap_ratio(hint: Column, found: Column) -> Column:
    """Share of the signs of a hint that occur in another text."""
    signs = F.filter(F.split(F.lower(hint), ""), lambda c: c != "")
    return F.round(F.try_divide(F.size(F.filter(signs, lambda c: F.contains(F.lower(found), c))), F.size(signs)), 4)


def work_mode(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.rlike(r"remote|work from home|\bwfh\b"), "Remote").when(F.contains(low, F.lit("hybrid")), "Hybrid").when(low.rlike(r"on[- ]?site|in[- ]office"), "On Site").otherwise("Unknown")


STATUS_ORDER = [("offer", "Offer"), ("interview", "Interview"), ("oa round 2", "OA Round 2"), ("oa round 1", "OA Round 1"), ("assessment", "OA Round 1"), ("not applied", "Not Applied"), ("reject", "Rejected"), ("applied", "Applied")]


def status(x: Column) -> Column:
    """First of the known stages that the text contains, else the trimmed text; blank: Unknown."""
    low, out = F.lower(F.trim(x)), F.trim(x)
    for part, name in reversed(STATUS_ORDER):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return F.when(x.isNull() | (F.trim(x) == ""), "Unknown").otherwise(out)
