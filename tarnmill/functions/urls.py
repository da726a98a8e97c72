"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import squeeze

PLATFORMS = [("workday", r"myworkdayjobs|workday\."), ("greenhouse", r"greenhouse\.io"), ("lever", r"lever\.co"), ("ashby", r"ashbyhq"), ("org", r"\.org(/|$)"), ("net", r"\.net(/|$)"), ("com", r"\.com(/|$)")]


def clean_url(url: Column, keep_www: bool = False) -> Column:
    """Lower case without query, fragment, trailing slashes and, unless kept, www."""
    c = F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", "")
    c = F.regexp_replace(c, r"/+$", "")
    return F.coalesce(c if keep_www else F.regexp_replace(c, r"://www\.", "://"), F.lit(""))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)


def subdomain(url: Column) -> Column:
    return F.regexp_extract(host(url), r"^(.*?)\.?[^.]+\.[^.]+$", 1)


def platform(url: Column) -> Column:
    low, out = F.lower(url), F.lit("generic")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def title_from_url(url: Column) -> Column:
    """Words of the last path segment, ids in front and behind removed; '' for too little."""
    last = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    words = squeeze(F.regexp_replace(F.regexp_replace(last, r"(^\d+[-_])|([-_]\d+$)", ""), r"[-_]+", " "))
    return F.when(F.length(words) >= 4, F.initcap(words)).otherwise("")


def job_id_from_url(url: Column) -> Column:
    """First id found by the patterns in order."""
    patterns = [r"[?&](?:jk|gh_jid|jobid|page)=([A-Za-z0-9-]+)", r"/jobs?/(\d{4,})", r"/(\d+)(?:[/?#]|$)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns], F.lit("N/A"))


def language_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/]+/([a-z]{2})(?:/|$)", 1)


def posting_fault(url: Column) -> Column:
    """Why a URL can't be a posting, or null."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(~low.rlike(r"^https?://"), "not http")
        .when(low.rlike(r"(linkedin|facebook|twitter)\.com"), "blocked site")
        .when(low.rlike(r"unsubscribe|/login|/signin|privacy"), "service page")
        .when(F.length(path(url)) <= 1, "no path")
    )


def strip_params(url: Column, names: list[str]) -> Column:
    """The URL without some query parameters."""
    c = F.regexp_replace(url, "(?<=[?&])(?:" + "|".join(names) + ")=[^&#]*&?", "")
    return F.regexp_replace(c, r"[?&](#|$)", "$1")


def search_url(base: str, words: Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(words), F.lit("+"), F.lit("%20")))


def redirect_guard(asked: Column, got: Column) -> Column:
    """Where a fetch ended, unless that is another site: then what was asked for."""
    a, b = host(asked), host(got)
    same = (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)) | (domain(asked) == domain(got))
    return F.when(same, got).otherwise(asked)


def known_company(url: Column, sites: list[tuple[str, str]]) -> Column:
    """Company of the first pattern that the URL matches, of a short list of (pattern, name)."""
    return F.coalesce(*[F.when(F.lower(url).rlike(pattern), name) for pattern, name in sites])


def board_slug(url: Column) -> Column:
    """Slug of a company on a board: the first path segment, or the first label of a tenant's host."""
    tenant = F.regexp_extract(F.lower(url), r"^https?://([a-z0-9-]+)\.(?:wd\d+\.)?myworkdayjobs\.com", 1)
    in_path = F.regexp_extract(F.lower(url), r"^https?://(?:boards|jobs|apply)\.[^/]+/([a-z0-9-]+)", 1)
    return F.coalesce(F.nullif(tenant, F.lit("")), F.nullif(in_path, F.lit("")))


BOARD_HOSTS = r"greenhouse|lever\.co|myworkdayjobs|ashbyhq|smartrecruiters|workable|icims|jobvite|bamboohr|rippling"


def is_posting(url: Column) -> Column:
    """Whether a salvaged URL is a posting on a known board: a path or token of jobs, and none of the pages about them."""
    low = F.lower(F.coalesce(url, F.lit("")))
    jobs = low.rlike(r"/(?:jobs?|external|embed|postings?)/|token=|gh_jid=")
    other = low.rlike(r"/(?:about|accessibility|article|blog|canada|contact|diversity|inclusion|introduceyourself|news|press|privacy|rewards|wellness)(?:[/?#]|$)")
    return low.startswith("http") & low.rlike(BOARD_HOSTS) & jobs & ~other
