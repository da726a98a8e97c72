"""Decisions on whole postings, composed of the library's columns: what to accept, audit, rescue and write to."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions import places, postings, text, urls
from tarnmill.operators.restrictions import restriction
from tarnmill.operators.rules import cascade, hourly_pay

Row = dict[str, Column]
LEAST_PAY = 25
OLDEST = 30


def _has(x: Column) -> Column:
    return x.isNotNull() & ~F.lower(F.trim(x)).isin("", "unknown", "n/a", "na")


def acceptance_score(row: Row, penalise_unknown: bool = True) -> Column:
    """Points for a company (3), a place (2, or -1 without one in one variant), an id (1) and a title of ordinary length
    (1); none without company and title. Accepted from 4."""
    company = F.coalesce(_has(row["company"]) & (F.length(row["company"]) > 2), F.lit(False))
    id_ = F.coalesce(_has(row["job_id"]) & ~row["job_id"].startswith("HASH_"), F.lit(False))
    n = F.coalesce(F.length(row["title"]), F.lit(0))
    score = F.when(company, 3).otherwise(0) + F.when(F.coalesce(_has(row["location"]), F.lit(False)), 2).otherwise(-1 if penalise_unknown else 0) + F.when(id_, 1).otherwise(0) + F.when((n > 15) & (n < 120), 1).otherwise(0)
    return F.when(~F.coalesce(_has(row["company"]), F.lit(False)) & (n < 5), 0).otherwise(score) if penalise_unknown else score


def gates(row: Row, blacklist: list[str]) -> list[tuple[str, Column]]:
    """Checks that need no page, in order."""
    return [
        ("bad url", urls.posting_fault(row["url"]).isNotNull()),
        ("blacklisted company", F.lower(F.trim(row["company"])).isin([b.lower() for b in blacklist])),
        ("company", F.coalesce(postings.company_fault(row["company"]), F.lit("")) != ""),
        ("title not for beginners", ~F.coalesce(postings.early_career(row["title"]), F.lit(False))),
        ("title not technical", ~postings.is_technical(row["title"])),
        ("season", postings.season_fault(row["title"], F.lit("")).isNotNull()),
        ("students of the university only", postings.university_only(row["company"], row["title"])),
    ]


def page_checks(row: Row) -> list[tuple[str, Column]]:
    """Checks of the page, in order."""
    return [
        ("dead page", postings.dead_page(row["url"], row["page"])),
        ("too old", row["age"] > OLDEST),
        ("restricted", restriction(row["page"]).isNotNull()),
        ("low pay", F.array_max(hourly_pay(row["page"])) < LEAST_PAY),
    ]


def row_decision(row: Row, duplicate: Column, blacklist: list[str]) -> Column:
    """Reason why a posting is discarded, or null: gates, a duplicate, its place, its page, and last its score. With the
    page's restriction named."""
    abroad = places.abroad(row["location"], row["title"], row["url"], row["page"])
    rules = [*gates(row, blacklist), ("duplicate", duplicate), ("abroad", abroad.isNotNull()), *page_checks(row), ("score", acceptance_score(row) < 4)]
    first = cascade(rules)
    return F.when(first == "restricted", F.concat(F.lit("restricted: "), restriction(row["page"]))).otherwise(first)


def feed_decision(row: Row, duplicate: Column, blacklist: list[str]) -> Column:
    """The same checks in the order for rows of a feed, whose hints are trusted first: age and place go before the gates
    on titles, and the season of the page counts too."""
    abroad = places.abroad(row["location"], row["title"])
    g = gates(row, blacklist)
    season = ("season of the page", postings.season_fault(row["title"], row["page"]).isNotNull())
    rules = [("too old", row["age"] > 3), g[1], ("duplicate", duplicate), ("abroad", abroad.isNotNull()), g[0], *g[2:], *page_checks(row)[::2], season, ("low pay", F.array_max(hourly_pay(row["page"])) < LEAST_PAY)]
    return cascade(rules)


STAFFING = r"staffing|recruit(?:ing|ment) agency|temp agency|personnel services|talent outsourcing"
OTHER_TITLES = r"business development|account executive|customer success|real estate|interior design|(?:mechanical|civil) engineer|\bnurse\b|physician|pharmacist|truck driver|warehouse|forklift|venture capital|field sales|sales engineer"


def quality_issues(row: Row, cleared: list[str], fixes: dict[str, str], boards: str, shifted: Column, repeated: Column) -> dict[str, Column]:
    """action (delete, fix or flag), issue and value of the first of eleven checks of a kept row that has one: what is
    deleted comes first, then what can be put right, then what is only reported.

    shifted: one of three neighbours with one title; repeated: an id that the company has had."""
    low = F.lower(row["company"])
    domain = F.regexp_extract(urls.domain(row["url"]), r"^([^.]+)", 1)
    key, site = text.alnum_key(row["company"]), text.alnum_key(domain)
    names = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
    fixed = F.try_element_at(names, low)
    url_id = urls.job_id_from_url(row["url"])
    place = F.regexp_extract(row["location"], r"^([A-Z]{2})\s+([A-Z][a-z].+)$", 1)
    turned = F.concat(F.regexp_extract(row["location"], r"^([A-Z]{2})\s+([A-Z][a-z].+)$", 2), F.lit(", "), place)
    search = row["url"].startswith("search:")
    act = lambda action, issue, value=None: F.struct(F.lit(action).alias("action"), F.lit(issue).alias("issue"), (F.lit(None).cast("string") if value is None else value).alias("value"))
    checks = [
        (F.lower(row["title"]).rlike(OTHER_TITLES), act("delete", "other title")),
        (low.rlike("|".join(map(re.escape, cleared))) if cleared else F.lit(False), act("delete", "clearance company")),
        (low.rlike(STAFFING), act("delete", "staffing agency")),
        (shifted, act("delete", "row shift")),
        (repeated, act("delete", "repeated id")),
        (fixed.isNotNull() & (fixed != row["company"]), act("fix", "company name", fixed)),
        (~_has(row["job_id"]) & (url_id != "N/A") & ~search, act("fix", "id from url", url_id)),
        (search & ~F.contains(row["url"], F.lit("?q=")), act("fix", "search link", urls.search_url("search:?q=", F.concat_ws(" ", row["company"], row["title"])))),
        (search & ~F.contains(F.lower(row["url"]), F.replace(low, F.lit(" "), F.lit("%20"))), act("fix", "search link of another company", urls.search_url("search:?q=", F.concat_ws(" ", row["company"], row["title"])))),
        (places.garbage(row["location"]) & _has(row["location"]) & (place == ""), act("fix", "garbage location", F.lit("Unknown"))),
        (place.isin(list(places.STATES.values())), act("fix", "state first", turned)),
        (~search & (F.length(site) > 3) & ~F.contains(key, site) & ~F.contains(site, key) & ~domain.rlike(boards), act("flag", "url of another company", domain)),
    ]
    first = F.coalesce(*[F.when(test, what) for test, what in checks])
    return {"action": first["action"], "issue": first["issue"], "value": first["value"]}


def rescue(row: Row, trusted: Column, applied: Column, always_cleared: Column) -> Column:
    """Why a discarded row deserves another look, or null: a clearance that a trusted company, or one that was applied
    to, doesn't need; a place that is in the US after all; a technical title; a technical title of a company that was
    applied to. Not after 60 days, nor for companies that always want clearance, nor for what is plainly abroad."""
    why = F.lower(row["reason"])
    place_reason = why.rlike("international|canada|abroad|location")
    home = (places.state_code(F.coalesce(row["location"], F.lit(""))) != "") & places.in_us(row["location"])
    technical = postings.is_technical(row["title"])
    rules = [
        ("trusted company", why.rlike("clearance|security") & trusted), ("applied before", why.rlike("clearance|security") & applied), ("us after all", place_reason & home),
        ("technical title", why.rlike("not a? ?cs|non-tech|not technical") & technical), ("company applied to", applied & technical & ~place_reason & ~why.rlike("clearance|security")),
    ]
    return F.when((row["age"] <= 60) & ~always_cleared, cascade(rules))


SEND_FROM = 75


def address_verdict(address: Column, seen: dict[str, Column], threshold: Column | None = None) -> dict[str, Column]:
    """confidence, status, source and send_ok of an address from what is known of it.

    seen: mx (whether the domain takes mail), provider (exists, not_exists or unknown), catch_all, smtp (safe, risky or
    unknown) and hint (where it is from). Gates in order: a suspicious address, no mail server, the provider's word, the
    server's word (which means little where all is caught), then the hint alone; a guess is never sent to. The domain's
    own threshold, raised by bounces, counts where it is higher."""
    least = F.greatest(F.lit(SEND_FROM), F.coalesce(threshold, F.lit(0))) if threshold is not None else F.lit(SEND_FROM)
    known = F.coalesce(seen["hint"].isin("pattern_cache", "api_verified", "website_mining"), F.lit(False))
    v = lambda confidence, status, source: F.struct((F.lit(confidence) if isinstance(confidence, int) else confidence).alias("confidence"), F.lit(status).alias("status"), F.lit(source).alias("source"))
    first = (
        F.when(postings.suspicious_address(address), v(0, "rejected", "suspicious"))
        .when(~F.coalesce(seen["mx"], F.lit(False)), v(0, "rejected", "no mail server"))
        .when(seen["provider"] == "exists", v(F.when(seen["hint"] == "pattern_guess", 85).otherwise(90), "verified", "provider"))
        .when(seen["provider"] == "not_exists", v(0, "rejected", "provider"))
        .when((seen["smtp"] == "safe") & seen["catch_all"], v(50, "manual_review", "catch-all"))
        .when(seen["smtp"] == "safe", v(F.when(known, 80).otherwise(75), "verified", "smtp"))
        .when(seen["smtp"] == "risky", v(40, "manual_review", "smtp"))
        .when(seen["hint"] == "api_verified", v(85, "verified", "api"))
        .when(known, v(50, "manual_review", "hint"))
        .otherwise(v(30, "manual_review", "guess"))
    )
    return {"confidence": first["confidence"], "status": first["status"], "source": first["source"], "send_ok": first["confidence"] >= least}
