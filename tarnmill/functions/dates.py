"""Date functions as columns; the as-of day is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy", "dd MMMM yyyy", "MMM d, yyyy"]


def parse_date(x: Column) -> Column:
    """First of the formats that fits; null if none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in FORMATS])


def parse_yearless(x: Column, as_of: Column) -> Column:
    """'27 Apr' or 'Apr 27' in the year up to the as-of day; anything else as parse_date."""
    day = F.regexp_extract(x, r"(?:^|\s)(\d{1,2})(?:\D|$)", 1)
    month = F.regexp_extract(x, r"([A-Za-z]{3})[A-Za-z]*", 1)
    this = F.to_date(F.try_to_timestamp(F.concat_ws(" ", day, F.initcap(month), F.year(as_of).cast("string")), F.lit("d MMM yyyy")))
    rolled = F.when(this > as_of, F.add_months(this, -12)).otherwise(this)
    return F.when(F.trim(x).rlike(r"^(\d{1,2} [A-Za-z]{3,9}|[A-Za-z]{3,9} \d{1,2})$"), rolled).otherwise(parse_date(x))


def relative_days(x: Column) -> Column:
    """Age in days of phrases such as '3 days ago', '2mo', '30+ days', 'yesterday', '5h'; null for none or over a year."""
    low = F.lower(F.trim(x))
    n = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("int")
    days = (
        F.when(low.rlike(r"today|just now|\d+\s*(h|hours?|hrs?|minutes?|min)\b"), 0)
        .when(F.contains(low, F.lit("yesterday")), 1)
        .when(low.rlike(r"\d+\s*\+?\s*(mo|months?)\b"), n(r"(\d+)\s*\+?\s*mo") * 30)
        .when(low.rlike(r"\d+\s*(w|weeks?)\b"), n(r"(\d+)\s*w") * 7)
        .when(low.rlike(r"\d+\+\s*(d|days?)\b"), n(r"(\d+)\+") + 1)
        .when(low.rlike(r"\d+\s*(d|days?)\b"), n(r"(\d+)\s*d"))
    )
    return F.when(days <= 365, days)


def next_send(at: Column) -> Column:
    """Nine o'clock of the same day, or of the next if it is past, moved on from weekends to Monday."""
    day = F.when(F.hour(at) >= 9, F.date_add(F.to_date(at), 1)).otherwise(F.to_date(at))
    shift = F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0)
    return F.date_add(day, shift)


def warmup_limit(day: Column, steps: list[tuple[int, int]]) -> Column:
    """The limit of the last step that began: an as-of look-up in a short list."""
    out = F.lit(0)
    for start, limit in steps:
        out = F.when(day >= start, limit).otherwise(out)
    return out


ZONES = [("seattle", "America/Los_Angeles"), ("denver", "America/Denver"), ("chicago", "America/Chicago")]


def zone_of(place: Column, other: str = "America/New_York") -> Column:
    """Time zone of the first known city that a place names."""
    low = F.lower(F.coalesce(place, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(c)), z) for c, z in ZONES], F.lit(other))


def hours_since(x: Column, now: Column) -> Column:
    """Hours from a time in ISO form, UTC if it names no zone, to now."""
    at = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.round((now.cast("timestamp").cast("double") - at.cast("double")) / 3600, 2)


def interval_due(last: Column, now: Column, seconds: int) -> Column:
    return F.coalesce(F.timestamp_diff("SECOND", last, now) >= seconds, F.lit(True))
