"""Cascades of rules: ordered conditions, the first that holds gives the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]
STAGES: dict[str, Callable[[], Column]] = {}


def stage(name: str):
    """Registers a function that gives the reason for a rejection, or null."""

    def add(function: Callable[[], Column]) -> Callable[[], Column]:
        STAGES[name] = function
        return function

    return add


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that holds, or null. A null condition doesn't hold."""
    return F.coalesce(*[F.when(test, name) for name, test in rules])


def run_stages(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with stage and reason of the first registered stage that rejects; KeyError for an unknown name."""
    reasons = [(n, STAGES[n]()) for n in names]
    first = F.coalesce(*[F.when(r.isNotNull(), F.struct(F.lit(n).alias("stage"), r.alias("reason"))) for n, r in reasons])
    return rows.withColumn("__first", first).withColumns({"reject_stage": F.col("__first.stage"), "reject_reason": F.col("__first.reason")}).drop("__first")


def from_config(config: list[str | dict]) -> list[str]:
    """Names of the stages of a configuration: names, or maps with `name` and, maybe, `enabled`. ValueError for unknown ones."""
    names = [c if isinstance(c, str) else c["name"] for c in config if isinstance(c, str) or c.get("enabled", True)]
    if unknown := [n for n in names if n not in STAGES]:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    return names


def stage_metrics(decided: DataFrame) -> DataFrame:
    """(stage, rejects, rate) of what each stage rejected; 'passed' for the rest."""
    total = F.broadcast(decided.agg(F.count("*").alias("n")))
    counted = decided.groupBy(F.coalesce("reject_stage", F.lit("passed")).alias("stage")).agg(F.count("*").alias("rejects"))
    return counted.crossJoin(total).select("stage", "rejects", F.round(F.col("rejects") / F.col("n"), 4).alias("rate"))


WEIGHTS = {"company": 2.0, "title": 2.0, "location": 1.5, "url": 2.0, "job_id": 1.0, "salary": 0.5, "sponsorship": 1.0, "remote": 0.5}


def completeness(present: dict[str, Column]) -> dict[str, Column]:
    """score (weighted percent), grade and missing fields of a row from what is present in it."""
    missing = {k: ~F.coalesce(c, F.lit(False)) for k, c in present.items()}
    points = sum((F.when(missing[k], 0.0).otherwise(WEIGHTS[k]) for k in present), F.lit(0.0))
    score = F.round(points / sum(WEIGHTS.values()) * 100, 1)
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").when(score >= 25, "D").otherwise("F")
    return {"score": score, "grade": grade, "missing": F.array_compact(F.array(*[F.when(missing[k], k) for k in present]))}


def hourly_pay(page: Column) -> Column:
    """Numbers between 1 and 200 that are written as pay an hour."""
    found = F.regexp_extract_all(F.lower(page), F.lit(r"\$(\d{1,3}(?:\.\d{1,2})?)\s*(?:/|per|an)\s*h(?:ou)?r"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.cast("double")), lambda v: (v > 1) & (v < 200))


def contract_fault(row: dict[str, Column]) -> Column:
    """First broken rule of a posting record."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return cascade([
        ("company missing", blank(row["company"])),
        ("title missing", blank(row["title"])),
        ("url not http", ~F.coalesce(row["url"].rlike("^https?://"), F.lit(False))),
        ("company too long", F.length(row["company"]) > 100),
        ("title too long", F.length(row["title"]) > 200),
        ("resume type unknown", ~row["resume_type"].isin("SDE", "ML", "DA")),
        ("outcome unknown", ~row["outcome"].isin("reviewed", "duplicate", "valid", "discarded")),
    ])


def guarded(rows: DataFrame, moved: Column, most: float = 0.2) -> DataFrame:
    """Rows to be moved, or none at all if they are more than a share of all: one pass, decided in the plan."""
    share = rows.agg((F.count_if(moved) / F.greatest(F.count("*"), F.lit(1))).alias("__share"))
    return rows.where(moved).crossJoin(F.broadcast(share)).where(F.col("__share") <= most).drop("__share")
