"""Dedup of a batch against what is known, by ordered checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import text, urls
from tarnmill.functions.text import chain
from tarnmill.operators.similarity import resembling, vectors

#: Days for which an id in the registry counts, and the score from which titles of one company are the same.
REGISTRY_DAYS = 90
SAME_TITLE = 0.9

REASONS = ["id in registry", "id in batch", "url", "company and title", "similar title", "known id"]


def company_key(company: Column) -> Column:
    """A company without its legal form and what is in brackets at its end."""
    return F.trim(chain(company, (r"(?i),?\s*(?:inc|llc|ltd|corp|l\.?p)\.?\s*$", ""), (r"\s*\([^)]+\)\s*$", "")))


def pair_key(company: Column, title: Column) -> Column:
    return F.concat_ws("_", text.alnum_key(company_key(company)), text.alnum_key(title))


def duplicates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """(id, duplicate_of) of every posting of the batch: the first reason, in order, for which it is one, or null.

    Both have (id, company, title, url, job_id, at); the batch is ordered by id. A registry id counts for 90 days; ids,
    URLs and pairs of company and title are sought in the history and earlier in the batch; titles of one company that
    resemble one of the history by TF-IDF to 0.9; ids of the history without a limit come last. Ids that are blank, N/A
    or hashes are none. Nulls never match.

    All keys are one column of (kind, value): one shuffle finds the first that has each, whatever the number of checks;
    counts are partial before it, so a common key is no hot one."""
    id_ = F.when(~F.upper(F.trim("job_id")).isin("", "N/A") & ~F.col("job_id").startswith("HASH_"), F.nullif(text.normalize_job_id(F.col("job_id")), F.lit("")))
    keys = {"id": id_, "url": urls.clean_url(F.col("url")), "pair": F.when(F.col("company").isNotNull() & F.col("title").isNotNull(), pair_key(F.col("company"), F.col("title")))}

    def keyed(rows: DataFrame, mine: bool) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in keys.items()])).alias("k")
        return rows.select("id", "at", each, F.lit(mine).alias("mine")).select("id", "at", "k.*", "mine").where("value is not null")

    own = keyed(batch, True)
    known = own.unionByName(keyed(history, False)).groupBy("kind", "value").agg(
        F.max(F.when(~F.col("mine"), F.col("at"))).alias("last"), F.count_if(~F.col("mine")).alias("before"), F.min(F.when(F.col("mine"), F.col("id"))).alias("first")
    )
    seen = own.join(known, ["kind", "value"])
    earlier, is_ = F.col("first") < F.col("id"), lambda k: F.col("kind") == k
    recent = F.col("last") >= F.col("at") - F.expr(f"INTERVAL {REGISTRY_DAYS} DAYS")
    hit = (
        F.when(is_("id") & recent, 0).when(is_("id") & earlier, 1).when(is_("url") & ((F.col("before") > 0) | earlier), 2)
        .when(is_("pair") & ((F.col("before") > 0) | earlier), 3).when(is_("id") & (F.col("before") > 0), 5)
    )
    found = seen.select("id", hit.alias("hit")).where("hit is not null")
    both = batch.select("id", "company", "title", F.lit(True).alias("mine")).unionByName(history.select("id", "company", "title", F.lit(False).alias("mine")))
    key = F.concat(F.when(F.col("mine"), "b").otherwise("h"), F.col("id").cast("string"))
    titled = both.where("company is not null and title is not null").select(key.alias("id"), "company", "title")
    near = resembling(vectors(titled, "id", "title", ["company"]), SAME_TITLE, "company", F.col("id").startswith("b"))
    kind = batch.schema["id"].dataType
    found = found.unionByName(near.select(F.substring("left_id", 2, 99).cast(kind).alias("id"), F.lit(4).alias("hit")))
    first = found.groupBy("id").agg(F.min("hit").alias("hit"))
    names = F.array(*map(F.lit, REASONS))
    return batch.select("id").join(first, "id", "left").select("id", F.get(names, F.col("hit")).alias("duplicate_of"))
