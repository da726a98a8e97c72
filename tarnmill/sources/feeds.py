"""Decoding of feeds: boards in JSON, tables in Markdown, lines of logs, tabs of sheets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the payload of each kind of board; location is text or an object, so it is read as raw JSON.
BOARDS = {
    "greenhouse": "jobs array<struct<title:string,absolute_url:string,id:string,location:string>>",
    "lever": "array<struct<text:string,hostedUrl:string,applyUrl:string,id:string,categories:struct<location:string>>>",
    "ashby": "jobs array<struct<title:string,id:string,location:string,locationName:string>>",
    "workday": "jobPostings array<struct<title:string,externalPath:string,locationsText:string,bulletFields:array<string>>>",
    "workable": "results array<struct<title:string,shortcode:string,location:string>>",
    "rippling": "array<struct<name:string,url:string,uuid:string,workLocation:struct<label:string>>>",
    "smartrecruiters": "content array<struct<name:string,id:string,location:struct<city:string,region:string,country:string>>>",
}


def _named(x: Column) -> Column:
    """Text, or the name inside an object."""
    return F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.label"), x)


def board(payloads: DataFrame, kind: str) -> DataFrame:
    """(company, title, location, url, job_id) of payloads (company, slug, body); broken payloads give no rows."""
    parsed = payloads.select("company", "slug", F.from_json("body", BOARDS[kind], {"mode": "PERMISSIVE"}).alias("p"))
    rows = parsed.select("company", "slug", F.explode(F.col("p") if BOARDS[kind].startswith("array") else F.col("p")[BOARDS[kind].split()[0]]).alias("j"))
    if kind == "greenhouse":
        return rows.select("company", "j.title", _named(F.col("j.location")).alias("location"), F.col("j.absolute_url").alias("url"), F.col("j.id").alias("job_id"))
    if kind == "lever":
        return rows.select("company", F.col("j.text").alias("title"), F.col("j.categories.location").alias("location"), F.coalesce(F.nullif("j.hostedUrl", F.lit("")), "j.applyUrl").alias("url"), F.col("j.id").alias("job_id"))
    if kind == "ashby":
        return rows.select("company", "j.title", F.coalesce("j.location", "j.locationName").alias("location"), F.concat_ws("/", F.lit("https://jobs.ashbyhq.com"), "slug", "j.id").alias("url"), F.col("j.id").alias("job_id"))
    if kind == "workday":
        ids = F.filter("j.bulletFields", lambda b: b.rlike("^[-_A-Z0-9]{4,20}$"))
        found = rows.select("company", "j.title", F.col("j.locationsText").alias("location"), F.concat(F.lit("https://"), "slug", F.lit(".example.com"), "j.externalPath").alias("url"), F.coalesce(F.get(ids, 0), F.lit("N/A")).alias("job_id"))
        return found.dropDuplicates(["company", "url"])  # several searches find one posting
    if kind == "workable":
        place = F.coalesce(F.nullif(F.concat_ws(", ", F.get_json_object("j.location", "$.city"), F.get_json_object("j.location", "$.region")), F.lit("")), "j.location")
        return rows.select("company", "j.title", place.alias("location"), F.concat_ws("/", F.lit("https://apply.example.com"), "slug", "j.shortcode").alias("url"), F.col("j.shortcode").alias("job_id"))
    if kind == "rippling":
        return rows.select("company", F.col("j.name").alias("title"), F.col("j.workLocation.label").alias("location"), "j.url", F.col("j.uuid").alias("job_id"))
    place = F.nullif(F.concat_ws(", ", "j.location.city", "j.location.region"), F.lit(""))
    return rows.where(F.lower("j.location.country") == "us").select("company", F.col("j.name").alias("title"), F.coalesce(place, F.lit("Unknown")).alias("location"), F.concat_ws("/", F.lit("https://jobs.example.com"), "slug", "j.id").alias("url"), F.col("j.id").alias("job_id"))


def fan_in(feeds: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def hiring_lines(lines: DataFrame) -> DataFrame:
    """(company, location, title, url) of 'Company | Place | Title | ...' comments that speak of software."""
    head = F.split(F.substring_index("text", "\n", 1), r"\s*\|\s*")
    part = lambda i, n: F.substring(F.coalesce(F.trim(F.try_element_at(head, F.lit(i))), F.lit("")), 1, n)
    url = F.nullif(F.regexp_extract("text", r'https?://[^\s"<>|]+', 0), F.lit(""))
    return lines.where(F.lower("text").rlike("engineer|developer|software")).select(part(1, 50).alias("company"), part(2, 80).alias("location"), part(3, 50).alias("title"), F.coalesce(url, F.lit("none")).alias("url"))


def markdown_rows(lines: DataFrame, doc: str = "doc", order: str = "line") -> DataFrame:
    """(doc, line, company, title, location, url, age) of pipe tables; an arrow or a blank continues the last company,
    and closed rows are skipped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim("text").startswith("|")).withColumn("c", cells).where((F.size("c") >= 5) & ~F.col("c")[0].rlike("^:?-+") & (F.lower(F.col("c")[0]) != "company"))
    plain = F.regexp_replace(F.col("c")[0], r"\[([^\]]*)\]\([^)]*\)|\*+", "$1")
    own = F.when(~plain.isin("", "↳"), plain)
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    url = F.regexp_extract(F.array_join(F.slice("c", 4, 99), " "), r"\((https?://[^)\s]+)\)", 1)
    return rows.withColumn("company", F.last(own, ignorenulls=True).over(w)).where(~F.contains("text", F.lit("🔒"))).select(doc, order, "company", F.col("c")[1].alias("title"), F.col("c")[2].alias("location"), url.alias("url"), F.try_element_at("c", F.lit(-1)).alias("age"))


def recent_log_lines(lines: DataFrame, as_of: Column, hours: int) -> DataFrame:
    at = F.try_to_timestamp(F.regexp_extract("text", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.withColumn("at", at).where(F.col("at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def error_tail(lines: DataFrame, most: int = 5) -> DataFrame:
    return lines.where(F.contains("text", F.lit("| ERROR |"))).select("at", F.substring("text", 1, 120).alias("text")).orderBy(F.desc("at"), "text").limit(most)


def repair_header(names: list[str]) -> list[str]:
    """Blank names become _empty_<i>, later ones of the same name <name>_<n>."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        name = name.strip() or f"_empty_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name] - 1}")
    return out


def map_columns(tab: DataFrame, names: dict[str, str], source: str) -> DataFrame:
    """The known columns of a tab under their canonical names, whatever their case, with the tab's name as _src."""
    found = {c: names[re.sub(r"\s+", " ", c.strip().lower())] for c in tab.columns if re.sub(r"\s+", " ", c.strip().lower()) in names}
    return tab.select(*[F.col(f"`{c}`").alias(n) for c, n in found.items()], F.lit(source).alias("_src"))


def decode_row(cells: Column, layout: dict[str, int], defaults: dict[str, str]) -> dict[str, Column]:
    """Columns from positional cells; what is out of range or empty gets its default."""
    return {name: F.coalesce(F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")), F.lit(defaults.get(name, ""))) for name, i in layout.items()}


def backfill(tabs: dict[str, tuple[DataFrame, dict[str, int]]], defaults: dict[str, str]) -> DataFrame:
    """Facts from the rows (seq, cells) of several tabs, each with its layout and its name for outcome; rows whose first
    four cells are blank go."""
    parts = []
    for outcome, (tab, layout) in tabs.items():
        rows = tab.where(F.exists(F.slice("cells", 1, 4), lambda c: F.trim(c) != ""))
        parts.append(rows.select("seq", *[c.alias(n) for n, c in decode_row(F.col("cells"), layout, defaults).items()], F.lit(outcome).alias("outcome")))
    return fan_in(parts)


CORRECTIONS = "`from` string, `to` string, url string, ts string"


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines; lines that can't be read are left out."""
    return spark.read.schema(CORRECTIONS).option("mode", "DROPMALFORMED").json(path)


def salvage(files: DataFrame) -> DataFrame:
    """(object) JSON objects that can be read out of damaged files (text), one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            out, texts = [], batch.column(0).to_pylist()
            for text in texts:
                at = (text or "").find("{")
                while at >= 0:
                    try:
                        found, end = decoder.raw_decode(text, at)
                        out.append(json.dumps(found, sort_keys=True))
                    except ValueError:
                        end = at + 1
                    at = text.find("{", end)
            yield pa.record_batch([pa.array(out, pa.string())], names=["object"])

    return files.select("text").mapInArrow(run, "object string")


def known_keys(tabs: list[DataFrame], keys: dict[str, Column]) -> dict[str, DataFrame]:
    """Distinct values of each key over all tabs."""
    rows = fan_in(tabs)
    return {name: rows.select(key.alias(name)).where(F.col(name).isNotNull()).distinct() for name, key in keys.items()}
