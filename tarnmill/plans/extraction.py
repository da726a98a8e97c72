"""Fields out of pages, and votes between ways to get them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import html, urls
from tarnmill.functions.text import squeeze
from tarnmill.plans.registry import register
from tarnmill.plans.texts import seeded, seeded_sql
from tarnmill.sources.tables import table


def vote(candidates: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """(key, value, confidence) by confidence vote of candidates (key, seq, value, confidence): equal values, apart from
    case and blanks, add up their confidences; the best group's most confident member wins, ties go to the first seen."""
    fine = candidates.where((F.col("confidence") >= least) & (F.trim("value") != "") & ~F.lower("value").isin("unknown", "n/a"))
    g = fine.groupBy(key, F.lower(F.trim("value")).alias("__v")).agg(F.round(F.sum("confidence") * 1.2, 9).alias("weight"), F.min("seq").alias("first"), F.max_by(F.struct("value", "confidence"), F.struct("confidence", (-F.col("seq")).alias("s"))).alias("best"))
    return g.groupBy(key).agg(F.max_by("best", F.struct("weight", (-F.col("first")).alias("f"))).alias("b")).select(key, F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"))


_U = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&ndash;', '-'), '&mdash;', '-'), '&amp;', '&')"
_TITLE = r"trim(regexp_replace(" + _U.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '\s+', ' ', 'g'))"
_H1 = r"trim(regexp_replace(" + _U.format(r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@register("col08_titles", f"SELECT page_id, {_TITLE} AS title, {_H1} AS heading FROM pages")
def col08(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.heading(F.col("html")).alias("heading"))


@register("col09_page_text", r"SELECT page_id, left(lower(trim(regexp_replace(" + _U.format(r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))), 15000) AS text FROM pages")
def col09(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


@register("col26_links", """SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1))) AS links, regexp_extract(html, '<a href="([^"]+)"', 1) AS first_link FROM pages""")
def col26(spark, sf):
    l = html.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(l).cast("long").alias("links"), F.coalesce(F.try_element_at(l, F.lit(1)), F.lit("")).alias("first_link"))


@register(
    "col01_confidence_vote",
    rf"WITH c AS (SELECT page_id, 1 AS seq, {_TITLE} AS value, 0.8 AS confidence FROM pages UNION ALL SELECT page_id, 2, left({_H1}, 60), 0.9 FROM pages UNION ALL SELECT page_id, 3, {_H1}, 0.7 FROM pages UNION ALL SELECT page_id, 4, 'noise', 0.5 FROM pages), g AS (SELECT page_id, lower(trim(value)) AS v, round(sum(confidence) * 1.2, 9) AS weight, min(seq) AS first, max_by(value, confidence * 100 - seq) AS value, max(confidence)::DOUBLE AS confidence FROM c WHERE confidence >= 0.6 AND trim(value) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, first) AS i FROM g) SELECT page_id, value, confidence FROM r WHERE i = 1",
)
def col01(spark, sf):
    p = table(spark, sf, "pages")
    t, h = html.title(F.col("html")), html.heading(F.col("html"))
    one = lambda seq, value, c: F.struct(F.lit(seq).alias("seq"), value.alias("value"), F.lit(c).alias("confidence"))
    c = p.select("page_id", F.explode(F.array(one(1, t, 0.8), one(2, F.substring(h, 1, 60), 0.9), one(3, h, 0.7), one(4, F.lit("noise"), 0.5))).alias("c")).select("page_id", "c.*")
    return vote(c, "page_id")


LD = '<html><meta property="og:title" content="{w} &amp; Ops"><script type="application/ld+json">{"title":"{w} dev","hiringOrganization":{"name":"{w}"},"jobLocation":{"address":{"addressLocality":"Reno"}},"identifier":{"value":"R-7"}}</script></html>'


@register("col06_json_ld_meta", seeded_sql([("{w} dev", "{w}", "Reno", "R-7", "{w} &amp; Ops"), (None, None, None, None, None)], "title, company, city, job_id, og"))
def col06(spark, sf):
    p = seeded(spark, sf, [(LD,), ("<p>{w}</p>",)], "html string")
    j = html.json_ld(F.col("html"))
    return p.select("doc_id", j["title"].alias("title"), j["company"].alias("company"), j["city"].alias("city"), j["id"].alias("job_id"), html.meta(F.col("html"), "og:title").alias("og"))


TABLES = '<h2>Software</h2><table><tr><th>C</th></tr><tr> <td>{w}</td> <td>Dev <b>{l}</b></td> <td class="l"><a href="https://x/1">go</a></td> </tr> <tr class="odd"><td>B &amp; C</td><td>QA</td><td id="e"></td></tr></table><h2>Data</h2><table><tr><td>D</td></tr></table>'


@register("col16_html_tables", seeded_sql([("Software", "{w}|Dev {l}|go", "https://x/1"), ("Software", "B & C|QA|", ""), ("Data", "D", "")], "section, row, url", of=[0, 0, 0], n=2))
def col16(spark, sf):
    p = seeded(spark, sf, [(TABLES,), (None,)], "html string")
    return html.table_rows(p, "doc_id", "html").select("doc_id", "section", F.array_join("cells", "|").alias("row"), "url")


@register("url05_reconcile", r"WITH p AS (SELECT page_id, split_part(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '.', 1) AS co, 'h' || (page_id % 2) AS given FROM pages) SELECT page_id, co AS company, given AS was FROM p WHERE co <> given")
def url05(spark, sf):
    """Rows whose company was taken from the URL instead, with what it was: the corrections of a run."""
    host = urls.host(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", F.substring_index(host, ".", 1).alias("company"), F.concat(F.lit("h"), (F.col("page_id") % 2).cast("string")).alias("was"))
    return p.where(squeeze(F.col("company")) != F.col("was"))
