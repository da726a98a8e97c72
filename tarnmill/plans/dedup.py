"""Keep-first dedup and title similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnmill.functions.text import alnum_key, tokenize
from tarnmill.operators.similarity import similar_pairs, term_weights, vectors
from tarnmill.plans.registry import register
from tarnmill.plans.texts import STOP
from tarnmill.sources.tables import TITLES_SQL, titles

_K = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_TOKENS = rf"""{TITLES_SQL}, tok AS (SELECT doc_id AS id, company, list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({STOP})) AS t FROM titles),
 terms AS (SELECT id, company, len(t) AS len, unnest(t) AS term FROM tok WHERE len(t) > 0), tf AS (SELECT id, company, len, term, count(*) AS c FROM terms GROUP BY ALL), n AS (SELECT count(*) AS n FROM tok WHERE len(t) > 0),
 idf AS (SELECT term, ln((n + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tf, n GROUP BY term, n), raw AS (SELECT id, company, term, c / len::DOUBLE * idf AS x FROM tf JOIN idf USING (term)),
 w AS (SELECT id, company, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw),
 pairs AS (SELECT a.id AS left_id, b.id AS right_id, round(sum(a.weight * b.weight), 4) AS score FROM w a JOIN w b ON a.company = b.company AND a.term = b.term AND a.id < b.id GROUP BY 1, 2)"""


def _vectors(spark, sf):
    return vectors(titles(spark, sf), "doc_id", "title", ["company"])


@register("k07_keep_first", rf"WITH {TITLES_SQL}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY {_K.format('title')} ORDER BY doc_id) AS i FROM titles) SELECT doc_id FROM r WHERE i = 1")
def k07(spark, sf):
    t = titles(spark, sf).select("doc_id", alnum_key(F.col("title")).alias("key"))
    return t.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register(
    "k09_two_keys",
    rf"WITH {TITLES_SQL}, a AS (SELECT doc_id, company, title, row_number() OVER (PARTITION BY {_K.format('title')} ORDER BY doc_id) AS i FROM titles), b AS (SELECT doc_id, row_number() OVER (PARTITION BY company, left({_K.format('title')}, 10) ORDER BY doc_id) AS i FROM a WHERE i = 1) SELECT doc_id FROM b WHERE i = 1",
)
def k09(spark, sf):
    """First by one key, then of those the first by another: passes in order, so that the outcome is defined."""
    t = titles(spark, sf).select("doc_id", "company", alnum_key(F.col("title")).alias("key"))
    first = t.groupBy("key").agg(F.min_by(F.struct("doc_id", "company"), "doc_id").alias("x")).select("key", "x.*")
    return first.groupBy("company", F.substring("key", 1, 10)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("m05_term_weights", rf"WITH {_TOKENS} SELECT id, term, round(weight, 4) AS weight FROM w")
def m05(spark, sf):
    return term_weights(titles(spark, sf), "doc_id", "title").select("id", "term", F.round("weight", 4).alias("weight"))


@register("u09_near_duplicates", rf"WITH {_TOKENS} SELECT * FROM pairs WHERE score >= 0.85")
def u09(spark, sf):
    return similar_pairs(_vectors(spark, sf), 0.85, "company")


@register("srt03_similar_titles", rf"WITH {_TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS i FROM pairs WHERE score >= 0.4) SELECT left_id, right_id, score FROM r WHERE i <= 5")
def srt03(spark, sf):
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return similar_pairs(_vectors(spark, sf), 0.4, "company").withColumn("i", F.row_number().over(w)).where("i <= 5").drop("i")


@register("u10_similarity_stats", rf"WITH {_TOKENS} SELECT (SELECT count(*) FROM tok WHERE len(t) > 0) AS docs, (SELECT count(DISTINCT term) FROM terms) AS vocabulary, (SELECT round(avg(len(t)), 3) FROM tok WHERE len(t) > 0) AS mean_tokens")
def u10(spark, sf):
    tokens = titles(spark, sf).select(tokenize(F.col("title")).alias("t")).where(F.size("t") > 0)
    a = tokens.agg(F.count("*").alias("docs"), F.round(F.avg(F.size("t")), 3).alias("mean_tokens"))
    b = tokens.select(F.explode("t").alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
    return a.crossJoin(b).select("docs", "vocabulary", "mean_tokens")
