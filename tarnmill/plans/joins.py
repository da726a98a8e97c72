"""Joins over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnmill.functions import urls
from tarnmill.functions.text import alnum_key
from tarnmill.operators import history, joins
from tarnmill.operators.restrictions import sponsorship
from tarnmill.plans.registry import register
from tarnmill.plans.texts import STOP
from tarnmill.sources.tables import AS_OF, JOBS_SQL, TITLES_SQL, as_of, jobs, table, titles

_K = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


_P = """p AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN source || ', Inc.' WHEN doc_id % 11 = 0 THEN source || ' (EU)' ELSE source END AS company, title, CASE WHEN doc_id % 3 = 0 THEN 'https://www.h.com/' || (doc_id % 400) || '/?x=' || doc_id ELSE 'https://h.com/d/' || doc_id END AS url,
 CASE WHEN doc_id % 5 = 0 THEN 'N/A' WHEN doc_id % 13 = 0 THEN 'HASH_1' ELSE 'R-00' || (doc_id % 900) END AS job_id, TIMESTAMP '2024-01-31' - (doc_id % 200) * INTERVAL 1 DAY AS at FROM (SELECT doc_id, company AS source, title FROM titles))"""


def _batch(spark, sf):
    """Postings out of the titles, with URLs and ids of which some repeat; the odd ones are the batch."""
    t = titles(spark, sf).select("doc_id", F.col("company").alias("source"), "title")
    at = F.lit("2024-01-31").cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("doc_id") % 200).cast("int"))
    return t.select(
        F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(source, ', Inc.') WHEN doc_id % 11 = 0 THEN concat(source, ' (EU)') ELSE source END").alias("company"), "title",
        F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('https://www.h.com/', doc_id % 400, '/?x=', doc_id) ELSE concat('https://h.com/d/', doc_id) END").alias("url"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'N/A' WHEN doc_id % 13 = 0 THEN 'HASH_1' ELSE concat('R-00', doc_id % 900) END").alias("job_id"), at.alias("at"),
    )


_CO = r"trim(regexp_replace(regexp_replace(company, '(?i),?\s*(?:inc|llc|ltd|corp|l\.?p)\.?\s*$', ''), '\s*\([^)]+\)\s*$', ''))"


@register(
    "j01_dedup_anti_join",
    rf"""WITH {TITLES_SQL}, {_P.replace("AS at FROM", 'AS "at" FROM')}, k AS (SELECT *, CASE WHEN job_id NOT IN ('', 'N/A') AND NOT starts_with(job_id, 'HASH_') THEN regexp_replace(lower(job_id), '[^a-z0-9]', '', 'g') END AS jid,
 regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', ''), '://www\.', '://') AS u, {_K.format(_CO)} || '_' || {_K.format('title')} AS pair FROM p),
 b AS (SELECT * FROM k WHERE id % 2 = 1), h AS (SELECT * FROM k WHERE id % 2 = 0),
 tok AS (SELECT id, company, list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({STOP})) AS t FROM p),
 terms AS (SELECT id, company, len(t) AS len, unnest(t) AS term FROM tok WHERE len(t) > 0), tf AS (SELECT id, company, len, term, count(*) AS c FROM terms GROUP BY ALL), n AS (SELECT count(*) AS n FROM tok WHERE len(t) > 0),
 idf AS (SELECT term, ln((n + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tf, n GROUP BY term, n), raw AS (SELECT id, company, term, c / len::DOUBLE * idf AS x FROM tf JOIN idf USING (term)),
 w AS (SELECT id, company, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw),
 near AS (SELECT DISTINCT id FROM (SELECT a.id, c.id AS other, round(sum(a.weight * c.weight), 4) AS score FROM w a JOIN w c ON a.company = c.company AND a.term = c.term WHERE a.id % 2 = 1 AND c.id % 2 = 0 GROUP BY 1, 2) WHERE score >= 0.9),
 ids AS (SELECT jid, max("at") AS last FROM h GROUP BY 1), fid AS (SELECT jid, min(id) AS first FROM b GROUP BY 1), fu AS (SELECT u, min(id) AS first FROM b GROUP BY 1), fp AS (SELECT pair, min(id) AS first FROM b GROUP BY 1)
 SELECT b.id, CASE WHEN ids.last >= b."at" - INTERVAL 90 DAY THEN 'id in registry' WHEN fid.first < b.id THEN 'id in batch' WHEN b.u IN (SELECT u FROM h) OR fu.first < b.id THEN 'url' WHEN b.pair IN (SELECT pair FROM h) OR fp.first < b.id THEN 'company and title'
 WHEN b.id IN (SELECT id FROM near) THEN 'similar title' WHEN ids.jid IS NOT NULL THEN 'known id' END AS duplicate_of FROM b LEFT JOIN ids ON ids.jid = b.jid LEFT JOIN fid ON fid.jid = b.jid LEFT JOIN fu ON fu.u = b.u LEFT JOIN fp ON fp.pair = b.pair""",
)
def j01(spark, sf):
    p = _batch(spark, sf)
    return history.duplicates(p.where("id % 2 = 1"), p.where("id % 2 = 0"))


@register("j01_two_keys", rf"WITH {TITLES_SQL}, t AS (SELECT doc_id, {_K.format('title')} AS key, left({_K.format('title')}, 12) AS stem FROM titles), h AS (SELECT * FROM t WHERE doc_id % 2 = 0) SELECT doc_id, CASE WHEN key IN (SELECT key FROM h) THEN 'key' WHEN stem IN (SELECT stem FROM h) THEN 'stem' END AS duplicate_of FROM t WHERE doc_id % 2 = 1")
def j01_two_keys(spark, sf):
    t = titles(spark, sf).select("doc_id", alnum_key(F.col("title")).alias("key")).withColumn("stem", F.substring("key", 1, 12))
    return joins.first_duplicate_reason(t.where("doc_id % 2 = 1"), t.where("doc_id % 2 = 0"), ["key", "stem"]).select("doc_id", "duplicate_of")


@register("j02_url_semi", r"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS u FROM pages) SELECT page_id FROM p WHERE page_id % 2 = 1 AND u IN (SELECT u FROM p WHERE page_id % 2 = 0)")
def j02(spark, sf):
    p = table(spark, sf, "pages").select("page_id", urls.clean_url(F.col("url"), keep_www=True).alias("u"))
    return p.where("page_id % 2 = 1").join(p.where("page_id % 2 = 0").select("u"), "u", "left_semi").select("page_id")


@register("j03_ttl_semi_join", "SELECT a.o_orderkey FROM orders a WHERE a.o_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey % 2 = 0 AND b.o_custkey = a.o_custkey AND b.o_orderdate <= a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 90 DAY)")
def j03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.semi_within(o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderdate", 90).select("o_orderkey")


_NAMED = f"{JOBS_SQL}, named AS (SELECT *, {_K.format("company")} || '_' || {_K.format("source || (k % 20)")} AS pair FROM jobs)"


def _named(spark, sf):
    """Jobs with titles out of source and id; company and title are spelt in several ways, which the key evens out."""
    company = F.expr("CASE id % 3 WHEN 0 THEN company WHEN 1 THEN concat(lower(company), ', Inc.') ELSE concat(company, ' (EU)') END")
    title = F.expr("CASE id % 2 WHEN 0 THEN concat(source, k % 20) ELSE concat(upper(source), ' - ', k % 20) END")
    return jobs(spark, sf).withColumn("pair", history.pair_key(company, title))


@register("j04_mutual_exclusion", f"WITH {_NAMED} SELECT id FROM named v WHERE outcome = 'valid' AND NOT EXISTS (SELECT 1 FROM named d WHERE d.outcome = 'discarded' AND d.pair = v.pair)")
def j04(spark, sf):
    """Valid rows whose pair of company and title, however written, isn't among the discarded."""
    j = _named(spark, sf)
    return j.where("outcome = 'valid'").join(j.where("outcome = 'discarded'").select("pair"), "pair", "left_anti").select("id")


@register("j05_applied_trigger", f"WITH {_NAMED} SELECT id FROM named r WHERE outcome = 'reviewed' AND EXISTS (SELECT 1 FROM named v WHERE v.outcome = 'valid' AND v.processing_time_ms >= 100 AND v.pair = r.pair)")
def j05(spark, sf):
    """Rows whose pair of company and title was applied to, however either is written."""
    j = _named(spark, sf)
    applied = j.where("outcome = 'valid' and processing_time_ms >= 100").select("pair")
    return j.where("outcome = 'reviewed'").join(applied, "pair", "left_semi").select("id")


@register(
    "j06_prioritised_lookup",
    "WITH f AS (SELECT l_orderkey AS ok, NULL AS ck, l_partkey AS x FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT NULL, o_custkey, o_orderkey FROM orders WHERE o_custkey % 2 = 0), a AS (SELECT ok, min(x) AS x FROM f WHERE ok IS NOT NULL GROUP BY 1), b AS (SELECT ck, min(x) AS x FROM f WHERE ck IS NOT NULL GROUP BY 1) SELECT o.o_orderkey, coalesce(a.x, b.x) AS x, CASE WHEN a.x IS NOT NULL THEN 'o_orderkey' WHEN b.x IS NOT NULL THEN 'o_custkey' END AS matched_by FROM orders o LEFT JOIN a ON a.ok = o.o_orderkey LEFT JOIN b ON b.ck = o.o_custkey",
)
def j06(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    f = l.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("ok"), F.lit(None).cast("long").alias("ck"), F.col("l_partkey").alias("x"))
    f = f.unionByName(o.where("o_custkey % 2 = 0").select(F.lit(None).cast("long").alias("ok"), F.col("o_custkey").alias("ck"), F.col("o_orderkey").alias("x")))
    return joins.prioritised(o.select("o_orderkey", "o_custkey"), f, [("o_orderkey", "ok"), ("o_custkey", "ck")], "x").select("o_orderkey", "x", "matched_by")


@register("j07_lookup_last", "WITH l AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) SELECT c_custkey, coalesce(p, 'none') AS priority FROM customer LEFT JOIN l ON o_custkey = c_custkey")
def j07(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_orderkey")
    return joins.lookup_last(c, o, ["c_custkey"], "priority", ["o_orderdate", "o_orderkey"], "none")


@register("j11_rescue_anti", f"WITH {JOBS_SQL}, r AS (SELECT id, company, k, row_number() OVER (PARTITION BY company, k ORDER BY id) AS i FROM jobs WHERE outcome = 'discarded' AND processing_time_ms >= 8) SELECT id FROM r WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM jobs v WHERE v.outcome = 'valid' AND v.company = r.company AND v.k = r.k)")
def j11(spark, sf):
    j = jobs(spark, sf)
    r = j.where("outcome = 'discarded' and processing_time_ms >= 8").groupBy("company", "k").agg(F.min("id").alias("id"))
    return r.join(j.where("outcome = 'valid'").select("company", "k"), ["company", "k"], "left_anti").select("id")


@register("j12_contains_join", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part WHERE p_partkey <= 5) d WHERE length(w) > 3 AND contains(lower(p_name), w))")
def j12(spark, sf):
    p = table(spark, sf, "part")
    stems = p.where("p_partkey <= 5").select(F.lower(F.substring_index("p_name", " ", 1)).alias("w")).where("length(w) > 3").distinct()
    return p.select("p_partkey", "p_name").join(joins.dimension(stems), F.contains(F.lower("p_name"), F.col("w")), "left_semi").select("p_partkey")


@register("j13_word_boundary_join", r"SELECT p.p_partkey, d.w FROM part p JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part WHERE p_partkey <= 8) d ON regexp_matches(lower(p_name), '\b' || w || '\b') OR regexp_matches(w, '\b' || regexp_replace(lower(p_name), '[^a-z0-9 ]', '.', 'g') || '\b')")
def j13(spark, sf):
    """Names of which one holds the other as whole words."""
    p = table(spark, sf, "part")
    names = p.where("p_partkey <= 8").select(F.lower(F.substring_index("p_name", " ", 1)).alias("w")).distinct()
    return p.select("p_partkey", "p_name").join(joins.dimension(names), joins.whole_words(F.col("p_name"), F.col("w"))).select("p_partkey", "w")


_LISTED = "SELECT DISTINCT lower(n_name) AS s FROM nation WHERE n_nationkey % 3 = 0"
_FIRMS = "f AS (SELECT c_custkey, c_acctbal, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' Works' WHEN 2 THEN 'The ' || n_name ELSE 'x' || n_name || 'x' END AS company FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _firms(spark, sf):
    """Companies whose names hold a nation's in different ways."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", "c_acctbal", F.expr("CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN concat(n_name, ' Works') WHEN 2 THEN concat('The ', n_name) ELSE concat('x', n_name, 'x') END").alias("company"))


def _listed(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("s")).distinct()


@register("j15_sponsor_list", f"WITH s AS ({_LISTED}), {_FIRMS} SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM s WHERE lower(company) = s OR length(s) > 3 AND (starts_with(lower(company), s || ' ') OR ends_with(lower(company), ' ' || s))) THEN 'Yes' WHEN c_acctbal < 0 THEN 'No' WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'Unknown' END AS sponsorship FROM f")
def j15(spark, sf):
    """Yes if the company is listed, or its name begins or ends with a listed one; else what the page says, No before Yes."""
    page = F.expr("CASE WHEN c_acctbal < 0 THEN 'without sponsorship' WHEN c_acctbal > 5000 THEN 'we will sponsor' ELSE '' END")
    firms = joins.listed(_firms(spark, sf), _listed(spark, sf), "company", "s", "is_listed")
    return firms.select("c_custkey", F.when(F.col("is_listed"), "Yes").otherwise(sponsorship(page)).alias("sponsorship"))


@register("j16_sponsor_enrich", f"WITH s AS ({_LISTED}), {_FIRMS} SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'No' WHEN EXISTS (SELECT 1 FROM s WHERE contains(lower(company), s)) THEN 'Yes' ELSE 'Unknown' END AS sponsorship FROM f")
def j16(spark, sf):
    """An unknown status becomes Yes if the company's name holds a listed one anywhere."""
    every = F.broadcast(_listed(spark, sf).agg(F.collect_set("s").alias("ss")))  # a list of sponsors, as long as the dimension
    f = _firms(spark, sf).crossJoin(every)
    return f.select("c_custkey", F.when(F.col("c_acctbal") < 0, "No").when(F.exists("ss", lambda s: F.contains(F.lower("company"), s)), "Yes").otherwise("Unknown").alias("sponsorship"))


_TYPOS = "x AS (SELECT c_custkey AS id, n_regionkey AS region, left(n_name, length(n_name) - 1) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE right(n_name, 1) END AS typo FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_MOST = "CASE WHEN length(typo) <= 5 THEN 1 WHEN length(typo) <= 9 THEN 2 ELSE 3 END"


def _typos(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("region"), F.expr("concat(left(n_name, length(n_name) - 1), CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE right(n_name, 1) END)").alias("typo"))


@register("j17_nearest_string", f"WITH {_TYPOS}, d AS (SELECT id, region, typo, n_name, {_MOST} AS most, levenshtein(lower(typo), lower(n_name)) AS e, row_number() OVER (PARTITION BY id ORDER BY levenshtein(lower(typo), lower(n_name)), n_nationkey) AS i FROM x JOIN nation ON n_regionkey = region) SELECT id, region, typo, CASE WHEN e <= most THEN n_name END AS nearest, CASE WHEN e <= most THEN e END AS edits FROM d WHERE i = 1")
def j17(spark, sf):
    """The nearest name of the same region, with one to three edits by length."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    most = F.when(F.length("typo") <= 5, 1).when(F.length("typo") <= 9, 2).otherwise(3)
    return joins.nearest_string(_typos(spark, sf), n, "typo", "n_name", "n_nationkey", most, on=["region"])


@register("j18_nearest_of_list", f"WITH {_TYPOS}, d AS (SELECT id, region, typo, n_name, levenshtein(lower(typo), lower(n_name)) AS e, abs(length(typo) - length(n_name)) AS l, n_nationkey FROM x, nation), r AS (SELECT id, region, typo, n_name, e, row_number() OVER (PARTITION BY id ORDER BY e, n_nationkey) AS i FROM d WHERE e <= 2 AND l <= 2) SELECT x.id, x.region, x.typo, r.n_name AS nearest, r.e AS edits FROM x LEFT JOIN r ON r.id = x.id AND r.i = 1")
def j18(spark, sf):
    """The nearest of a list whose length differs by two at most, with two edits at most."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    most = F.when(F.abs(F.length("typo") - F.length("n_name")) <= 2, 2).otherwise(-1)
    return joins.nearest_string(_typos(spark, sf), n, "typo", "n_name", "n_nationkey", most)


@register("j19_scalar_cross", "SELECT o_orderstatus, round(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS pct FROM orders GROUP BY 1")
def j19(spark, sf):
    o = table(spark, sf, "orders")
    total = F.broadcast(o.agg(F.sum("o_totalprice").alias("t")))
    return o.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("s")).crossJoin(total).select("o_orderstatus", F.round(F.lit(100.0) * F.col("s") / F.col("t"), 4).alias("pct"))


@register(
    "j23_exact_then_contained",
    r"WITH p AS (SELECT page_id, url, regexp_replace(lower(url), '[?#].*$', '') AS c FROM pages), h AS (SELECT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS hint, min(url) AS u FROM pages WHERE page_id % 10 = 0 GROUP BY 1), e AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 = 0) SELECT p.page_id, CASE WHEN e.url IS NOT NULL THEN 'exact' WHEN h.hint IS NOT NULL THEN 'contained' ELSE 'none' END AS hit FROM p LEFT JOIN e ON e.url = p.url LEFT JOIN h ON h.hint = regexp_extract(p.c, '^https?://([^/:?#]+)', 1)",
)
def j23(spark, sf):
    """The exact URL first, then one of the same host."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.host(F.col("url")).alias("hint"))
    known = p.where("page_id % 10 = 0")
    exact, hosts = known.select("url", F.lit(1).alias("e")).distinct(), known.select("hint", F.lit(1).alias("c")).distinct()
    return p.join(exact, "url", "left").join(hosts, "hint", "left").select("page_id", F.when(F.col("e") == 1, "exact").when(F.col("c") == 1, "contained").otherwise("none").alias("hit"))


@register(
    "j24_word_overlap",
    rf"WITH {TITLES_SQL}, w AS (SELECT DISTINCT doc_id AS id, company, lower(unnest(string_split(title, ' '))) AS w FROM titles), n AS (SELECT id, count(*) AS size FROM w GROUP BY 1), s AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM w a JOIN w b ON a.company = b.company AND a.w = b.w AND a.id < b.id GROUP BY 1, 2) SELECT left_id, right_id, shared FROM s JOIN n ON n.id = left_id WHERE shared >= 2 AND shared >= 0.5 * size",
)
def j24(spark, sf):
    t = titles(spark, sf).select(F.col("doc_id").alias("id"), "company", F.array_distinct(F.split(F.lower("title"), " ")).alias("words"))
    return joins.word_overlap(t, "company", "words")


@register("j25_fill_blanks", "WITH l AS (SELECT l_suppkey, min(l_partkey) AS p FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey ELSE p END AS value FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey")
def j25(spark, sf):
    known = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_partkey").alias("p"))
    own = F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("long"))
    return table(spark, sf, "supplier").join(known, "s_suppkey", "left").select("s_suppkey", F.coalesce(own, "p").alias("value"))


@register("j27_fallback_chain", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name, r_name) AS place FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_nationkey % 5")
def j27(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "rk")
    c = table(spark, sf, "customer").withColumn("rk", F.col("c_nationkey") % 5)
    return c.join(n, "c_nationkey", "left").join(r, "rk", "left").select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), "n_name", "r_name").alias("place"))


@register("set01_sets", f"WITH {JOBS_SQL}, v AS (SELECT DISTINCT company, k FROM jobs WHERE outcome = 'valid'), d AS (SELECT DISTINCT company, k FROM jobs WHERE outcome = 'discarded') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM v INTERSECT SELECT * FROM d) UNION ALL SELECT 'valid only', count(*) FROM (SELECT * FROM v EXCEPT SELECT * FROM d) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM v UNION SELECT * FROM d)")
def set01(spark, sf):
    j = jobs(spark, sf)
    v, d = (j.where(F.col("outcome") == o).select("company", "k").distinct() for o in ("valid", "discarded"))
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n(v.intersect(d), "both").unionByName(n(v.subtract(d), "valid only")).unionByName(n(v.union(d).distinct(), "any"))


@register("set06_word_overlap_score", rf"WITH {TITLES_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM titles), top AS (SELECT w FROM w WHERE length(w) > 2 GROUP BY 1 ORDER BY count(*) DESC, w LIMIT 50), s AS (SELECT doc_id, count(DISTINCT w) AS n FROM w WHERE w IN (SELECT w FROM top) GROUP BY 1) SELECT t.doc_id, least(1.0, coalesce(n, 0) / 5.0)::DOUBLE AS score FROM titles t LEFT JOIN s USING (doc_id)")
def set06(spark, sf):
    t = titles(spark, sf).select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("words"))
    every = titles(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    top = every.where("length(w) > 2").groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(50).agg(F.collect_list("w").alias("top"))
    return t.crossJoin(F.broadcast(top)).select("doc_id", F.least(F.lit(1.0), F.size(F.array_intersect("words", "top")) / 5.0).alias("score"))


@register("p30_due", f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE processed_at + INTERVAL 3 DAY <= TIMESTAMP '{AS_OF}' AND processed_at + INTERVAL 3 DAY > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def p30(spark, sf):
    due = F.col("processed_at") + F.expr("INTERVAL 3 DAYS")
    return jobs(spark, sf).where((due <= as_of()) & (due > as_of(7))).select("id")


@register("w08_duplicate_ids", f"WITH {JOBS_SQL}, r AS (SELECT id, outcome, row_number() OVER (PARTITION BY lower(company), k ORDER BY id) AS i FROM jobs) SELECT id FROM r WHERE i > 1 AND outcome <> 'valid'")
def w08(spark, sf):
    w = Window.partitionBy(F.lower("company"), "k").orderBy("id")
    return jobs(spark, sf).withColumn("i", F.row_number().over(w)).where("i > 1 and outcome <> 'valid'").select("id")
