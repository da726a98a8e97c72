"""String, URL, date and place functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.functions import dates, places, text, urls
from tarnmill.plans.registry import register
from tarnmill.sources.tables import AS_OF, TITLES_SQL, table, titles

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


#: A word of letters made from a document's text, which no rule knows; {w} in seeds, {l} in lower case.
WORD_SQL = "'Q' || translate(substr(md5(coalesce(text, '')), 1, 6), '0123456789', 'ghijklmnop')"


def seeded(spark, sf, rows: list[tuple], kinds: str):
    """(doc_id, columns of the seeds) of every document: the seed of its number, with the document's own word put in."""
    text_ = F.coalesce("text", F.lit(""))
    word = F.concat(F.lit("Q"), F.translate(F.substring(F.md5(text_), 1, 6), "0123456789", "ghijklmnop"))
    seeds = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {kinds}")
    docs = table(spark, sf, "documents").select("doc_id", word.alias("__w"), F.pmod("doc_id", F.lit(len(rows))).cast("int").alias("__i"))
    joined = docs.join(F.broadcast(seeds), "__i")  # a seed for each case of a rule: a fixed list
    put = lambda c: F.replace(F.replace(c, F.lit("{w}"), F.col("__w")), F.lit("{l}"), F.lower("__w"))
    return joined.select("doc_id", *[(_put(F.col(f.name), f.dataType, put)).alias(f.name) for f in seeds.schema[1:]])


def _put(c, kind, put):
    name = kind.simpleString()
    return put(c) if name == "string" else F.transform(c, put) if name == "array<string>" else c


def seeded_sql(rows: list[tuple], names: str, of: list[int] | None = None, n: int | None = None, ids: bool = True) -> str:
    """What should come of `seeded` rows: row j belongs to seed of[j] (j by default) of n."""

    def lit(v):
        return "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"

    of = list(range(len(rows))) if of is None else of
    columns = names.split(", ")
    table_ = "(VALUES " + ", ".join("(" + ", ".join([str(i), *map(lit, r)]) + ")" for i, r in zip(of, rows)) + f") AS v(__i, {names})"
    strings = {c for j, c in enumerate(columns) if any(isinstance(r[j], str) for r in rows)}
    picked = ", ".join(f"replace(replace({c}, '{{w}}', __w), '{{l}}', lower(__w)) AS {c}" if c in strings else c for c in columns)
    return f"SELECT {'doc_id, ' if ids else ''}{picked} FROM (SELECT doc_id, {WORD_SQL} AS __w FROM documents) d JOIN {table_} ON d.doc_id % {n or len(rows)} = __i"


@register("str01_alnum_key", rf"WITH {TITLES_SQL} SELECT doc_id, {KEY.format('title')} AS key, {KEY.format('company')} || '_' || {KEY.format('title')} AS pair FROM titles")
def str01(spark, sf):
    t = titles(spark, sf)
    return t.select("doc_id", text.alnum_key(F.col("title")).alias("key"), F.concat_ws("_", text.alnum_key(F.col("company")), text.alnum_key(F.col("title"))).alias("pair"))


@register("str03_clean_url", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', ''), '://www\.', '://') AS clean, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', '') AS with_www FROM pages")
def str03(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.clean_url(u).alias("clean"), urls.clean_url(u, keep_www=True).alias("with_www"))


@register("str05_platform", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in urls.PLATFORMS) + " ELSE 'generic' END AS platform FROM pages")
def str05(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.platform(F.col("url")).alias("platform"))


def _case(rules) -> str:
    out = []
    for name, words, never in rules:
        test = "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + ")"
        if never:
            test += " AND NOT (" + " OR ".join(f"contains(lower(title), '{w}')" for w in never) + ")"
        out.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


ROLE_TITLES = [("Machine Learning Intern",), ("Data Analyst, Sales",), ("Data Engineer Co-op",), ("Software Developer New Grad",), ("Technical support for software",), ("FPGA design",), ("Senior Nurse",), ("jobs",), ("AI Research Fall 2025",), ("12345",), ("Frontend Developer (unpaid)",), ("Director of Backend",), ("",), (None,)]
_NAMES = "SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' software developer' WHEN 1 THEN ' data analyst intern' WHEN 2 THEN ' machine learning co-op' WHEN 3 THEN ' senior sales' WHEN 4 THEN ' nurse' WHEN 5 THEN ' firmware new grad' ELSE '' END AS title FROM part"


def _part_titles(spark, sf):
    tail = F.expr("CASE p_partkey % 7 WHEN 0 THEN ' software developer' WHEN 1 THEN ' data analyst intern' WHEN 2 THEN ' machine learning co-op' WHEN 3 THEN ' senior sales' WHEN 4 THEN ' nurse' WHEN 5 THEN ' firmware new grad' ELSE '' END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", tail).alias("title"))


@register("str09_role_category", f"WITH t AS ({_NAMES}) SELECT id, {_case(text.ROLES)} AS role FROM t")
def str09(spark, sf):
    return _part_titles(spark, sf).select("id", text.role_category(F.col("title")).alias("role"))


@register("a23_preferred_roles", f"WITH t AS ({_NAMES}) SELECT {_case(text.ROLES)} AS role, count(*) AS n FROM t GROUP BY 1")
def a23(spark, sf):
    return _part_titles(spark, sf).groupBy(text.role_category(F.col("title")).alias("role")).agg(F.count("*").alias("n"))


_FAULT = r"""CASE WHEN length(l) < 5 THEN 'too short' WHEN regexp_matches(l, '^(home|careers?|apply|login|search|jobs?)$') THEN 'page word' WHEN regexp_matches(l, '\b(nurse|driver|cashier|teacher|chef|plumber)\b') THEN 'other field'
 WHEN regexp_matches(l, '\b(senior|staff|principal|director|vp|head of)\b') THEN 'too senior' WHEN regexp_matches(l, '\bunpaid\b') THEN 'unpaid' WHEN NOT regexp_matches(l, '[a-z]') THEN 'no letters' END"""


@register("str12_title_validity", f"WITH t AS ({_NAMES}), x AS (SELECT id, lower(trim(coalesce(title, ''))) AS l FROM t) SELECT id, {_FAULT} IS NULL AS ok, {_FAULT} AS reason FROM x")
def str12(spark, sf):
    t = _part_titles(spark, sf).withColumn("reason", text.title_fault(F.col("title")))
    return t.select("id", F.col("reason").isNull().alias("ok"), "reason")


@register("str18_job_type", rf"WITH t AS ({_NAMES}) SELECT id, CASE WHEN regexp_matches(lower(title), 'new grad|entry level|full[- ]time') THEN 'Full-Time' WHEN regexp_matches(lower(title), 'co-?op') THEN 'Co-op' WHEN regexp_matches(lower(title), '\bintern(ship)?\b') THEN 'Internship' WHEN regexp_matches(lower(title), 'fall|winter|spring') THEN 'Off-season' ELSE 'Internship' END AS job_type, CASE WHEN regexp_matches(lower(title), 'machine learning|deep learning|\bml\b|\bai\b') THEN 'ML' WHEN regexp_matches(lower(title), 'data|analy') THEN 'DA' ELSE 'SDE' END AS resume_type FROM t")
def str18(spark, sf):
    t = F.col("title")
    return _part_titles(spark, sf).select("id", text.job_type(t, F.lit("direct")).alias("job_type"), text.resume_type(t).alias("resume_type"))


COMPANIES = [("US123-{l} robotics inc",), ("  The  {w}   Corp, LLC ",), ("42_{l}",), ("IBM",), ("eBay Inc.",), ("n/a",), (None,), ("{w} (USA)",), ("ai labs",), ("UMBRELLA CORPORATION",)]
_COMPANY_OUT = ["{w} Robotics", "{w} Corp", "{w}", "IBM", "eBay", "Unknown", "Unknown", "{w}", "AI Labs", "Umbrella"]


@register("str06_company_normalize", seeded_sql([(*c, o) for c, o in zip(COMPANIES, _COMPANY_OUT)], "company, normalized"))
def str06(spark, sf):
    return seeded(spark, sf, COMPANIES, "company string").withColumn("normalized", text.normalize_company(F.col("company")))


TITLES_IN = [("New: Café Développeur &amp; Chef \U0001f680",), ("{w} Engineer | Platform - Remote",), ("urgent - {w}   Lead ;",), ("C++ &lt;{l}&gt;",), (None,)]
_TITLES_OUT = ["Cafe Developpeur & Chef", "{w} Engineer - Platform", "{w} Lead", "C++ <{l}>", None]


@register("str24_sanitize_title", seeded_sql([(*c, o) for c, o in zip(TITLES_IN, _TITLES_OUT)], "title, clean"))
def str24(spark, sf):
    return seeded(spark, sf, TITLES_IN, "title string").withColumn("clean", text.sanitize_title(F.col("title")))


@register("str30_accents", "SELECT doc_id, strip_accents(replace(replace(replace(left(text, 200), 'ß', ''), 'œ', ''), 'Œ', '')) AS plain FROM documents WHERE lang IN ('fr', 'es', 'de')")
def str30(spark, sf):
    c = F.translate(F.substring("text", 1, 200), "ßœŒ", "")
    return table(spark, sf, "documents").where(F.col("lang").isin("fr", "es", "de")).select("doc_id", text.strip_accents(c).alias("plain"))


@register("str37_fuzzy_company", f"WITH a AS (SELECT n_nationkey AS i, n_name AS x FROM nation), k AS (SELECT a.i, b.i AS j, {KEY.format('a.x')} AS x, {KEY.format('b.x')} AS y FROM a, a b WHERE a.i <= b.i) SELECT i, j, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.9 ELSE round(1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE, 4) END::DOUBLE AS score FROM k")
def str37(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("y"))
    return a.join(F.broadcast(b), F.col("i") <= F.col("j")).select("i", "j", text.fuzzy_company(F.col("x"), F.col("y")).alias("score"))


@register("str39_overlap", "WITH p AS (SELECT p_partkey AS id, lower(p_brand) AS h, lower(p_name) AS f FROM part) SELECT id, round(len(list_filter(string_split(h, ''), lambda c: c <> '' AND contains(f, c))) / nullif(length(h), 0)::DOUBLE, 4) AS ratio FROM p")
def str39(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.overlap_ratio(F.col("p_brand"), F.col("p_name")).alias("ratio"))


@register("str40_tokens", rf"WITH {TITLES_SQL} SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({STOP})), ' ') AS tokens FROM titles")
def str40(spark, sf):
    return titles(spark, sf).select("doc_id", F.array_join(text.tokenize(F.col("title")), " ").alias("tokens"))


IDS = [("R-00123",), ("000",), ("n/a",), ("Job_0042{l}",), (None,), ("JR1234Apply",), ("APPLY",), ("AB-99",), ("{w}-99",), ("lower12",)]


@register("str46_job_id", seeded_sql(list(zip([i for i, in IDS], ["r00123", "000", "", "job0042{l}", "", "jr1234apply", "apply", "ab99", "{l}99", "lower12"], [1, 0, 0, 0, 0, 1, 0, 1, 0, 0])), "job_id, normalized, valid"))
def str46(spark, sf):
    c = F.col("job_id")
    return seeded(spark, sf, IDS, "job_id string").select("doc_id", c, text.normalize_job_id(c).alias("normalized"), text.valid_job_id(c).cast("int").alias("valid"))


MODES = [("Remote - {w}",), ("Hybrid ({w})",), ("On-site",), ("{w}",), (None,), ("WFH {w}",)]


@register("p06_work_mode", seeded_sql(list(zip([m for m, in MODES], ["Remote", "Hybrid", "On Site", "Unknown", "Unknown", "Remote"])), "place, mode"))
def p06(spark, sf):
    return seeded(spark, sf, MODES, "place string").select("doc_id", "place", text.work_mode(F.col("place")).alias("mode"))


@register("p04_status_counts", "WITH s AS (SELECT turn, CASE turn % 9 WHEN 0 THEN 'Offer received' WHEN 1 THEN ' Interview 1' WHEN 2 THEN 'OA Round 2 sent' WHEN 3 THEN 'Assessment' WHEN 4 THEN 'Not Applied' WHEN 5 THEN 'Rejected' WHEN 6 THEN 'Applied' WHEN 7 THEN '' ELSE ' Ghosted ' END AS raw FROM conversations) SELECT CASE WHEN trim(raw) = '' THEN 'Unknown' WHEN contains(lower(raw), 'offer') THEN 'Offer' WHEN contains(lower(raw), 'interview') THEN 'Interview' WHEN contains(lower(raw), 'oa round 2') THEN 'OA Round 2' WHEN contains(lower(raw), 'assessment') THEN 'OA Round 1' WHEN contains(lower(raw), 'not applied') THEN 'Not Applied' WHEN contains(lower(raw), 'reject') THEN 'Rejected' WHEN contains(lower(raw), 'applied') THEN 'Applied' ELSE trim(raw) END AS status, count(*) AS n FROM s GROUP BY 1")
def p04(spark, sf):
    raw = F.expr("CASE turn % 9 WHEN 0 THEN 'Offer received' WHEN 1 THEN ' Interview 1' WHEN 2 THEN 'OA Round 2 sent' WHEN 3 THEN 'Assessment' WHEN 4 THEN 'Not Applied' WHEN 5 THEN 'Rejected' WHEN 6 THEN 'Applied' WHEN 7 THEN '' ELSE ' Ghosted ' END")
    return table(spark, sf, "conversations").groupBy(text.status(raw).alias("status")).agg(F.count("*").alias("n"))


@register("url01_host_path", r"SELECT page_id, regexp_extract(lower(url), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(regexp_extract(lower(url), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS domain, regexp_extract(url, '^https?://[^/]+/([a-z]{2})(?:/|$)', 1) AS segment FROM pages")
def url01(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.domain(u).alias("domain"), urls.language_segment(u).alias("segment"))


URLS = [("https://www.a.{l}.example.com/jobs/12345-{l}-engineer?x=1",), ("http://example.org/",), ("ftp://x",), ("https://linkedin.com/in/a",), ("https://{l}.example.net/careers/senior_{l}_77/#top",), ("https://e.com/a?page=2&ref=x",), (None,)]
_URL_OUT = [("Data Engineer", "12345", "a.b", None), ("", "N/A", "", "no path"), ("", "N/A", "", "not http"), ("", "N/A", "", "blocked site"), ("Senior {w}", "N/A", "{l}", None), ("", "2", "", None), (None, "N/A", None, "not http")]
_URL_OUT[0] = ("{w} Engineer", "12345", "www.a.{l}", None)


@register("url02_title_id_fault", seeded_sql([(*a, *b) for a, b in zip(URLS, _URL_OUT)], "url, title, job_id, subdomain, fault"))
def url02(spark, sf):
    u = F.col("url")
    v = seeded(spark, sf, URLS, "url string").select("doc_id", "url", F.when(u.isNotNull(), urls.title_from_url(u)).alias("title"), urls.job_id_from_url(u).alias("job_id"), urls.subdomain(u).alias("subdomain"), urls.posting_fault(u).alias("fault"))
    return v


@register("url10_job_id", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&](?:jk|gh_jid|jobid|page)=([A-Za-z0-9-]+)', 1), ''), nullif(regexp_extract(url, '/jobs?/(\d{4,})', 1), ''), nullif(regexp_extract(url, '/(\d+)(?:[/?#]|$)', 1), ''), 'N/A') AS job_id FROM pages")
def url10(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.job_id_from_url(F.col("url")).alias("job_id"))


@register("url14_slugs", "SELECT DISTINCT regexp_extract(lower(url), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS slug, regexp_extract(url, '^https?://[^/]+/([a-z]{2})(?:/|$)', 1) AS platform FROM pages")
def url14(spark, sf):
    return table(spark, sf, "pages").select(urls.host(F.col("url")).alias("slug"), urls.language_segment(F.col("url")).alias("platform")).distinct()


AGES = [("Posted today {w}", 0), ("yesterday", 1), ("{w}: 3 days ago", 3), ("30+ days ago", 31), ("5h", 0), ("2mo", 60), ("2 weeks", 14), ("12d", 12), ("400 days", None), ("{w}", None), (None, None)]


@register("dt01_relative_days", seeded_sql(AGES, "phrase, days"))
def dt01(spark, sf):
    return seeded(spark, sf, [(a,) for a, _ in AGES], "phrase string").select("doc_id", "phrase", dates.relative_days(F.col("phrase")).alias("days"))


@register("dt01_conversations", r"WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN turn || ' days ago' WHEN 1 THEN turn || 'mo' WHEN 2 THEN 'yesterday' ELSE 'never' END AS p FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND turn <= 365 THEN turn WHEN turn % 4 = 1 AND turn * 30 <= 365 THEN turn * 30 WHEN turn % 4 = 2 THEN 1 END AS days FROM c")
def dt01_conversations(spark, sf):
    p = F.expr("CASE turn % 4 WHEN 0 THEN concat(turn, ' days ago') WHEN 1 THEN concat(turn, 'mo') WHEN 2 THEN 'yesterday' ELSE 'never' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", dates.relative_days(p).alias("days"))


DATES = [("2024-01-05", "2024-01-05"), ("2024-01-05 10:00:00", "2024-01-05"), ("01/17/2024", "2024-01-17"), ("05 Jan 2024", "2024-01-05"), ("5 Jan", "2024-01-05"), ("Feb 27", "2023-02-27"), ("27 April 2023", "2023-04-27"), ("Jan 9, 2024", "2024-01-09"), ("{w}", None), (None, None)]


@register("dt05_parse_dates", "SELECT doc_id, raw, CAST(day AS DATE) AS day FROM (" + seeded_sql(DATES, "raw, day") + ")")
def dt05(spark, sf):
    return seeded(spark, sf, [(a,) for a, _ in DATES], "raw string").select("doc_id", "raw", dates.parse_yearless(F.col("raw"), F.lit(AS_OF).cast("date")).alias("day"))


@register("dt11_next_send", "WITH e AS (SELECT event_id, CAST(ts AS DATE) + CASE WHEN hour(ts) >= 9 THEN 1 ELSE 0 END AS d FROM events) SELECT event_id, d + CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS send_on FROM e")
def dt11(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.next_send(F.col("ts")).alias("send_on"))


@register("dt16_warmup", "SELECT event_id, CASE WHEN day(ts) >= 21 THEN 50 WHEN day(ts) >= 8 THEN 20 WHEN day(ts) >= 1 THEN 5 ELSE 0 END AS quota FROM events")
def dt16(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.warmup_limit(F.dayofmonth("ts"), [(1, 5), (8, 20), (21, 50)]).alias("quota"))


PLACES = [("Austin, TX", "TX", "TX", "Austin, TX", None), ("Remote", "", "Remote", "Remote", None), ("CA-San Jose", "", "Unknown", "San Jose, CA", None), ("Boston, Massachusetts", "", "MA", "Boston, MA", None), ("{w}, Colorado", "", "CO", "{w}, CO", None), ("{w}, West Virginia", "", "WV", "{w}, WV", None), ("US-NM-{w}", "", "Unknown", "{w}, NM", None), ("Sydney, Australia", "", "Unknown", "Sydney, Australia", "place: australia"), ("Toronto, Canada", "", "Unknown", "Toronto, Canada", "place: canada"), ("nyc", "", "Unknown", "New York", None), ("Location: Reno. NV", "", "Unknown", "Reno, NV", None), ("", "", "Unknown", "", None), (None, "", "Unknown", None, None)]


@register("p02_places", seeded_sql(PLACES, "place, state, bucket, standard, abroad"))
def p02(spark, sf):
    p = F.col("place")
    return seeded(spark, sf, [(a[0],) for a in PLACES], "place string").select("doc_id", "place", places.state(p).alias("state"), places.state_bucket(p).alias("bucket"), places.standardize(p).alias("standard"), places.abroad(p, F.lit("")).alias("abroad"))


@register("p02_state_customers", "WITH c AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ', TX' WHEN c_custkey % 3 = 1 THEN ',CA 9' ELSE ', ca' END AS place FROM customer) SELECT regexp_extract(place, ',\\s*([A-Z]{2})\\b', 1) AS state, count(*) AS n FROM c GROUP BY 1".replace("\\\\", "\\"))
def p02_customers(spark, sf):
    place = F.concat("c_name", F.expr("CASE WHEN c_custkey % 3 = 0 THEN ', TX' WHEN c_custkey % 3 = 1 THEN ',CA 9' ELSE ', ca' END"))
    return table(spark, sf, "customer").groupBy(places.state(place).alias("state")).agg(F.count("*").alias("n"))
