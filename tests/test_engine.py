"""Operators on small rows of their own, and streams against batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import dates, text, urls
from tarnmill.operators import control, joins, rollups, rules, state, upserts
from tarnmill.plans import rules as plan_rules  # noqa: F401 registers stages
from tarnmill.sources import feeds
from tarnmill.streaming import operators as streams


def test_empty_store(spark):
    jobs = spark.createDataFrame([], "source string, outcome string, processed_at timestamp_ntz, processing_time_ms double")
    assert rollups.source_quality(jobs).count() == 0
    assert rollups.indexed_percentiles(jobs, "processing_time_ms", {"p50": 0.5, "p99": 0.99}).first().asDict() == {"count": 0, "p99": 0, "p50": 0}
    assert control.source_stats(control.daily_rates(jobs)).count() == 0
    assert rollups.weekly(spark.createDataFrame([], "day date"), "day").count() == 0


@pytest.mark.parametrize("n", [1, 4, 100, 101, 257])
def test_indexed_percentiles(spark, n):
    values = sorted([float(x * x % 97 + 1) for x in range(n)])
    got = rollups.indexed_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    assert (got.p50, got.p90, got.p99, got["count"]) == (values[int(n * 0.5)], values[int(n * 0.9)], values[int(n * 0.99)] if n > 100 else values[-1], n)


def series(spark, rates):
    rows = []
    for source, days in rates.items():
        for i, (valid, bad) in enumerate(days):
            rows += [(source, "valid", dt.datetime(2024, 1, i + 1, 12))] * valid + [(source, "discarded", dt.datetime(2024, 1, i + 1, 13))] * bad
    return spark.createDataFrame(rows, "source string, outcome string, processed_at timestamp_ntz")


def test_alerts(spark):
    jobs = series(spark, {"steady": [(4, 12)] * 14, "drop": [(2, 8)] * 13 + [(0, 10)], "back": [(8, 2)] * 11 + [(0, 10)] * 2 + [(9, 1)], "short": [(1, 1)] * 2})
    found = {r.source: (r.alert_type, r.severity) for r in control.alerts(control.source_stats(control.daily_rates(jobs))).collect()}
    assert found == {"drop": ("degradation", "warning")} or found == {"drop": ("degradation", "warning"), "back": ("recovery", "info")}
    report = {r.source: r.status for r in control.spc_report(control.source_stats(control.daily_rates(jobs))).collect()}
    assert report["steady"] == "healthy" and report["drop"] == "critical" and "short" not in report


def test_breaker_closes_opens_and_half_opens(spark):
    def run(pattern, step=1.0, seconds=10.0):
        rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * step), c == "+") for i, c in enumerate(pattern)]
        return tuple(state.breaker(spark.createDataFrame(rows, "k string, at timestamp_ntz, ok boolean"), "k", "at", "ok", seconds=seconds).first())[1:]

    assert run("----+-") == ("closed", 1, 0)
    assert run("-----") == ("open", 0, 1)
    assert run("-----" + "+" * 5) == ("open", 0, 1)  # refused while open
    assert run("-----" + "+" * 10) == ("half", 0, 1)
    assert run("-----" + "+" * 11) == ("closed", 0, 1)
    assert run("-----" + "+" * 9 + "-") == ("open", 0, 2)


def test_ttl_semi_join_and_keep_last(spark):
    d = dt.datetime
    rows = spark.createDataFrame([(1, "a", d(2024, 4, 1)), (2, "a", d(2024, 9, 1)), (3, "b", d(2024, 4, 1)), (4, None, d(2024, 4, 1))], "id int, k string, at timestamp_ntz")
    registry = spark.createDataFrame([("a", d(2024, 1, 5)), ("b", d(2024, 4, 2)), (None, d(2024, 4, 1))], "k string, at timestamp_ntz")
    assert [r.id for r in joins.semi_within(rows, registry, "k", "at", 90).collect()] == [1]
    old = spark.createDataFrame([("x", 1, "old"), ("y", 5, "old")], "k string, seq int, v string")
    new = spark.createDataFrame([("x", 1, "new"), ("y", 4, "new"), ("z", 1, "new")], "k string, seq int, v string")
    assert {r.k: r.v for r in upserts.keep_last(old, new, ["k"], ["seq"]).collect()} == {"x": "new", "y": "old", "z": "new"}


def test_stage_registry(spark):
    with pytest.raises(KeyError):
        rules.run_stages(spark.range(1), ["no such stage"])
    rows = spark.createDataFrame([(50, "en", 0, 1), (500, "de", 1, 1), (500, "en", 1, 0), (500, "en", None, None)], "n_chars long, lang string, toxic int, quality int")
    assert [r.reject_stage for r in rules.run_stages(rows, ["length", "language", "toxic", "quality"]).collect()] == ["length", "language", "toxic", None]


def test_guard(spark):
    assert rules.guarded(spark.range(10), F.col("id") < 2).count() == 2
    assert rules.guarded(spark.range(10), F.col("id") < 3).count() == 0
    assert rules.guarded(spark.range(0), F.col("id") < 3).count() == 0


def test_feed_helpers(spark):
    assert feeds.repair_header(["a", "", "a", " ", "a"]) == ["a", "_empty_1", "a_1", "_empty_3", "a_2"]
    bad = spark.createDataFrame([("c", "s", "{nope"), ("c", "s", None)], "company string, slug string, body string")
    assert feeds.board(bad, "greenhouse").count() == 0


def test_functions_on_nulls(spark):
    one = spark.createDataFrame([(None,)], "x string")
    x = F.col("x")
    row = one.select(text.alnum_key(x).alias("a"), text.sanitize_company(x).alias("b"), text.status(x).alias("c"), urls.clean_url(x).alias("d"), dates.relative_days(x).alias("e"), text.valid_job_id(x).alias("f"), F.size(text.tokenize(F.coalesce(x, F.lit("")))).alias("g")).first()
    assert tuple(row) == ("", "Unknown", "Unknown", "", None, False, 0)
    assert one.select(urls.strip_params(F.lit("https://z/a?auth=1&x=2&auth=3#t"), ["auth"]).alias("u")).first().u == "https://z/a?x=2#t"


def test_snapshot_and_facts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 2))], "id int, v string, at timestamp_ntz")
    assert upserts.snapshot(df.drop("at"), f"file://{tmp_path}/s") == 2
    with pytest.raises(Exception):
        upserts.snapshot(df.drop("at"), f"file://{tmp_path}/s")
    for _ in range(2):
        upserts.write_facts(df, f"file://{tmp_path}/f", "at")
    assert spark.read.parquet(f"file://{tmp_path}/f").where("day = date'2024-01-02'").count() == 2
    upserts.ensure_tables(spark, {"t": "a int"}, f"file://{tmp_path}")
    upserts.ensure_tables(spark, {"t": "a int"}, f"file://{tmp_path}")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 0


@pytest.fixture(scope="module")
def event_files(spark, sf_dir, tmp_path_factory):
    """The events in four files by time."""
    path = f"file://{tmp_path_factory.mktemp('events')}/e"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def test_stream_dedup(spark, event_files):
    batch = spark.read.parquet(event_files)
    stream = streams.read_events(spark, event_files, batch.schema)
    got = streams.drain(streams.dedup_within(stream, ["user_id", "event_type"], "ts", 90), "dedup")
    assert got.count() == batch.select("user_id", "event_type").distinct().count()


def test_stream_daily_counters(spark, event_files):
    batch = spark.read.parquet(event_files)
    stream = streams.read_events(spark, event_files, batch.schema)
    got = {(r.event_type, r.day): r.sent for r in streams.drain(streams.daily_counters(stream, "event_type", "ts"), "daily", "complete").collect()}
    want = {(r.event_type, r.day): r.n for r in batch.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_stream_breaker_matches_the_fold(spark, event_files):
    batch = spark.read.parquet(event_files)
    stream = streams.read_events(spark, event_files, batch.schema).select("event_type", "ts", (F.col("value") >= 30).alias("ok"))
    rows = streams.drain(streams.breaker_stream(stream, "event_type", seconds=3600.0), "breaker", "update").collect()
    got = {r.event_type: (r.state, r.failures, r.trips) for r in rows}
    fold = state.breaker(batch.select("event_type", "ts", (F.col("value") >= 30).alias("ok")), "event_type", "ts", "ok", seconds=3600.0)
    assert got == {r.event_type: (r.state, r.failures, r.trips) for r in fold.collect()}


def test_incremental_run(spark, event_files, tmp_path):
    schema = spark.read.parquet(event_files).schema
    decide = lambda df: df.withColumn("reject_reason", F.when(F.col("value") < 2, "low"))
    for _ in range(2):  # the second run finds nothing new
        streams.incremental_run(streams.read_events(spark, event_files, schema, 2), f"{tmp_path}/a", f"{tmp_path}/r", f"{tmp_path}/c", decide).awaitTermination()
    total = spark.read.parquet(event_files)
    assert spark.read.parquet(f"{tmp_path}/a").count() == total.where("value >= 2").count()
    assert spark.read.parquet(f"{tmp_path}/r").count() == total.where("value < 2").count()


def test_correction_log_and_stage_configuration(spark, tmp_path):
    (tmp_path / "log").write_text('{"from":"a","to":"b","url":"u","ts":"t"}\n{broken\n{"from":"c","to":"d"}\n')
    assert [r.to for r in feeds.read_corrections(spark, f"file://{tmp_path}/log").orderBy("to").collect()] == ["b", "d"]
    assert rules.from_config(["length", {"name": "toxic", "enabled": False}, {"name": "quality"}]) == ["length", "quality"]
    with pytest.raises(ValueError):
        rules.from_config(["length", "nonsense"])


def test_restrictions_of_common_sentences(spark):
    from tarnmill.operators.restrictions import restriction, sponsorship

    told = {
        "We look for an active student who is obtaining a bachelor's degree.": "undergraduate only", "Candidates need to be entering their senior year.": "undergraduate only", "Must be pursuing a BS degree.": "undergraduate only", "Open to undergraduate students only": "undergraduate only",
        "Pursuing a Bachelor's or Master's degree": None, "Pursuing a bachelor's degree or higher": None, "Senior engineers will mentor you": None, "": None, "Applicants have to be able to obtain and maintain a secret clearance.": "clearance",
        "U.S. citizenship is required": "citizenship", "You are authorized to work in the US without employer sponsorship": "citizenship", "The work falls under ITAR compliance": "clearance", "Doctoral candidates in robotics": "phd only", "PhD or Master's students": None,
    }
    rows = spark.createDataFrame([(k,) for k in [*told, None]], "page string")
    got = {r.page: r.r for r in rows.select("page", restriction(F.col("page")).alias("r")).collect()}
    assert got == told | {None: None}
    far = "Undergraduates only. " + "x " * 600 + "Masters of arts live here."  # too far away to lift it
    assert spark.createDataFrame([(far,)], "page string").select(restriction(F.col("page"))).first()[0] == "undergraduate only"
    s = spark.createDataFrame([("We will not sponsor visas", None), ("", "Yes"), ("We will sponsor H-1B visas", None), ("no word", None)], "page string, learned string")
    assert [r[0] for r in s.select(sponsorship(F.col("page"), F.col("learned"))).collect()] == ["No", "Yes", "Yes", "Unknown"]


def test_nearest_string_keeps_repeated_rows(spark):
    from tarnmill.operators import joins

    rows = spark.createDataFrame([("Rno", "NV"), ("Rno", "NV"), ("Reno", "XX"), (None, "NV")], "city string, st string")
    names = spark.createDataFrame([(1, "Reno", "NV"), (2, "Rome", "NY")], "o int, name string, st string")
    got = sorted(map(str, joins.nearest_string(rows, names, "city", "name", "o", F.lit(1), on=["st"]).collect()))
    assert len(got) == 4 and sum("nearest='Reno'" in g for g in got) == 2


def test_history_dedup_reasons(spark):
    from tarnmill.operators import history

    kinds = "id long, company string, title string, url string, job_id string, at timestamp_ntz"
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 31) - dt.timedelta(days=n)
    old = [(1, "Acme", "Data Engineer Intern", "https://a.com/1", "R-0001", day(10)), (2, "Beta", "Ops", "https://b.com/2", "R-9", day(200)), (3, "Acme", "Machine Learning Research Intern Summer", "https://a.com/3", None, day(5))]
    new = [(11, "X", "Y", "https://n/1", "r0001", day(0)), (12, "Q", "W", "https://n/2", "Z-7", day(0)), (13, "Q", "V", "https://n/3", "z7", day(0)), (14, "C", "T", "HTTPS://WWW.A.com/1/?x", "N/A", day(0)), (15, "Acme, Inc.", "Data engineer - intern", "https://n/5", None, day(0)),
           (16, "Acme", "Research Intern Machine Learning Summer", "https://n/6", "", day(0)), (17, "K", "L", "https://n/7", "R9", day(0)), (18, "New", "Thing", "https://n/8", "HASH_1", day(0)), (19, None, None, None, None, None)]
    got = {r.id: r.duplicate_of for r in history.duplicates(spark.createDataFrame(new, kinds), spark.createDataFrame(old, kinds)).collect()}
    assert got == {11: "id in registry", 12: None, 13: "id in batch", 14: "url", 15: "company and title", 16: "similar title", 17: "known id", 18: None, 19: None}


def test_internship_words_stand_alone(spark):
    """'coop' in the middle of another word is no co-op."""
    from tarnmill.functions.postings import internship_fault

    told = {"Qfcoopo role": "no internship", "Scooping role": "no internship", "Co-op, data": None, "Coop role": None, "Data Co-ops": None, "Senior co-op": "senior"}
    rows = spark.createDataFrame([(k,) for k in told], "x string")
    assert {r.x: r.fault for r in rows.select("x", internship_fault(F.col("x"), F.lit("Permanent")).alias("fault")).collect()} == told
    assert rows.limit(1).select(internship_fault(F.lit("role"), F.lit("a scoop position")).alias("fault")).first().fault == "no internship"


def test_similarity_that_reaches_the_threshold_by_rounding(spark):
    """Scores are rounded before they are compared; rare terms alone don't tell these pairs."""
    from tarnmill.operators.similarity import similar_pairs

    for least in (0.4, 0.85):
        w = least - 0.00002
        rows = [(1, "c", [(1, "rare", (1 - w * w) ** 0.5), (9, "common", w)]), (2, "c", [(9, "common", 1.0)]), (3, "d", [(9, "common", 1.0)]), (4, "c", [(9, "other", 1.0)])]
        v = spark.createDataFrame(rows, "id long, company string, v array<struct<df: long, term: string, weight: double>>")
        assert [tuple(r) for r in similar_pairs(v, least, "company").collect()] == [(1, 2, least)]


def test_pairs_across_chunks_against_brute_force(spark, monkeypatch):
    """Word overlap of blocks of several chunks, with texts of more ids than a row holds."""
    import random

    from tarnmill.operators import pairs

    monkeypatch.setattr(pairs, "CHUNK", 7)
    monkeypatch.setattr(pairs, "IDS", 2)
    dice = random.Random(1)
    rows = [(i, dice.choice("ab") if i % 19 else None, [dice.choice("pqrstuvw") for _ in range(dice.randint(1, 5))] if i % 17 else None) for i in range(120)]
    got = [tuple(r) for r in joins.word_overlap(spark.createDataFrame(rows, "id long, company string, words array<string>"), "company", "words").collect()]
    known = [(i, c, set(w)) for i, c, w in rows if c and w]
    want = [(i, j, len(v & w)) for i, c, v in known for j, d, w in known if c == d and i < j and len(v & w) >= max(2, 0.5 * len(v))]
    assert sorted(got) == sorted(want)


def test_texts_are_searched_once(spark):
    """A restriction splits a text in lower case once for each check, however many passages it holds; edges of words are
    looked for once for all wordings."""
    from tarnmill.operators import restrictions as t

    assert t._parts(r"\ba[|(]|b(?:c|d)\|e|f") == [r"\ba[|(]", r"b(?:c|d)\|e", "f"]
    assert t.at_words([r"\ba|\bb", r"\(c\)", r"\bd"]) == r"(?:(?=\w)\b(?:a|b)|\(c\)|(?=\w)\b(?:d))"
    text = ("x " * 200 + "Undergraduates only. ") * 3 + "y " * 400 + "Rising junior. " + "Masters"
    rows = spark.createDataFrame([(text,), ("Undergraduates only or masters",), (None,)], "page string")
    plan = rows.select(F.exists(t.UNDERGRADUATE._contexts(F.col("page")), lambda c: F.length(c) > 0).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract_all(") == 1
    assert [r[0] for r in rows.select(t.restriction(F.col("page"))).collect()] == ["undergraduate only", None, None]


def test_resembling_lists_no_partners(spark):
    """Many equal titles on both sides give each id of the batch once a pair of chunks, not once a partner."""
    from tarnmill.operators.similarity import resembling, vectors

    rows = [(f"{s}{i}", "c", "data engineer") for s in "bh" for i in range(30)] + [("b99", "c", "ops"), ("b98", "d", "data engineer")]
    v = vectors(spark.createDataFrame(rows, "id string, company string, title string"), "id", "title", ["company"])
    got = [r.left_id for r in resembling(v, 0.9, "company", F.col("id").startswith("b")).collect()]
    assert sorted(got) == sorted(f"b{i}" for i in range(30))
