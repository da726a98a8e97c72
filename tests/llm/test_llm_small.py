"""Sharding, token counts, packing, license scans and WARC."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from llm_helpers import words
from tarnmill.llm import license_scan, packing, registry, sharding, token_counts, warc


def slow_table(names, size):
    import hashlib

    orders = []
    for name in names:
        x = hashlib.md5(name.encode()).digest()
        start, skip = int.from_bytes(x[:8], "big") % size, int.from_bytes(x[8:], "big") % (size - 1) + 1
        orders.append([(start + j * skip) % size for j in range(size)])
    table = {}
    while len(table) < size:
        for i, order in enumerate(orders):
            if len(table) < size:
                table[next(s for s in order if s not in table)] = i
    return [table[s] for s in range(size)]


def test_table_matches_the_slow_one_and_is_even():
    names = [f"s{i}" for i in range(7)]
    assert sharding.build_table(names, 101).tolist() == slow_table(names, 101)
    counts = np.bincount(sharding.build_table([f"s{i}" for i in range(64)]))
    assert counts.max() - counts.min() <= 1


def test_removing_a_shard_moves_little():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.build_table(names, 10_007), sharding.build_table(names[:-1], 10_007)
    moved = ((a != b) & (a != 19)).mean()
    assert moved < 0.05


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        sharding.build_table(names, size)


def test_sharding_cases(spark, make, nasty):
    docs = make(nasty)
    out = sharding.assign_shards(spark, docs)
    assert out.count() == len(nasty)
    assert set(out.columns) == set(docs.columns) | {"slot", "shard"}
    assert out.where("doc_id is null").select("shard").distinct().count() == 1
    assert out.where("doc_id = 4").select("shard").distinct().count() == 1
    assert out.where("shard is null").count() == 0
    assert sharding.assign_shards(spark, make([])).count() == 0


def check_oracle(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(map(str, rows)) == Counter(str(tuple(r)) for r in got.select(columns).collect())


def test_sharding_oracle(spark, sf_dir):
    check_oracle(spark, sf_dir, "op5_sharding", ["documents"])


def test_warc_oracle(spark, sf_dir):
    check_oracle(spark, sf_dir, "op8_warc", ["pages"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_split_texts_count_like_whole_ones(name, sf_dir):
    path = f"/opt/tokenizers/{name}"
    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:60]
    texts += ["", "a", "it's  two   spaces \n\n and 'quotes' 123 4,567.8 <|endoftext|> x_y", "é ü 漢字 İstanbul", "x" * 5000, " lead and trail "]
    encode, _ = token_counts.encoder(path)
    assert token_counts.count_batch(texts, path, batch_bytes=500, piece_chars=40) == encode(texts)


def test_split_is_lossless():
    text = words(500, 3)
    pieces = token_counts.split_safely(text, 100, False)
    assert "".join(pieces) == text and max(map(len, pieces)) <= 100
    assert token_counts.split_safely("y" * 500, 100, False) == ["y" * 500]


def test_token_count_cases(make, nasty):
    out = token_counts.token_counts(make(nasty)).collect()
    assert len(out) == len(nasty)
    encode, _ = token_counts.encoder(token_counts.VOCABULARY)
    want = Counter((i, None if t is None else encode([t])[0], None if t is None else len(t.encode())) for i, t in nasty)
    assert Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in out) == want
    assert token_counts.token_counts(make([])).count() == 0


def test_combinations_and_nnls():
    table = packing.combinations(12, 3)
    assert ((np.arange(1, 13) @ table) == 12).all() and table.shape[1] == 19
    assert len(np.unique(table, axis=1).T) == 19
    r = np.random.default_rng(0)
    for _ in range(20):
        a = r.normal(size=(8, 5))
        b = r.normal(size=8)
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient >= -1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_histogram_up(seed):
    r = np.random.default_rng(seed)
    histogram = r.integers(0, [1, 3, 50, 1000, 5, 2][seed] + 1, 32)
    used, packs = np.zeros(32, int), 0
    for times, parts in packing.plan(histogram):
        assert sum(x * n for x, n in parts.items()) <= 32
        packs += times
        for x, n in parts.items():
            used[x - 1] += times * n
    assert (used == histogram).all()
    tokens = int(histogram @ np.arange(1, 33))
    # first fit decreasing as the brute force
    bins = []
    for x in sorted(np.repeat(np.arange(1, 33), histogram), reverse=True):
        i = next((i for i, room in enumerate(bins) if room >= x), None)
        if i is None:
            bins.append(32 - x)
        else:
            bins[i] -= x
    assert -(-tokens // 32) <= packs <= len(bins) * 1.05 + 2


@pytest.mark.parametrize("low,high,window", [(1, 50, 2048), (1, 2, 2048), (1, 2048, 2048), (600, 1100, 2048), (1, 64, 64)])
def test_packing_is_as_tight_as_first_fit_decreasing(low, high, window):
    r = np.random.default_rng(high)
    lengths = r.integers(low, high + 1, 4000)
    patterns = packing.plan(np.bincount(lengths, minlength=window + 1)[1:])
    packs = sum(n for n, _ in patterns)
    assert max(sum(x * c for x, c in p.items()) for _, p in patterns) <= window
    rooms = np.zeros(0, int)
    for x in sorted(lengths.tolist(), reverse=True):
        fits = np.flatnonzero(rooms >= x)
        if len(fits):
            rooms[fits[0]] -= x
        else:
            rooms = np.append(rooms, window - x)
    assert packs <= len(rooms) * 1.02 + 1


def test_windows_hold_what_the_plan_says(spark):
    """Places by brute force: windows filled one after the other as the patterns say."""
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 3, 17, 40, 64, 65, 200, r.randrange(64)])) for i in range(700)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n long").repartition(3), length=F.col("n"), window=64, bins=16).collect()
    lengths = Counter(min(64, n - a) for _, n in rows for a in range(0, n, 64))
    windows = [sorted((x for x, c in p.items() for _ in range(c)), reverse=True) for n, p in packing.plan(np.array([lengths[i + 1] for i in range(64)]), bins=16) for _ in range(n)]
    got = {}
    for x in out:
        if x.pack_id is not None:
            got.setdefault(x.pack_id, []).append((x.position, x.n_tokens))
    want = {i: [(sum(w[:j]), x) for j, x in enumerate(w)] for i, w in enumerate(windows)}
    assert {i: sorted(w) for i, w in got.items()} == want


def test_packing_counts_tokens(make, nasty):
    want, got = Counter(), Counter()
    for x in token_counts.token_counts(make(nasty)).collect():
        want[x.doc_id] += x.n_tokens or 0
    for x in packing.pack_texts(make(nasty)).collect():
        got[x.doc_id] += x.n_tokens
    assert got == want and packing.pack_texts(make([])).count() == 0


def test_packing_cases(make, nasty):
    rows = packing.pack(make(nasty), window=64, bins=16).collect()
    want = Counter()
    for i, t in nasty:
        want[i] += len((t or "").split())
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert (r.pack_id is None) == (r.n_tokens == 0) and r.n_tokens <= 64
    assert got == want
    assert sum(r.piece == 0 for r in rows) == len(nasty)
    packs = {}
    for r in rows:
        if r.pack_id is not None:
            packs.setdefault(r.pack_id, []).append((r.position, r.position + r.n_tokens))
    for spans in packs.values():
        spans.sort()
        assert spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(packs) == list(range(len(packs)))
    assert packing.pack(make([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(make([]), window=100, bins=16)


def semi_global(pattern, text):
    """Least edits of the pattern against any stretch of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_license_search_finds_what_brute_force_finds():
    r = random.Random(5)
    texts = []
    for i in range(150):
        wording = list(r.choice(license_scan.NOTICES)[1])
        for _ in range(r.randrange(7)):
            at = r.randrange(len(wording))
            wording[at : at + r.randrange(2)] = r.choice(["", "q", "zz"])
        texts.append(words(r.randrange(6), i) + " " + "".join(wording).upper() + " " + words(r.randrange(6), i + 1))
    for text in texts:
        low = license_scan.lower(text)
        found = license_scan.candidates(low, license_scan.NOTICES)
        for i, (_, wording) in enumerate(license_scan.NOTICES):
            near = semi_global(wording, low) <= license_scan.edits_allowed(wording)
            own = {x for x in found if x[1] == i}
            assert near == bool(own and license_scan.matches(low, license_scan.NOTICES, {x[1:] for x in own}))


def test_license_spans():
    texts = ["Foo. Relesed under the MIT license!", None, "", "ALL RIGHTS RESERVED", "all right of way reserve a seat", "Ünder: licensed under CC BY-NC 4.0."]
    rows = license_scan.scan_texts(texts)
    assert [(r[0], r[1], r[4], r[5]) for r in rows] == [(0, "MIT", 1, "Relesed under the MIT license"), (3, "Proprietary", 0, "ALL RIGHTS RESERVED"), (5, "CC-BY-NC-4.0", 0, "licensed under CC BY-NC 4.0")]
    for r in rows:
        assert texts[r[0]][r[2] : r[3]] == r[5]


def test_wrapped_notices_and_identifiers():
    texts = [
        "/*\n * Licensed under the\n * Apache License,   Version 2.0\n */ x", "# Released\n#   under the\t MIT\r\n# license", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;",
        "SPDX-License-Identifier:\n", "a  b\n\nreleased under the mit license\n  c", "released - under the * mit license",
    ]
    rows = license_scan.scan_texts(texts)
    assert [(r[0], r[1], r[4], r[6]) for r in rows if r[0] < 5] == [(0, "Apache-2.0", 0, None), (1, "MIT", 0, None), (2, "SPDX", 0, "(MIT OR Apache-2.0) AND BSD-3-Clause"), (3, "SPDX", 0, None), (4, "MIT", 0, None)]
    for r in rows:
        assert texts[r[0]][r[2] : r[3]] == r[5] and r[5] == r[5].strip()
    assert rows[0][5].startswith("Licensed under the\n") and rows[1][5].endswith("license")
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a", " ", "  ", "\n", "\t", "# ", "* ", "b"]) for _ in range(30))
        flat, ends, gone = license_scan.fold(text)
        assert all(text[license_scan.unfold(i, ends, gone)] == c for i, c in enumerate(flat) if c != " ")
        assert regex.sub(r"\s", "", flat) in regex.sub(r"\s", "", text) or "#" in text or "*" in text


def test_license_cases(make, nasty):
    notice = "Released under the MIT License."
    rows = [*nasty, (20, notice), (20, notice), (None, notice), (21, words(30_000, 9) + " " + notice + " " + words(10, 8))]
    out = license_scan.scan(make(rows)).collect()
    assert Counter(r.doc_id for r in out) == {20: 2, None: 1, 21: 1}
    assert {r.passage for r in out} == {notice[:-1]} and license_scan.scan(make([])).count() == 0
    assert regex.__name__ == "regex"


def make_pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, at long").repartition(2)


@pytest.mark.parametrize("split", [16 << 20, 5000, 100_000])
def test_warc_headers_of_any_length(spark, split):
    rows = [(i, f"http://a/{i}", f"page {i} " * 50) for i in range(30)]
    rows[10] = (10, "data:" + "x" * 200_000, "WARC/1.0\r\nnot: a header")
    rows[20] = (20, "http://b/" + "y: " * 30_000, "WARC/1.0\r\n\r\nWARC/1.0 in a page")
    out = warc.round_trip(make_pages(spark, rows).coalesce(1), split)
    assert sorted(map(tuple, out.collect())) == rows


def test_warc_cases(spark):
    fake = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (None, None, None), (2, None, ""), (3, "http://b/", None), (4, "http://c/", fake * 3 + "end"), (5, "u", "z" * 200_000), (6, "u", "é漢\r\n\r\nWARC/1.0\r\n\r\n"), (7, "u", "WARC/1.0")]
    rows += [(i, f"http://p/{i}", fake[: i * 7 % len(fake)] * (i % 5)) for i in range(100, 180)]
    for split in (64, 1000, 1 << 20):
        out = warc.round_trip(make_pages(spark, rows), split)
        assert Counter(map(tuple, out.select("page_id", "url", "html").collect())) == Counter(rows)
    assert warc.round_trip(make_pages(spark, [])).count() == 0
    rows = [(1, "http://a/\r\nX: y%0D%25", "h"), (2, "http://a/%0D%0A%25", "h"), (3, "\r\n\r\nWARC/1.0\r\n%", "")]
    assert sorted(map(tuple, warc.round_trip(make_pages(spark, rows)).collect())) == rows


def test_payloads_full_of_magic_take_linear_time():
    import time

    data = (b"WARC/1.0\r\n" * 100_000)[:1_000_000]
    began = time.perf_counter()
    assert warc.candidates_in(data, 0, len(data)) == {}
    many = b"WARC/1.0\r\nA: b\r\n" * 50_000
    assert warc.candidates_in(many, 0, len(many)) == {}
    assert time.perf_counter() - began < 5


def test_a_damaged_file_gives_what_its_chain_reaches(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record % 1 + record % 2 + b"junk" + record % 3)
    (tmp_path / "b.warc").write_bytes(b"junk" + record % 4)
    (tmp_path / "c.warc").write_bytes(record % 5 + (record % 6)[:-9])
    (tmp_path / "d.warc").write_bytes(b"")
    out = warc.read_warc(spark, f"file://{tmp_path}", 50)
    assert sorted(r.page_id for r in out.select("page_id").collect()) == ["1", "2", "5"]
    assert out.agg(F.max(F.length("payload"))).first()[0] == 3
