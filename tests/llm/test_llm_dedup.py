"""Near-dedup, suffix arrays, decontamination, toxicity, components and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_helpers import words
from tarnmill.llm import decontamination, embedding_dedup, registry, simhash, suffix_dedup, token_counts, toxicity
from tarnmill.llm.common import Words, columns, ngram_hashes, shared_dir, written
from tarnmill.llm.components import components


def union(pairs, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_words_are_those_of_split():
    texts = ["", " a  b\n", None, "x", "é ü z", "tail ", "one two three", "a b"]
    w = Words(pa.array(texts))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [[] if t is None else [x for x in t.replace("\n", " ").split(" ") if x] for t in texts]
    h = w.hashes()
    assert h[w.first[1]] == h[w.first[7]] and len(set(h.tolist())) == len({x for g in got for x in g})
    assert ngram_hashes(h, 2)[w.first[1]] == ngram_hashes(h, 2)[w.first[7]]


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 302), (302, 300)]
    edges += [(400 + r.randrange(80), 400 + r.randrange(80)) for _ in range(60)]
    got = {x.node: x.root for x in components(spark.createDataFrame([e[::-1] if r.random() < 0.5 else e for e in edges] * 2, "a long, b long")).collect()}
    want = union(edges, 500)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def slow_signature(text):
    w = Words(pa.array([text.lower()]), keep=simhash._LETTER)
    total = np.zeros(256, int)
    for h in set(w.hashes().tolist()):
        for lane in range(4):
            x = int(simhash.mix(np.array([h], np.uint64) + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64))[0])
            total[lane * 64 : lane * 64 + 64] += [1 if x >> b & 1 else -1 for b in range(64)]
    return np.packbits((total > 0).astype(np.uint8), bitorder="little").view(np.uint64)


def test_signatures():
    texts = ["", None, "a", "a b c d a", words(300, 1), "É x"]
    got = simhash.signatures(pa.array(texts))
    for t, s in zip(texts, got):
        assert (s == slow_signature(t or "")).all()


@pytest.mark.parametrize("n,radius", [(3, 40), (64, 60), (65, 90), (300, 100), (1000, 42)])
def test_bit_sliced_pairs_are_those_of_brute_force(n, radius):
    r = np.random.default_rng(n)
    sig = r.integers(0, 2**63, (n, 4), dtype=np.uint64)
    for i in range(1, n, 3):
        sig[i] = sig[i - 1] ^ (np.uint64(1) << r.integers(0, 64, 4, dtype=np.uint64))
    bits = np.unpackbits(sig.view(np.uint8).reshape(n, -1), axis=1).astype(int)
    near = (bits[:, None] != bits[None]).sum(2) <= radius if n <= 300 else np.array([(bits != b).sum(1) <= radius for b in bits])
    a, b = simhash.near_pairs(simhash.planes(sig), sig, 0, n, radius)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.tril(near, -1)))))
    ea, eb = simhash.block_edges(np.arange(n), sig, radius)
    assert union(zip(ea.tolist(), eb.tolist()), n) == union(zip(*np.nonzero(near)), n)


def test_blocks_are_compared_many_at_a_time(monkeypatch):
    r = np.random.default_rng(5)
    sizes = [1, 2, 3, 24, 25, 25, 63, 64, 65, 100, 128, 129, 130, 300, 512, 513, 700] + [40] * 300
    sig = r.integers(0, 2**64, (sum(sizes), 4), dtype=np.uint64)
    first = np.cumsum([0, *sizes])
    for f, n in zip(first, sizes):
        for i in range(1, n, 4):
            sig[f + i] = sig[f + r.integers(i)] ^ (np.uint64(1) << r.integers(0, 64, 4, dtype=np.uint64))
    near = [(f + i, f + j) for f, n in zip(first, sizes) for i, j in np.argwhere(np.bitwise_count(sig[f : f + n, None] ^ sig[None, f : f + n]).sum(2) <= 46)]
    key, calls, cells = np.repeat(np.arange(len(sizes)), sizes), [], simhash.near_cells
    batch = pa.record_batch([pa.array(key), pa.array(np.arange(len(sig))), *(pa.array(sig[:, i].view(np.int64)) for i in range(4))], names=list("knabcd"))
    monkeypatch.setattr(simhash, "near_cells", lambda *a: calls.append(1) or cells(*a))
    edges = [e for b in simhash._compare(46)(iter([batch])) for e in zip(*(c.to_pylist() for c in b.columns))]
    assert union(edges, len(sig)) == union(near, len(sig)) and len(edges) < len(sig)
    assert len(calls) < 50  # not one for each block


def test_only_texts_that_may_go_are_shuffled(spark, make):
    texts = [" ".join(f"w{(i * 31 + j * 7) % 9973}x{i}" for j in range(60)) for i in range(60)]
    docs = make([*enumerate(texts), *((100 + i, texts[i]) for i in range(8)), (107, texts[7]), (None, texts[8]), (None, None), (200, "")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for out in (simhash.drop_duplicates(docs), simhash.drop_duplicates(docs.where("doc_id < 107 or doc_id is null"))):
            assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and r.text) == [(False, i, t) for i, t in enumerate(texts)]
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "__tm_b" in plan
        fate = make([(0, "")]).selectExpr("1L as h")
        keyed = spark.range(2000).selectExpr("id as __tm_h")
        sure, rest = simhash._filtered(keyed, fate)
        assert sure.count() == 1999 and [r["__tm_h"] for r in rest.collect()] == [1]
        assert "SortMergeJoin" not in sure._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def near_copy(text, changes, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"changed{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_are_found_and_others_left_alone(make):
    rows = [(i, words(150, i)) for i in range(150)]
    rows += [(1000 + i, near_copy(rows[i % 50][1], 3, i)) for i in range(120)]
    out = {r.doc_id: r for r in simhash.assign(make(rows)).collect()}
    caught = sum(out[1000 + i].group_id == i % 50 for i in range(120))
    assert caught >= 0.9 * 120
    assert not any(out[i].is_duplicate for i in range(150))
    kept = {r.doc_id for r in simhash.drop_duplicates(make(rows)).collect()}
    assert kept == {i for i, r in out.items() if not r.is_duplicate}


def test_simhash_recall_on_the_documents(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").sort_by("doc_id")
    sig = simhash.signatures(t["text"].combine_chunks())
    ids = t["doc_id"].to_pylist()
    d = np.array([np.bitwise_count(sig ^ s).sum(1) for s in sig])
    near = [(i, j) for i, j in zip(*np.nonzero(d <= simhash.RADIUS)) if i < j]
    group = {r.doc_id: r.group_id for r in registry.QUERIES["op7_simhash"](spark, sf_dir).collect()}
    assert near and sum(group[ids[i]] == group[ids[j]] for i, j in near) >= 0.9 * len(near)
    want = union(near, len(ids))
    assert all(want[ids.index(i)] == want[ids.index(g)] for i, g in group.items())


def test_blocks_meet_at_every_distance_up_to_the_radius():
    r = np.random.default_rng(5)
    chosen = simhash.block_bits()
    for distance in (20, 30, 35, 40, simhash.RADIUS):
        flips = np.argsort(r.random((2000, simhash.BITS)), axis=1)[:, :distance]
        bits = np.zeros((2000, simhash.BITS), np.uint8)
        np.put_along_axis(bits, flips, 1, axis=1)
        keys = simhash.block_keys(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), chosen)
        assert (keys == 0).any(axis=1).mean() >= 0.9, distance


def test_simhash_recall_by_distance(make):
    base = [words(150, 50_000 + i) for i in range(400)]
    copies = [near_copy(t, 15 + i % 8, i) for i, t in enumerate(base)]
    d = np.bitwise_count(simhash.signatures(pa.array(base)) ^ simhash.signatures(pa.array(copies))).sum(axis=1)
    out = {r.doc_id: r.group_id for r in simhash.assign(make([*enumerate(base), *((1000 + i, t) for i, t in enumerate(copies))])).collect()}
    for low, high in ((0, 38), (39, 42), (43, simhash.RADIUS)):
        near = [i for i in range(400) if low <= d[i] <= high]
        assert len(near) >= 20 and sum(out[1000 + i] == out[i] for i in near) >= 0.9 * len(near), (low, len(near))


def test_simhash_cases(make, nasty):
    docs = make(nasty)
    out = simhash.assign(docs).collect()
    assert len(out) == len(nasty)
    by = Counter((r.doc_id, r.group_id, r.is_duplicate) for r in out)
    assert by[(4, 4, False)] == 1 and by[(4, 4, True)] == 1 and by[(5, 4, True)] == 1 and by[(None, 4, True)] == 1
    assert by[(6, 6, False)] == 2 and by[(2, 2, False)] == 1 and by[(3, 3, False)] == 1
    kept = simhash.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == Counter((i, t) for i, t in nasty) - Counter({(4, nasty[5][1]): 1, (5, nasty[5][1]): 1, (None, nasty[5][1]): 1})
    assert simhash.drop_duplicates(make([])).count() == 0


# Embeddings


def test_embedding_groups_are_those_of_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(200, 32))
    x = np.concatenate([base, base[:60] + r.normal(size=(60, 32)) * 0.12, base[:40] * 3, np.repeat(base[:1], 100, 0) + r.normal(size=(100, 32)) * 0.1])
    x = x.astype(np.float32)
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = union([p for p in zip(*np.nonzero(np.triu(y @ y.T >= embedding_dedup.COSINE, 1)))], len(x))
    got = {q.vec_id: q.group_id for q in embedding_dedup.groups(df).collect()}
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items())


def test_embedding_pairs_that_share_a_direction(spark, tmp_path):
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    shared, n, pairs, dim = 0.8, 20_000, 500, 64
    rest, other = unit(r.normal(size=(n, dim))), unit(r.normal(size=(pairs, dim)))
    near = (0.954 - shared) / (1 - shared)
    rest = np.concatenate([rest, near * rest[:pairs] + np.sqrt(1 - near**2) * other])
    x = unit(np.sqrt(shared) * unit(r.normal(size=dim)) + np.sqrt(1 - shared) * rest)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    got = {q.vec_id: q.group_id for q in embedding_dedup.groups(spark.read.parquet(str(tmp_path / "e.parquet"))).collect()}
    close = [i for i in range(pairs) if x[i] @ x[n + i] >= embedding_dedup.COSINE]
    met = sum(got[i] == got[n + i] for i in close)
    print("met", met, "of", len(close))
    assert len(close) >= 100 and met >= 0.93 * len(close)


def test_embedding_cases(spark):
    inf = float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [inf, 0.0, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [1.0, 2.0]), (None, v), (None, None), (10, [-1.0, -2.0, -3.0]), (11, [1e-30, 2e-30, 3e-30]), (12, [0.0, 1.0]), (13, [-0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, v int")
    got = Counter(map(tuple, embedding_dedup.groups(df).collect()))
    assert got == Counter({(1, 1, False): 1, (1, 1, True): 1, (2, 1, True): 1, (None, 1, True): 1, (11, 1, True): 1, (12, 12, False): 1, (13, 12, True): 1, (None, None, False): 1, **{(i, i, False): 1 for i in (3, 4, 5, 6, 7, 8, 9, 10)}})
    assert embedding_dedup.groups(df.limit(0)).count() == 0


# Suffix arrays


@pytest.mark.parametrize("n,alphabet,depth", [(60, 2, 8), (300, 3, 10), (200, 1, 16), (1, 3, 4), (150, 2, 50)])
def test_longest_previous_factors(n, alphabet, depth):
    r = np.random.default_rng(n)
    text = r.integers(0, alphabet, n).astype(np.uint64)
    where = np.minimum(r.permutation(n), max(0, n - 5))

    def common(i, j):
        k = 0
        while k < depth and i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    want = [max([common(i, j) for j in range(n) if where[j] < where[i]], default=0) for i in range(n)]
    assert suffix_dedup.longest_previous_factors(text, where, depth).tolist() == want


def slow_repeats(rows):
    """{(id, text): covered words}, ids null last."""
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        w = t.split()
        covered = np.zeros(len(w), bool)
        for s in range(len(w) - suffix_dedup.LENGTH + 1):
            key = tuple(w[s : s + suffix_dedup.LENGTH])
            if key in seen:
                covered[s : s + suffix_dedup.LENGTH] = True
            seen[key] = 1
        out[i, t] = covered
    return out


def passages(seed, docs=60):
    r = random.Random(seed)
    shared = [words(r.choice([49, 50, 51, 60, 120, 300]), 10_000 + i) for i in range(12)]
    rows = []
    for i in range(docs):
        parts = [words(r.randrange(0, 80), i * 31 + seed)]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared), words(r.randrange(0, 40), r.randrange(10**6))]
        rows.append((i, " ".join(p for p in parts if p)))
    loop = "la " * 200
    return rows + [(500, loop + words(70, 1)), (501, loop), (502, "x y " * 90), (503, rows[3][1]), (504, near_copy(rows[5][1] + " " + words(200, 77), 4, 1)), (505, rows[5][1] + " " + words(200, 77))]


@pytest.mark.parametrize("seed,fragments", [(1, 2048), (2, 16), (3, 1)])
def test_repeats_are_those_of_brute_force(make, seed, fragments, monkeypatch):
    rows = passages(seed)
    monkeypatch.setattr(suffix_dedup, "FRAGMENTS", fragments)
    got = {k: np.zeros(len(v), bool) for k, v in slow_repeats(rows).items()}
    text = dict(rows)
    for r in suffix_dedup.repeated_spans(make(rows)).collect():
        assert not got[r.doc_id, text[r.doc_id]][r.start_word : r.end_word].any()
        got[r.doc_id, text[r.doc_id]][r.start_word : r.end_word] = True
    for k, v in slow_repeats(rows).items():
        assert (got[k] == v).all(), k


def test_streamed_rows_of_an_anchor_are_dealt_into_blocks(monkeypatch):
    r = random.Random(9)
    rows = sorted({(r.randrange(5) ** 2, r.randrange(12), r.randrange(50), 0, 30 + r.randrange(90)) for _ in range(400)})
    rows = sorted(rows + [(77, 1, 5, 0, 40), (78, 1, 5, 0, 40), (78, 1, 6, 0, 40)])
    table = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array([30] * len(rows)), pa.array([50] * len(rows))]
    batch = pa.record_batch(table, names=suffix_dedup._ANCHOR_NAMES)
    groups = {}
    for anchor, fragment, d, h, at in rows:
        groups.setdefault(anchor, {}).setdefault(fragment, []).append((d, h, at))
    for fragments in (4, 7, 1000):
        monkeypatch.setattr(suffix_dedup, "FRAGMENTS", fragments)
        for cut in (1, 13, 1000):
            out = [x for b in suffix_dedup._share(batch.slice(i, cut) for i in range(0, len(rows), cut)) for x in b.to_pylist()]
            assert Counter((x["y"], x["d"], x["x"]) for x in out if x["kind"] == 1) == Counter((a, f[0][0], f[0][2]) for a, fs in groups.items() if len(fs) > 1 for f in fs.values())
            sizes = Counter((x["y"], x["z"]) for x in out if x["kind"] == 1)
            assert max(sizes.values()) <= fragments and all((z == -1) == (len(groups[a]) <= fragments) for a, z in sizes)
            spans = {(x["d"], w) for x in out if x["kind"] == 0 for w in range(x["x"], x["y"])}
            assert spans == {(d, w) for fs in groups.values() for f in fs.values() for d, _, at in f if (d, at) != (f[0][0], f[0][2]) for w in range(at - 30, at + 50)}


def test_repeats_in_long_texts_and_under_other_ids(spark, monkeypatch):
    rows = [(i, t + " " + words(150, i) if i % 5 == 0 else t) for i, t in passages(4)]
    want = {k: v for k, v in slow_repeats(rows).items()}
    for size in (200, 1000):
        for module in ("common", "suffix_dedup"):
            monkeypatch.setattr(f"tarnmill.llm.{module}.SLICE_WORDS", size // 5)
        monkeypatch.setattr("tarnmill.llm.common.SLICE_BYTES", size)
        # the functions that a task runs, here in one process so that the sizes hold
        batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["d", "h", "t"])
        got = Counter((x["d"], x["anchor"], x["at"], x["left"], x["right"]) for b in suffix_dedup._anchor_rows(iter([batch])) for x in b.to_pylist() if x["anchor"] is not None)
        monkeypatch.undo()
        assert got == Counter((x["d"], x["anchor"], x["at"], x["left"], x["right"]) for b in suffix_dedup._anchor_rows(iter([batch])) for x in b.to_pylist() if x["anchor"] is not None)
        for t in (rows[0][1], rows[-1][1]):
            data = np.frombuffer(t.encode(), np.uint8)
            n = len(t.split())
            monkeypatch.setattr("tarnmill.llm.common.SLICE_BYTES", size)
            offsets = suffix_dedup._word_offsets(data, np.array([0, 1, n // 2, n - 1, n]))
            monkeypatch.undo()
            assert offsets.tolist() == [*(Words(pa.array([t])).start[[0, 1, n // 2, n - 1]].tolist()), len(data)]
    text = dict(rows)
    docs = spark.createDataFrame([(f"id {i}", t) for i, t in rows], "doc_id string, text string").repartition(3)
    got = {k: np.zeros(len(v), bool) for k, v in want.items()}
    spans = suffix_dedup.repeated_spans(docs).collect()
    for r in spans:
        i = int(r.doc_id[3:])
        got[i, text[i]][r.start_word : r.end_word] = True
    # another order of documents keeps another copy, but one of each passage
    left = [(i, " ".join(w for w, gone in zip(text[i].split(), got[i, text[i]]) if not gone)) for i in text]
    assert spans and abs(sum(map(sum, got.values())) - sum(map(sum, want.values()))) < 0.1 * sum(map(sum, want.values())) and left
    assert {r.doc_id for r in suffix_dedup.cut_repeats(docs).collect()} <= {f"id {i}" for i in text}


def test_cutting(make, nasty):
    docs = make(nasty)
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    a = nasty[2][1]
    # the copies of a under 5 and null are wholly repeats of the one under 4; rows of equal id and text are one document
    assert Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == Counter((i, t) for i, t in nasty) - Counter({(5, a): 1, (None, a): 1})
    shared = words(60, 99)
    left, right = words(5, 1), words(7, 2)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(make([(1, shared), (2, f" {left}\n{shared}  {right} "), (3, f"{right} {shared}")])).collect()}
    assert got[1].text == shared and got[2].text == f" {left}\n{right} " and got[3].text == f"{right} " and got[3].n_chars == len(right) + 1
    assert suffix_dedup.cut_repeats(make([])).count() == 0
    assert suffix_dedup.repeated_spans(make([])).count() == 0


# Decontamination

QUESTION = "Tom has 3 apples and 5 pears. He gives 3 apples to Mary and walks 10 km home. How many pears does Tom have left after all that?"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, QUESTION), (2, words(40, 5)), (3, None), (4, ""), (None, words(30, 6)), (5, "two words"), (6, "just five short words here"), (7, QUESTION)]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, item string")


CASES = {
    1: (QUESTION, {1, 7}),
    2: (words(30, 8) + " " + QUESTION.lower() + " " + words(30, 9), {1, 7}),
    3: (QUESTION.replace("Tom", "Bob").replace("3", "1,250").replace("Mary", "Jane").replace("km", "miles"), {1, 7}),
    4: (QUESTION.upper(), {1, 7}),
    5: (words(20, 1) + " " + words(40, 5) + ".", {2}),
    6: (words(40, 5)[:60], set()),
    7: (words(300, 12), set()),
    8: ("Just five short words here", {6}),
    9: ("12 34 56 78 90 12 34 56 km Tom Bob Jane Mary 1 2 3 4 5 6 7 8 9", set()),
    10: (words(25_000, 3) + " " + words(30, 6) + " " + words(10, 2), {None}),
}


def test_contamination(make, bench, nasty):
    rows = [(i, t) for i, (t, _) in CASES.items()] + [(i + 100 if i else None, t) for i, t in nasty]
    docs = make(rows)
    found = decontamination.find_contaminated(docs, bench)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    # two of the nasty texts begin with items
    assert got == {i: x for i, (_, x) in CASES.items() if x} | {None: {2, None}}
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if i not in got or i is None and t not in (words(60, 5), words(60, 6)))
    assert decontamination.find_contaminated(make([]), bench).count() == 0
    assert decontamination.find_contaminated(docs, bench.limit(0)).count() == 0


def slow_match(doc, item):
    """Every alignment and window of two token lists, one by one. Tokens: (value, kind in variant 0, kind in variant 1)."""
    n = len(item)
    if not 0 < n:
        return None
    size = min(n, 8)
    if n < 4:
        return (n, n) if [t[0] for t in doc] == [t[0] for t in item] else None
    covered = set()
    changed = {}
    for shift in range(-n, len(doc) + 1):
        for variant in (1, 2, None):
            kind = (lambda t: 0) if variant is None else (lambda t: t[variant])  # noqa: B023
            same = lambda i: 0 <= i + shift < len(doc) and kind(item[i]) == kind(doc[i + shift]) and (kind(item[i]) or item[i][0] == doc[i + shift][0])  # noqa: B023
            literal = lambda i: sum(kind(item[j]) == 0 for j in range(i, i + size)) >= size / 2  # noqa: B023
            starts = [i for i in range(n - size + 1) if all(map(same, range(i, i + size))) and literal(i)]
            inside = sorted({j for i in starts for j in range(i, i + size)})
            pairs = [(j, kind(item[j]), item[j][0], doc[j + shift][0]) for j in inside if kind(item[j])]
            bad = set()
            for j, k, a, b in pairs:
                there = [y for _, k2, x, y in pairs if (k2, x) == (k, a)]
                back = [x for _, k2, x, y in pairs if (k2, y) == (k, b)]
                # the commonest, and of equally common ones the first
                if max(there, key=there.count) != b or max(back, key=back.count) != a:
                    bad.add(j)
            for i in starts:
                if not bad & set(range(i, i + size)):
                    covered.update(range(i, i + size))
            changed.update({j: a != b for j, _, a, b in pairs if j in covered})
    if len(covered) < n / 2 or len(covered) < min(n, 13):
        return None
    return len(covered), sum(changed.values())


def tokens_of(text):
    t = decontamination.Templates(pa.array([text]))
    return list(zip(t.value.tolist(), t.kinds[0].tolist(), t.kinds[1].tolist()))


def test_reparameterised_items_are_those_of_brute_force(spark, make):
    r = random.Random(12)
    names, units = "Tom Mary Alice Boris Carla Dmitri Eva Frank".split(), "km kg hours miles cups euros".split()
    items, docs = [], []
    for i in range(25):
        w = [r.choice([*words(4, i * 50 + j).split(), str(r.randrange(2, 99)), r.choice(names)]) for j in range(r.choice([2, 3, 4, 6, 8, 12, 20, 40]))]
        w = [f"{x} {r.choice(units)}" if x.isdigit() and r.random() < 0.5 else x for x in w]
        items.append((i, "a " + " ".join(w) if i % 3 else " ".join(w)))
    for i in range(160):
        swap = {x: r.choice(names) for x in names}
        out = []
        for x in items[r.randrange(25)][1].split():
            if x in swap and r.random() < 0.97:
                x = swap[x]
            elif x.isdigit() and r.random() < 0.7:
                x = str(int(x) * (2 if i % 2 else r.randrange(1, 4)))
            elif r.random() < 0.03:
                x = "other"
            out.append(x)
        docs.append((i, " ".join(out) if i % 4 == 0 else f"{words(r.randrange(12), i)} {' '.join(out)} {words(r.randrange(12), i + 500)}"))
    want = {}
    parsed = {i: tokens_of(t) for i, t in items}
    for d, t in docs:
        doc = tokens_of(t)
        for i in parsed:
            if m := slow_match(doc, parsed[i]):
                want[d, i] = m[0]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = decontamination.find_contaminated(make(docs), bench).collect()
    assert {(x.doc_id, x.item_id): x.matched_tokens for x in found} == want and len(found) == len(want) >= 80


def test_short_items_match_whole_texts_only(spark, make):
    bench = spark.createDataFrame([(1, "Two words"), (2, "three of them"), (3, "one"), (4, "...")], "item_id long, text string")
    docs = make([(1, "two words"), (2, "two words more"), (3, "Three, of them!"), (4, "one"), (5, "one one"), (6, "...")])
    assert sorted((x.doc_id, x.item_id) for x in decontamination.find_contaminated(docs, bench).collect()) == [(1, 1), (3, 2), (4, 3)]


def test_tokens_of_long_texts_are_the_same_in_pieces(monkeypatch):
    text = f"{QUESTION} {words(300, 4)} 1,250 km. Then Bob said: 3\nmiles ... {'x' * 300} 4 {QUESTION} -- !!! {'?! ' * 60} Eva"
    whole = decontamination.Templates(pa.array([text]))
    for size in (20, 64, 500):
        monkeypatch.setattr(decontamination, "SLICE_BYTES", size)
        monkeypatch.setattr("tarnmill.llm.common.SLICE_BYTES", size)
        monkeypatch.setattr(decontamination, "SLICE_WORDS", size)
        parts = decontamination.Templates.of(pa.array([text]))
        assert (parts.value == whole.value).all() and all((a == b).all() for a, b in zip(parts.kinds, whole.kinds))
        rows = lambda t: sorted((v, s, p, k) for v, s, at, key in t.found([4, 8]) for p, k in zip(at.tolist(), key.tolist()))
        monkeypatch.setattr(decontamination, "SLICE_WORDS", 10**6)
        want = rows(whole)
        monkeypatch.setattr(decontamination, "SLICE_WORDS", size)
        assert rows(parts) == want


def test_changed_slots_are_counted_and_must_agree(spark):
    def match(a, b):
        docs, items = spark.createDataFrame([(1, a)], "doc_id long, text string"), spark.createDataFrame([(1, b)], "item_id long, text string")
        found = decontamination.find_contaminated(docs, items).collect()
        return decontamination.Match(found[0].matched_tokens, found[0].item_tokens, found[0].slots, found[0].slots_changed) if found else None

    assert match(QUESTION, QUESTION).changed == 0
    swapped = QUESTION.replace("Tom", "Bob").replace("3", "4")
    assert match(swapped, QUESTION).changed >= 3 and match(swapped, QUESTION).matched == match(QUESTION, QUESTION).matched
    assert match(QUESTION.replace("gives 3", "gives 8"), QUESTION).matched < match(QUESTION, QUESTION).matched
    short = "now add 3 and 4 then take 3 and 4 off again from 3 at once"
    assert match(short.replace("3", "7"), short) and match("now add 1 and 4 then take 9 and 2 off again from 5 at once", short) is None


DENSE = {
    1: "Compute 12 * 34 + 56 - 78 / 9",
    2: "Tom Bob Jane Mary Alice Peter Paul Susan Henry Clara Oscar Nina Hugo Ida",
    3: "The Quick Brown Fox Jumps Over The Lazy Dog While The Old Grey Cat Sleeps Under A Broken Chair",
    4: "mix 3 kg 4 g 5 ml 6 cups 7 lbs 8 oz 9 cups 10 ml 11 g 12 kg",
}


def test_copies_of_items_dense_in_slots_are_found(spark, make):
    bench = spark.createDataFrame(list(DENSE.items()), "item_id long, text string")
    rows = [(i, f"{words(30, i)}. {t} {words(30, 9 + i)}") for i, t in DENSE.items()] + [(10 + i, t) for i, t in DENSE.items()]
    # placeholders alone still match nothing
    rows += [(20, "Compute 21 * 43 + 65 - 87 / 5"), (21, "Ann Ben Carl Dora Emil Fritz Gerd Hanna Inge Jan Karl Lena Max Olga"), (22, "mix 13 kg 14 g 15 ml 16 cups 17 lbs 18 oz 19 cups 20 ml 21 g 22 kg")]
    docs = make(rows)
    found = decontamination.find_contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k + i, i) for i in DENSE for k in (0, 10)}
    assert all(r.coverage == 1 and r.slots_changed == 0 for r in found if r.doc_id > 10)
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {20, 21, 22}


def test_contamination_against_plain_windows(spark, sf_dir):
    """Brute force over words for the benchmark as it is: every item that a document holds word for word."""
    tok = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if f" {' '.join(tok(i['text']))} " in f" {' '.join(tok(d['text']))} "}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert want <= got and len(got) <= len(want) + 2


# Toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang, bad = r.choice([("en", ["zorbful", "zorbish", "zorbly"]), ("fr", ["kraquet", "kraqueur"])])
        w = words(r.randrange(20, 120), seed * 100_000 + i, 800).split()
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randrange(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((" ".join(w), lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = toxic_rows(700, 1)
    return toxicity.fit([r[0] for r in rows], np.array([r[2] for r in rows]), [r[1] for r in rows])


def test_held_out_accuracy(model):
    rows = toxic_rows(400, 2)
    scores = model.scores(pa.array([r[0] for r in rows]))
    toxic = np.array([r[2] for r in rows]) == 1
    found = scores >= np.array([model.thresholds.get(r[1], model.default) for r in rows])
    assert (found & toxic).sum() >= 0.95 * toxic.sum() and (found & ~toxic).sum() <= 0.03 * (~toxic).sum()
    assert set(model.thresholds) == {"en", "fr"}
    # an inflection that was never seen, by its stem
    assert model.scores(pa.array([words(40, 3) + " zorbxyz " + words(40, 4)]))[0] > model.scores(pa.array([words(80, 3)]))[0]


def test_gradients_go_down(model):
    m = toxicity.Model.fresh()
    rows = toxic_rows(64, 3)
    ids, first = toxicity.features(pa.array([r[0] for r in rows]))
    y = np.array([r[2] for r in rows], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * m.logits(ids, first))))
    before, memory = loss(), {}
    for _ in range(15):
        m.step(ids, first, y, np.ones(64), memory, 0.05)
    assert loss() < before - 0.1


def slow_logit(model, ids):
    """Forward pass by loops: embedded words, padded, each filter wherever it fits, greatest value, weights."""
    pad = np.zeros((max(toxicity.WIDTHS) - 1, toxicity.DIM))
    x = np.concatenate([np.array([sum(model.table[j].astype(float) for j in row) for row in ids]).reshape(-1, toxicity.DIM), pad])
    pooled = []
    for kernel, bias in zip(model.kernels, model.biases):
        for f in range(toxicity.FILTERS):
            values = [max(0.0, bias[f] + sum(float(x[at + j] @ kernel[j][:, f]) for j in range(len(kernel)))) for at in range(len(x) - len(kernel) + 1)]
            pooled.append(max(values))
    return float(np.array(pooled) @ model.out + model.bias)


def test_forward_pass_is_the_naive_one(model):
    texts = [words(n, n, 400) for n in (1, 2, 3, 7, 40)] + [r[0] for r in toxic_rows(6, 9)]
    for t in texts:
        ids, first = toxicity.features(pa.array([t]))
        assert abs(model.logits(ids, first)[0] - slow_logit(model, ids)) < 1e-4


def test_gradients_are_numerical_ones():
    m = toxicity.Model.fresh(3)
    rows = toxic_rows(8, 11)
    ids, first = toxicity.features(pa.array([r[0] for r in rows]))
    y, w = np.array([r[2] for r in rows], np.float32), np.linspace(0.5, 2, 8)

    def loss():
        z = m.logits(ids, first).astype(float)
        return float(np.mean(w * np.logaddexp(0, np.where(y == 1, -1, 1) * z)))

    # with a memory that swamps the step's own squares, a step is rate / sqrt(memory) times the gradient
    big, rate = 1e8, 1e4
    before = {"out": m.out.copy(), "k1": m.kernels[1].copy(), "b0": m.biases[0].copy(), "table": m.table.copy()}
    numeric = {}
    r = np.random.default_rng(0)
    used = np.unique(ids)
    for name, value in (("out", m.out), ("k1", m.kernels[1]), ("b0", m.biases[0]), ("table", m.table)):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in value.shape) if name != "table" else (int(r.choice(used)), int(r.integers(toxicity.DIM)))
            old, sides = value[at], []
            for d in (-5e-3, 5e-3):
                value[at] = old + d
                sides.append(loss())
            value[at] = old
            numeric[name, at] = (sides[1] - sides[0]) / 1e-2
    memory = {"out": np.full_like(m.out, big), "bias": np.full(1, big, np.float32), "table": np.full_like(m.table, big)}
    memory |= {f"k{i}": np.full_like(k, big) for i, k in enumerate(m.kernels)} | {f"b{i}": np.full_like(b, big) for i, b in enumerate(m.biases)}
    m.step(ids, first, y, w, memory, rate)
    after = {"out": m.out, "k1": m.kernels[1], "b0": m.biases[0], "table": m.table}
    for (name, at), want in numeric.items():
        got = (before[name][at] - after[name][at]) / rate * np.sqrt(big)
        assert abs(got - want) < 2e-3 + 0.1 * abs(want), (name, at, got, want)


def test_fitting_stays_within_its_bounds(make, spark, monkeypatch):
    rows = toxic_rows(40, 6)
    docs = make([*[(i, r[0]) for i, r in enumerate(rows)], *[(0, r[0]) for r in rows], *[(0, rows[0][0])] * 300, (50, "zorbful " + words(30_000, 1))])
    labels = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)] + [(1, 0), (1, 1), (1, 1), (50, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_features", lambda ids, y, langs, *a: seen.append((ids, y)) or toxicity.Model.fresh())
    for sample in (2, 10, 1000):
        toxicity.train(docs, labels, sample)
        ids, y = seen[-1]
        assert len(ids) == len(y) <= min(sample, 40) and (sample < 1000 or len(ids) == 40)  # the long text isn't fitted on
    assert seen[-1][1][1] == 1  # of several labels the greatest


def test_all_labelled_rows_are_fitted_on(make, spark, monkeypatch):
    rows = toxic_rows(400, 6)
    docs = make([*[(i, r[0]) for i, r in enumerate(rows)], (1000, "zorbful " + words(30_000, 1))])
    labels = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)] + [(1000, 1)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_shards
    monkeypatch.setattr(toxicity, "fit_shards", lambda d, counts, shards: seen.append((d.count(), d.agg({"ids": "count"}).first()[0], shards)) or fit(d, counts, shards))
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 130)
    model = toxicity.train(docs, labels)
    assert seen == [(401, 401, 3)]
    test = toxic_rows(200, 77)
    guess = model.scores(pa.array([r[0] for r in test])) >= model.default
    assert np.mean(guess == (np.array([r[2] for r in test]) == 1)) > 0.9
    one = toxicity.Model.fresh(3)
    ids, first = toxicity.features(pa.array([r[0] for r in rows[:9]] + ["", "one"]))
    whole = one.winners(ids, first)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 7)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, one.winners(ids, first)))


def test_long_texts_score_and_sign_as_whole_ones(model, monkeypatch):
    texts = [words(n, n) + end for n in (1, 2, 3, 60, 900) for end in ("", " " + "x" * 700, " zorbful")]
    scores, signs = model.scores(pa.array(texts)), simhash.signatures(pa.array(texts))
    for size in (50, 400):
        monkeypatch.setattr("tarnmill.llm.common.SLICE_BYTES", size)
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        monkeypatch.setattr(toxicity, "SLICE_WORDS", max(1, size // 30))
        assert np.allclose(model.scores(pa.array(texts)), scores, atol=1e-5)
        assert all((simhash.signatures(pa.array([t])) == s).all() for t, s in zip(texts, signs))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("", (), {"get": staticmethod(lambda name, default=None: default)})()
        sparkContext = type("", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_only_block_bits_that_can_be_cheapest_are_counted(spark, monkeypatch):
    few = spark.createDataFrame([(i, *np.random.default_rng(i).integers(-(2**62), 2**62, 4).tolist()) for i in range(300)], "node long, s0 long, s1 long, s2 long, s3 long")
    counted, count = [], simhash._counted
    monkeypatch.setattr(simhash, "_counted", lambda nodes, choices: counted.extend(choices) or count(nodes, choices))
    simhash.plan(few)
    assert counted == list(simhash.BLOCK_CHOICES[:4])


def test_block_bits_are_planned(make, spark):
    few = spark.createDataFrame([(i, *np.random.default_rng(i).integers(-(2**62), 2**62, 4).tolist()) for i in range(300)], "node long, s0 long, s1 long, s2 long, s3 long")
    alike = few.selectExpr("node", "0L as s0", "0L as s1", "s2", "s3").crossJoin(spark.range(20)).selectExpr("node * 20 + id as node", "s0", "s1", "s2", "s3")
    assert simhash.plan(few) == min(simhash.BLOCK_CHOICES) <= simhash.plan(alike)
    for bits in (8, 12, 21):
        assert 0.9 < 1 - (1 - np.prod([(256 - simhash.RADIUS - i) / (256 - i) for i in range(bits)])) ** simhash.tables_for(bits=bits) < 0.97


def test_slices_and_padding_change_nothing(model):
    texts = [r[0] for r in toxic_rows(50, 4)] + ["", None, "x", words(50_000, 1)]
    one = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(model.scores(pa.array(texts)), one, atol=1e-5)


def test_thresholds():
    s, y = np.array([0.9, 0.8, 0.4, 0.3]), np.array([1, 1, 0, 0])
    assert abs(toxicity.best_threshold(s, y) - 0.6) < 1e-9
    assert toxicity.best_threshold(s, np.zeros(4)) == float("inf")
    assert toxicity.best_threshold(np.full(4, 0.5), y) <= 0.5


def test_toxicity_cases(spark, make, nasty):
    docs = make([*nasty, *[(1000 + i, r[0]) for i, r in enumerate(toxic_rows(200, 5))]])
    labels = [(1000 + i, None, r[2]) for i, r in enumerate(toxic_rows(200, 5))] + [(1000, 1, None), (None, 1, 1), (99_999, 1, 1), (1, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count() and not any(np.isnan(r.score) for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1
    caught = {r.doc_id for r in out if r.toxic}
    toxic = {1000 + i for i, r in enumerate(toxic_rows(200, 5)) if r[2]}
    assert len(caught & toxic) >= 0.9 * len(toxic) and len(caught - toxic) <= 8
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id") >= 1000).count() == 200 - len({i for i in caught if i and i >= 1000})
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert not any(r.toxic for r in none) and toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.classify(make([]), labels).count() == 0


# The pipeline


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = docs.columns, docs
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        table = written(stage(spark, table, sf_dir), "test")
        if name != "packing":
            assert table.columns == names
            now = {r.doc_id: r.text for r in table.collect()}
            assert set(now) <= set(kept) and len(now) == table.count()
            if name == "suffix_dedup":
                assert not any(v.any() for v in slow_repeats(now.items()).values())
            else:
                assert all(kept[i] == t for i, t in now.items())
            kept = now
    assert {r.doc_id for r in table.collect()} == set(kept)
    tokens = Counter()
    for r in table.collect():
        tokens[r.doc_id] += r.n_tokens
    encode, _ = token_counts.encoder(token_counts.VOCABULARY)
    assert all(tokens[i] == encode([t])[0] for i, t in kept.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_pipeline_of_nasty_and_empty_tables(spark, make, nasty, sf_dir):
    for rows in (nasty, []):
        table = make(rows)
        names = table.columns
        for name, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, sf_dir), "test")
            assert name == "packing" or table.columns == names
        assert table.count() >= (len(rows) and 10)


def test_column_helper(make):
    docs = make([(1, "a")])
    assert docs.select(*columns(docs)).columns == docs.columns
