"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import U64, bound_batches, columns, drop_written, mix, slices, word_hashes, written
from tarnmill.llm.components import components

BITS = 256
#: Copies with a twentieth of their words changed differ in some 25 to 35 bits, other texts of one language in 100; the
#: fewest pairs lie between 46 and 54.
RADIUS = 46
#: Blocks: documents that agree on so many sampled bits of the signature are compared, in each of as many samples as
#: make two that differ in exactly the radius meet with probability RECALL (0.9 is wanted; the rest is for samples that
#: overlap). Fewer bits need fewer samples, but make larger blocks: `plan` weighs that by the blocks there are.
BLOCK_BITS = 18
RECALL = 0.92
BLOCK_CHOICES = (8, 10, 12, 15, 18, 21, 24, 27, 30, 33, 36, 39)
PROBES = 2
#: Comparisons of two members of a block (some 18 ns each) that cost as much as to move a signature to a block and slice
#: it there (some 15 us).
ROW_COST = 800
#: Bit planes between looks at whether a whole block has left the radius.
ABANDON_EVERY = 32
#: Cells of a query and 64 members that are worked on at once, and queries of one block.
CELLS = 1 << 13
QUERIES = 256
#: Blocks of so few members aren't sliced; of so many, several are sliced together.
SMALL = 24
MEDIUM = 512
#: Bits (a power of two) of the filter of rows that may go; it is broadcast as words of 64, some 10 MB at most.
FILTER_LOG2 = 24
#: Words whose bits are counted at once.
ROWS = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LANES = BITS // 64


def signatures(texts: pa.Array) -> np.ndarray:
    """(texts, 4) 64-bit lanes: the sign of the sum, over the distinct words of a text in lower case, of +-1 by each
    bit of the word's 256-bit hash. A text without words has all bits 0."""
    n = len(texts)
    out = np.zeros((n, _LANES), U64)
    h, first = word_hashes(texts, keep=_LETTER, lower=True)
    if not len(h):
        return out
    # distinct words of each text
    if n == 1:
        h = np.unique(h)
        doc = np.zeros(len(h), np.int64)
    else:
        doc = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    ones = np.zeros((_LANES, n, 64), np.int32)
    for at in range(0, len(h), ROWS):
        hh, dd = h[at : at + ROWS], doc[at : at + ROWS]
        begin = np.flatnonzero(np.append(True, dd[1:] != dd[:-1]))
        for lane in range(_LANES):
            bits = np.unpackbits(mix(hh + U64(lane * 0x9E3779B97F4A7C15 % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # one cumulative sum would need wide numbers; reduceat over the rows of each text keeps them small
            ones[lane, dd[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    size = np.bincount(doc, minlength=n)
    for lane in range(_LANES):
        out[:, lane] = np.packbits(2 * ones[lane] > size[:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def tables_for(radius: int = RADIUS, bits: int = BLOCK_BITS, recall: float = RECALL) -> int:
    """Tables by which a pair that differs in `radius` bits meets in one at least with probability `recall`."""
    return ceil(log(1 - recall) / log1p(-comb(BITS - radius, bits) / comb(BITS, bits)))


TABLES = tables_for()


def block_bits(tables: int = TABLES, bits: int = BLOCK_BITS, seed: int = 11) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.stack([r.choice(BITS, bits, replace=False) for _ in range(tables)])


def block_keys(sig: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(signatures, tables): the sampled bits of each table as a number."""
    out = np.zeros((len(sig), len(chosen)), np.int64)
    for t, bits in enumerate(chosen):
        for j, b in enumerate(bits.tolist()):
            out[:, t] |= ((sig[:, b // 64] >> U64(b % 64)) & U64(1)).astype(np.int64) << j
    return out


def planes(sig: np.ndarray) -> np.ndarray:
    """(bits, ceil(n / 64)): bit plane p holds bit p of all n signatures, 64 to a word."""
    n = len(sig)
    bits = np.unpackbits(sig.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    padded = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(U64)


def _add3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (sum, carry) of three bit vectors."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def near_cells(rows: np.ndarray, flips: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, query, member) within `radius` bits. rows: the bit planes of the members, (bits, words of 64, blocks);
    flips: those of the queries, (bits, blocks, queries), 0 or -1 each.

    A cell is a query and a word of 64 members of its block. The planes in which they differ are summed by carry-save
    adders into bit-sliced counters, one for each member; after every ABANDON_EVERY planes, the cells in which all 64
    counters are beyond the radius are given up."""
    levels: list[list[np.ndarray]] = []

    def push(vector: np.ndarray, level: int, most: int = 2) -> None:
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(vector)
            if len(levels[level]) <= most:
                return
            total, vector = _add3(*levels[level]) if len(levels[level]) == 3 else (levels[level][0] ^ levels[level][1], levels[level][0] & levels[level][1])
            levels[level] = [total]
            level += 1

    left: tuple[np.ndarray, ...] = ()
    for p in range(BITS):
        flip = flips[p].astype(np.int64).view(U64)  # the bit as a whole word
        push(rows[p][left[0], left[1]] ^ flip[left[1], left[2]] if left else rows[p][:, :, None] ^ flip, 0)
        if p + 1 < BITS and ((p + 1) % ABANDON_EVERY or p + 1 <= 3 * radius):
            continue
        for level, vectors in enumerate(levels):  # one counter of each weight
            if len(vectors) == 2:
                levels[level] = []
                push(vectors[0], level)
                push(vectors[1], level, 1)
        over = _beyond([v for v, in levels], radius)
        keep = np.nonzero(over != ~U64(0))
        left = tuple(x[keep[0]] for x in left) if left else keep
        if not len(left[0]):
            break
        levels = [[v[keep]] for v, in levels]
    if not len(left[0]):
        return left[1], left[2], left[0]
    cell, bit = np.nonzero(np.unpackbits((~over[keep]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return left[1][cell], left[2][cell], left[0][cell] * 64 + bit


def _flips(sig: np.ndarray) -> np.ndarray:
    """(bits, signatures): -1 where the signature has the bit."""
    return -np.ascontiguousarray(np.unpackbits(sig.view(np.uint8).reshape(len(sig), -1), axis=1, bitorder="little").T).view(np.int8)


def near_pairs(vertical: np.ndarray, sig: np.ndarray, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, earlier member) pairs within `radius` bits, of the members first:last as queries against all before them."""
    flips = _flips(sig[first:last])[:, None]
    words, step = (last + 63) // 64, max(1, CELLS // max(1, last - first))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w in range(0, words, step):
        _, q, m = near_cells(vertical[:, w : min(words, w + step), None], flips, radius)
        q, m = q + first, m + w * 64
        a.append(q[m < q])
        b.append(m[m < q])
    return np.concatenate(a), np.concatenate(b)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counters that are greater than the radius."""
    greater = np.zeros_like(counters[0])
    equal = ~greater
    for level in range(max(len(counters), int(radius).bit_length()) - 1, -1, -1):
        value = counters[level] if level < len(counters) else np.zeros_like(greater)
        if radius >> level & 1:
            equal &= value
        else:
            greater |= equal & value
            equal &= ~value
    return greater


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the parts of a and b one each; every member's parent is the least of its part, before and after."""
    x, y = parent[a], parent[b]
    apart = x != y
    if not apart.any():
        return
    for x, y in zip(*np.divmod(np.unique(x[apart] * len(parent) + y[apart]), len(parent))):
        while parent[x] != x:
            x = parent[x]
        while parent[y] != y:
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    while (parent[parent] != parent).any():
        parent[:] = parent[parent]


def block_edges(ids: np.ndarray, sig: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) edges that connect what pairs within the radius connect in a block: every member is a query against all
    before it; of the pairs found, those that join two parts are kept, so that n copies give n - 1 edges."""
    n, step = len(ids), 64 * QUERIES
    parent = np.arange(n)
    vertical = np.concatenate([planes(sig[i : i + step]) for i in range(0, n, step)], axis=1)
    for first in range(0, n, QUERIES):
        _join(parent, *near_pairs(vertical, sig, first, min(n, first + QUERIES), radius))
    joined = np.flatnonzero(parent != np.arange(n))
    return ids[joined], ids[parent[joined]]


def medium_pairs(sig: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius, as rows of sig, in several blocks at once, which begin at `first` and need equally many
    words of 64: sliced together, since a block alone is too short a vector."""
    most, words = int(size.max()), (int(size.max()) + 63) // 64
    at = np.arange(words * 64)
    there = at < size[:, None]
    padded = np.where(there[:, :, None], sig[np.minimum(first[:, None] + at, len(sig) - 1)], U64(0))
    rows = planes(padded.reshape(-1, _LANES)).reshape(BITS, len(first), words).transpose(0, 2, 1)
    flips = _flips(padded[:, :most].reshape(-1, _LANES)).reshape(BITS, len(first), most)
    block, query, member = near_cells(rows, flips, radius)
    good = (member < query) & (query < size[block])
    start = first[block[good]]
    return start + query[good], start + member[good]


def small_pairs(lanes: list[np.ndarray], first: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius in all blocks of one small size at once: too few members for words of 64, so pair by pair."""
    i, j = np.triu_indices(size, 1)
    x, y = (first[:, None] + j).ravel(), (first[:, None] + i).ravel()
    near = sum(np.bitwise_count(lane[x] ^ lane[y]).astype(np.int16) for lane in lanes) <= radius
    return x[near], y[near]


def blocks_edges(node: np.ndarray, sig: np.ndarray, first: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`block_edges` of the blocks that begin at `first`, those of up to MEDIUM members many at a time."""
    size = np.diff(np.append(first, len(node)))
    parent = np.arange(len(node))
    lanes = [np.ascontiguousarray(sig[:, i]) for i in range(_LANES)]
    for n in range(2, SMALL + 1):
        starts, step = first[size == n], max(1, 8 * CELLS // (n * (n - 1) // 2))
        for at in range(0, len(starts), step):
            _join(parent, *small_pairs(lanes, starts[at : at + step], n, radius))
    rest = np.flatnonzero((size > SMALL) & (size <= MEDIUM))
    rest = rest[np.argsort(size[rest], kind="stable")]
    words = (size[rest] + 63) // 64
    for w in np.unique(words).tolist():
        own, step = rest[words == w], max(1, CELLS // (w * w * 64))
        for at in range(0, len(own), step):
            _join(parent, *medium_pairs(sig, first[own[at : at + step]], size[own[at : at + step]], radius))
    joined = np.flatnonzero(parent != np.arange(len(node)))
    yield node[joined], node[parent[joined]]
    for f, n in zip(first[size > MEDIUM].tolist(), size[size > MEDIUM].tolist()):
        yield block_edges(node[f : f + n], sig[f : f + n], radius)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                key = batch.column(0).to_numpy(zero_copy_only=False)
                node = batch.column(1).to_numpy(zero_copy_only=False)
                sig = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(_LANES)], axis=1).view(U64)
                held.append((key, node, sig))
                if key[0] == key[-1] == held[0][0][0]:
                    continue  # all of one block so far
            if not held:
                continue
            key, node, sig = (np.concatenate(x) for x in zip(*held))
            last = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            held = [] if batch is None else [(key[last:], node[last:], sig[last:])]
            key, node, sig = key[:last], node[:last], sig[:last]
            if not last:
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            a, b = zip(*blocks_edges(node, sig, first, radius))
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _spread(chosen: np.ndarray):
    """(key, node, signature) of each node for each sample of bits; a key's lowest bits are the sample's first."""
    bits = chosen.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(_LANES)], axis=1).view(U64)
            keys = block_keys(sig, chosen)
            for t in range(len(chosen)):
                yield pa.record_batch([pa.array(keys[:, t] | t << bits), *batch.columns], names=["key", "node", "s0", "s1", "s2", "s3"])

    return run


_BLOCKS = "key long, node long, s0 long, s1 long, s2 long, s3 long"


def _counted(nodes: DataFrame, choices: list[int]) -> dict[int, float]:
    """For each number of block bits, the mean size of a node's block, over all nodes, in PROBES samples."""
    probe = max(choices)
    keys = nodes.mapInArrow(_spread(block_bits(PROBES, max(BLOCK_CHOICES), seed=12)[:, :probe]), _BLOCKS)
    cut = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("key", probe).alias("probe"), F.col("key").bitwiseAND(F.lit((1 << b) - 1)).alias("block")) for b in choices])).alias("c")
    sizes = keys.select(cut).groupBy("c.bits", "c.probe", "c.block").agg(F.count("*").cast("double").alias("n"))
    return {r["bits"]: r["squares"] / r["n"] for r in sizes.groupBy("bits").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n")).collect()}


def plan(nodes: DataFrame, radius: int = RADIUS) -> int:
    """The number of block bits of least cost: moving each node to `tables_for` blocks and comparing it with half of
    each. Block sizes are counted over all nodes, in PROBES samples, for those of BLOCK_CHOICES that can be the
    cheapest: the first four, of few blocks, at once, and each further one unless moving alone costs more."""
    choices = [b for b in BLOCK_CHOICES if b <= BITS - radius]
    cost: dict[int, float] = {}
    while todo := choices[len(cost) :][: 1 if cost else 4]:
        if cost and tables_for(radius, todo[0]) * ROW_COST >= min(cost.values()):
            break
        mean = _counted(nodes, todo)
        if not mean:
            return BLOCK_BITS
        cost |= {b: tables_for(radius, b) * (ROW_COST + mean[b] / 2) for b in todo}
    return min(cost, key=lambda b: cost[b], default=BLOCK_BITS)


def groups(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(signed, roots). signed: (row columns of docs' id, s0..s3, node) of every row; roots: (node, root) of the nodes
    that have a neighbour."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [signatures(batch.column(1)[a:b]) for a, b in slices(batch.column(1))]
            sig = np.concatenate(parts) if parts else np.zeros((0, _LANES), U64)
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(sig[:, i].view(np.int64)) for i in range(_LANES))], names=["doc_id", "h", "s0", "s1", "s2", "s3"])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(sign, f"doc_id {kind}, h long, s0 long, s1 long, s2 long, s3 long").withColumn("node", F.xxhash64("s0", "s1", "s2", "s3")), "signed")
    # equal signatures are one node, whatever their number; texts without words are no copies of each other
    nodes = signed.where("(s0 | s1 | s2 | s3) <> 0").select("node", "s0", "s1", "s2", "s3").distinct()
    nodes = written(nodes, "nodes")
    bits = plan(nodes, radius) if bits is None else bits
    tables = tables_for(radius, bits) if tables is None else tables
    blocks = nodes.mapInArrow(_spread(block_bits(tables, bits)), _BLOCKS)
    parts = blocks.repartition("key").sortWithinPartitions("key")
    edges = parts.mapInArrow(_compare(radius), "a long, b long")
    roots = components(edges)
    drop_written(nodes)
    return signed, roots


def assign(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """(doc_id, group_id, is_duplicate) of every row: group_id is the least doc_id of its group of near copies, which
    is the one that stays.

    Groups are the connected components of pairs whose 256-bit signatures differ in at most `radius` bits. Pairs are
    sought in blocks: two signatures that differ in a share d of their bits meet in one of the tables with
    probability of some 1 - (1 - (1 - d)^bits)^tables, over 0.9 at the radius itself and more below it, since unless
    given `tables` is what `tables_for` says for `bits`, and `bits` what `plan` finds cheapest for these documents. All
    members of a block are compared. Documents of equal signatures are one node, so copies cost nothing here.

    Texts without words (null or empty ones) are in groups of their own rows: group_id is their doc_id, none is a
    duplicate. Null doc_ids: they sort last, so that such a row stays only where no other does; repeated rows: one
    stays. Very long texts are signed whole. Empty table: empty result. Other columns are not read."""
    signed, roots = groups(docs, radius, tables, bits)
    return _ranked(signed, roots).select("doc_id", "group_id", "is_duplicate")


def _ranked(signed: DataFrame, roots: DataFrame) -> DataFrame:
    grouped = signed.join(roots, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"), F.expr("(s0 | s1 | s2 | s3) <> 0").alias("worded"))
    w = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    ranked = grouped.where("worded").select("doc_id", "h", F.first("doc_id").over(w).alias("group_id"), (F.row_number().over(w) > 1).alias("is_duplicate"))
    rest = grouped.where("not worded").select("doc_id", "h", F.col("doc_id").alias("group_id"), F.lit(False).alias("is_duplicate"))
    return ranked.unionByName(rest)


def _filtered(keyed: DataFrame, fate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash __tm_h is none of fate's h, the rest and a few more): by a filter of 2^FILTER_LOG2 bits."""
    bit = lambda h: F.col(h).bitwiseAND(F.lit((1 << FILTER_LOG2) - 1))
    words = fate.select(F.shiftright(bit("h"), 6).alias("__tm_w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("__tm_w").agg(F.bit_or("b").alias("__tm_b"))
    looked = keyed.withColumn("__tm_w", F.shiftright(bit("__tm_h"), 6)).join(F.broadcast(words), "__tm_w", "left")
    passes = F.expr("coalesce(shiftright(__tm_b, cast(__tm_h & 63 as int)) & 1L, 0L) = 1L")
    return looked.where(~passes), looked.where(passes)


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, bits: int | None = None) -> DataFrame:
    """docs with the one row of each group that `assign` keeps, all columns as they are; texts without words (null or
    empty ones among them) all stay. Null ids and repeated rows as in `assign`; empty table: empty result. Extra columns
    may have any name that doesn't begin with __tm_.

    Rows are told apart by doc_id and a hash of the text. Only what a group loses is joined back: an anti-join for
    rows all of whose kind go; where one of several rows of the same id and text stays, the lowest by a hash of all
    its columns does. A filter of bounded size, of the hashes of what groups lose, lets the other rows stay where they
    are, so that only texts that pass it are shuffled."""
    signed, roots = groups(docs, radius, tables, bits)
    fate = _ranked(signed, roots).groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("losers"))
    fate = written(fate.where("losers > 0"), "fate")
    drop_written(signed)
    keyed = docs.withColumn("__tm_h", F.xxhash64("text"))
    gone, some = fate.where("losers = n"), fate.where("losers < n")
    sure, keyed = _filtered(keyed, fate)
    match = keyed["doc_id"].eqNullSafe(fate["doc_id"]) & (keyed["__tm_h"] == fate["h"])
    sure = sure.select(*columns(docs))
    if some.isEmpty():
        return sure.unionByName(keyed.join(gone, match, "left_anti").select(*columns(docs)))
    kept = sure.unionByName(keyed.join(fate, match, "left_anti").select(*columns(docs)))
    w = Window.partitionBy("doc_id", "__tm_h").orderBy(F.xxhash64(*columns(docs)))
    ones = keyed.join(some, match, "left_semi").withColumn("__tm_rank", F.row_number().over(w)).where("__tm_rank = 1")
    return kept.unionByName(ones.select(*columns(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
