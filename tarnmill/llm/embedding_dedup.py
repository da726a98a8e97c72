"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import U64, drop_written, written
from tarnmill.llm.components import components

COSINE = 0.95
#: Passes, and neighbours that follow a vector in the order of a pass and are compared with it: at least so many, and as
#: many more as a pair at the threshold needs to be met with probability RECALL (see `plan`).
PASSES = 16
NEIGHBOURS = 16
RECALL = 0.95
#: Comparisons that cost as much as to sort a vector.
SORT_COST = 64
#: Random hyperplanes of the sort key of a pass, and of the sketch that screens pairs before vectors are fetched.
KEY_BITS = 64
SKETCH_BITS = 256
#: Standard deviations by which a pair at the threshold may exceed its expected sketch distance.
SLACK = 5.0

_LANES = [f"k{i}" for i in range(SKETCH_BITS // 64)]


def planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, bits)).astype(np.float32)


def signs(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(rows, bits / 64): which side of each hyperplane, first hyperplane in the highest bit."""
    bits = np.packbits(x @ normals > 0, axis=1, bitorder="big")
    return bits.reshape(len(x), -1, 8)[:, :, ::-1].copy().view(U64)[:, :, 0]


def radius(cosine: float) -> int:
    """Sketch distance that a pair at the threshold exceeds with negligible probability."""
    p = np.arccos(cosine) / np.pi
    return int(np.ceil(SKETCH_BITS * p + SLACK * np.sqrt(SKETCH_BITS * p * (1 - p))))


def plan(nodes: int, cosine: float, shared: float) -> tuple[int, int]:
    """(passes, neighbours) of the least cost by which a pair at the threshold is met with probability RECALL.

    shared: squared length of the mean of the unit vectors, which is their mean cosine; around that mean a pair is
    at the cosine (cosine - shared) / (1 - shared). It is met in a pass if it shares the hyperplanes that leave as
    many nodes as there are neighbours. Where the mean cosine itself is over the threshold, any neighbours chain."""
    if shared >= cosine or nodes <= NEIGHBOURS:
        return PASSES, NEIGHBOURS
    same = 1 - np.arccos((cosine - shared) / (1 - shared)) / np.pi
    best = None
    reach = NEIGHBOURS
    while reach < 2 * nodes:
        met = same ** max(0.0, np.log2(nodes / reach))
        passes = max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-met)))) if met < 1 else PASSES
        if best is None or passes * (SORT_COST + reach) < best[0] * (SORT_COST + best[1]):
            best = passes, reach
        reach *= 2
    return best


def _units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors scaled to a largest number of 1, unit vectors) of arrays of one length."""
    x = vectors.flatten().to_numpy().reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x.astype(np.float32), x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(length, nodes, vectors) of each length of a batch of (node, v)."""
    size = np.asarray(pc.list_value_length(batch.column(1)))
    for dim in np.unique(size).tolist():
        here = pa.array(np.flatnonzero(size == dim))
        yield dim, batch.column(0).take(here), batch.column(1).take(here)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, number, sum of the unit vectors) of a task's vectors."""
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, vectors in _by_length(batch):
            count[dim] = count.get(dim, 0) + len(vectors)
            total[dim] = total.get(dim, 0) + _units(vectors, dim)[1].sum(axis=0)
    if count:
        yield pa.record_batch([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([total[d].tolist() for d in count], pa.list_(pa.float64()))], names=["dim", "n", "total"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return get("pass").astype(np.int32), get("node"), np.stack([get(c) for c in _LANES], axis=1).view(U64)


def _out(a, b, kind, turn=None, place=None, sketch=None) -> pa.RecordBatch:
    n = len(a)
    null = lambda t: pa.nulls(n, t)
    lanes = [pa.array(sketch[:, i].view(np.int64)) for i in range(len(_LANES))] if sketch is not None else [null(pa.int64())] * len(_LANES)
    return pa.record_batch(
        [pa.array(a), pa.array(b), pa.array([kind] * n, pa.int32()), pa.array(turn) if turn is not None else null(pa.int32()), pa.array(place) if place is not None else null(pa.int64()), *lanes],
        names=["a", "b", "kind", "pass", "place", *_LANES],
    )


_PAIRS = "a long, b long, kind int, pass int, place long, " + ", ".join(f"{c} long" for c in _LANES)


def _slide(most: int, reach: int):
    """Pairs (kind 0) inside a sorted partition, and its first and last rows (kind 1), whose neighbours may be in
    other partitions; `b` then holds the partition and `place` the row's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place = 0
        tail: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                if tail is not None:
                    turn, node, sketch, at = tail
                    yield _out(node, np.full(len(node), part), 1, turn, at, sketch)
                return
            turn, node, sketch = _arrays(batch)
            at = np.arange(place, place + len(node))
            new = at >= place
            place += len(node)
            if tail is not None:
                turn, node, sketch, at = (np.concatenate(x) for x in zip(tail, (turn, node, sketch, at)))
                new = np.concatenate([np.zeros(len(tail[0]), bool), new])
            if (head := at < reach)[new].any():
                head &= new
                yield _out(node[head], np.full(head.sum(), part), 1, turn[head], at[head], sketch[head])
            old = np.flatnonzero(~new)
            cuts = np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))
            for f, l in zip(cuts, np.append(cuts[1:], len(turn))):
                a, b = [], []
                for step in range(1, min(reach, l - f - 1) + 1):
                    later = slice(max(f + step, len(old)), l)  # pairs of two old rows are done
                    earlier = slice(later.start - step, l - step)
                    if later.start >= l:
                        continue
                    near = np.bitwise_count(sketch[later] ^ sketch[earlier]).sum(axis=1) <= most
                    a.append(node[later][near])
                    b.append(node[earlier][near])
                if a and len(x := np.concatenate(a)):
                    yield _out(x, np.concatenate(b), 0)
            tail = (turn[-reach:], node[-reach:], sketch[-reach:], at[-reach:])

    return run


def _across(most: int, reach: int):
    """Pairs between partitions, from the first and last rows of all partitions of a pass."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["b", "place"]).sort_values(["b", "place"], kind="stable")
        node, part = rows["a"].to_numpy(), rows["b"].to_numpy()
        sketch = rows[_LANES].to_numpy(np.int64).view(U64)
        a, b = [node[:0]], [node[:0]]
        for step in range(1, min(reach, len(node) - 1) + 1):
            near = (np.bitwise_count(sketch[step:] ^ sketch[:-step]).sum(axis=1) <= most) & (part[step:] != part[:-step])
            a.append(node[step:][near])
            b.append(node[:-step][near])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, passes: int | None = None, reach: int | None = None) -> DataFrame:
    """(id, group_id, is_duplicate) of every row: group_id is the least id of the connected component of pairs whose
    cosine is at least `cosine`.

    Equal vectors are one node. In each pass nodes are sorted by the concatenated sides of random hyperplanes through
    the mean of the unit vectors, and each is compared with the next `reach`; the key alone, the node and a sketch are sorted, not the vector. Pairs whose
    sketches are near are united over all passes, then verified on the vectors themselves. A pair at angle t shares
    (seen from the mean) the first j hyperplanes of a pass with probability (1 - t/pi)^j; unless given, `passes` and
    `reach` follow from the number of nodes and their mean cosine, so that a pair at the threshold is met with
    probability 0.95 (see `plan`).

    Null vectors, those with a null or a number that isn't finite, empty ones and zero vectors resemble nothing:
    group_id is their id. Vectors of different length are never compared as equal. Null ids sort last; a null id stays
    only in a group of null ids. Repeated rows: one stays. Empty table: empty result. Other columns are not read."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # + 0.0: -0.0 and 0.0 are equal numbers and must hash alike
    rows = written(rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("node", F.when(fine, F.xxhash64("v"))), "vectors")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.first("v").alias("v")), "nodes")

    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for r in nodes.mapInArrow(_sums, "dim int, n long, total array<double>").collect():
        count[r.dim] = count.get(r.dim, 0) + r.n
        total[r.dim] = total.get(r.dim, 0) + np.array(r.total)
    mean = {d: total[d] / count[d] for d in count}
    plans = [plan(count[d], cosine, float(m @ m)) for d, m in mean.items()]
    passes = passes or max((p for p, _ in plans), default=PASSES)
    reach = reach or max((r for _, r in plans), default=NEIGHBOURS)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, node, vectors in _by_length(batch):
                x, unit = _units(vectors, dim)  # sides don't depend on length
                centred = (unit - mean[dim]).astype(np.float32)
                sketch = [pa.array(c.view(np.int64)) for c in np.ascontiguousarray(signs(x, planes(dim, SKETCH_BITS, 1)).T)]
                for t in range(passes):
                    key = signs(centred, planes(dim, KEY_BITS, 1000 + t))[:, 0] ^ U64(1 << 63)  # order of signed numbers
                    yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(key.view(np.int64)), node, *sketch], names=["pass", "dim", "key", "node", *_LANES])

    lanes = ", ".join(f"{c} long" for c in _LANES)
    spread = nodes.mapInArrow(project, f"pass int, dim int, key long, node long, {lanes}")
    most = radius(cosine)
    # partitions in order of (pass, key); neighbours in other partitions are met in the second step
    found = written(spread.repartitionByRange("pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node").mapInArrow(_slide(most, reach), _PAIRS), "pairs")
    edge = found.where("kind = 1").select("pass", "a", "b", "place", *_LANES)
    across = edge.groupBy("pass").applyInPandas(_across(most, reach), "a long, b long")
    pairs = found.where("kind = 0").select("a", "b").unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("v").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("v").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    close = (F.size("x") == F.size("y")) & (dot("x", "y") >= cosine * F.sqrt(dot("x", "x") * dot("y", "y")))
    verified = pairs.join(left, "a").join(right, "b").where(close).select("a", "b")
    roots = components(verified)
    drop_written(found, nodes)
    least = rows.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    w = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last())
    grouped = least.where("root is not null").select("id", F.first("id").over(w).alias("group_id"), (F.row_number().over(w) > 1).alias("is_duplicate"))
    alone = least.where("root is null").select("id", F.col("id").alias("group_id"), F.lit(False).alias("is_duplicate"))
    return grouped.unionByName(alone).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
