"""All pairs of short texts in blocks (of one company, say) by products of sparse rows, in bounded memory.

Equal rows of a block are one row with the ids of all, so that repeated texts are compared once. Blocks are cut into
chunks, each pair of chunks is a group of its own, and groups are worked through in slices: neither a large block nor a
frequent text makes a large task. The pairs of ids that come of it are as many as there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, ids of a row (rows of more ids are repeated), groups gathered up to so many rows, and products or
#: pairs at once.
CHUNK = 16_384
IDS = 256
GATHERED = 2_048
CELLS = 1 << 19


def grid(rows: DataFrame, block: str, mine: Column | None, chunk: int) -> DataFrame:
    """rows with i, j and side: once for each pair of chunks of the block. side 0 is compared with side 1; rows of side 2
    with each other. With `mine`, rows that meet it are on side 0 and the others on side 1."""
    large = rows.groupBy(block).agg(F.count("*").alias("__n")).where(F.col("__n") > chunk)  # at most one for each chunk of rows
    n = F.coalesce(F.ceil(F.col("__n") / chunk).cast("int"), F.lit(1))
    cut = rows.join(F.broadcast(large), block, "left").withColumn("__c", n).withColumn("__k", F.pmod(F.xxhash64("ids"), F.col("__c")).cast("int"))
    o = cut.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    k, other = F.col("__k"), F.col("__o")
    if mine is None:
        i, j, side = F.least(k, other), F.greatest(k, other), F.when(k < other, 0).when(k > other, 1).otherwise(2)
    else:
        i, j, side = F.when(mine, k).otherwise(other), F.when(mine, other).otherwise(k), F.when(mine, 0).otherwise(1)
    return o.select(F.col(block).alias("block"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"), "ids", "terms", "weights")


def compared(rows: DataFrame, block: str, id_type: str, score_type: str, judge, mine: Column | None = None) -> DataFrame:
    """(left_id, right_id, score) of rows (block, ids, terms, weights), left_id < right_id in one block; or, with `mine`,
    (left_id) of ids that meet it and have a partner that doesn't, some more than once.

    judge(dot, n, m) gives (score, whether it counts if n is the left one, the same for m) for arrays of products and of
    numbers of terms."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as bytes don't tell the work
    groups = grid(rows.where(F.col(block).isNotNull()), block, mine, CHUNK).repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "side")
    only_left = mine is not None
    schema = f"left_id {id_type}" if only_left else f"left_id {id_type}, right_id {id_type}, score {score_type}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            yield from _group(part, judge, only_left)

    return groups.mapInArrow(work, schema)


def _keys(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """For each row whether a new group begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("block", "i", "j"):
        a = t.column(c)
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        codes = a.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, small ones some at a time, with the number of the group of each row."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            # up to the first row of a new group after enough rows
            last = held[-1].slice(held[-1].num_rows - 1) if held else None
            new = _keys(pa.Table.from_batches([last, b]))[1:] if held else _keys(b)
            starts = np.flatnonzero(new)
            starts = starts[starts + rows >= GATHERED]
            if not len(starts):
                held.append(b)
                rows += b.num_rows
                break
            if starts[0]:
                held.append(b.slice(0, starts[0]))
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                yield t, np.cumsum(_keys(t)) - 1
            held, rows, b = [], 0, b.slice(starts[0])
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.cumsum(_keys(t)) - 1


def _list(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a column of lists."""
    c = t.column(name)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    offsets = c.offsets.to_numpy()
    return offsets - offsets[0], c.values.slice(offsets[0], offsets[-1] - offsets[0])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _group(part: tuple[pa.Table, np.ndarray], judge, only_left: bool) -> Iterator[pa.RecordBatch]:
    t, group = part
    side = t.column("side").to_numpy()
    at, terms = _list(t, "terms")
    _, weights = _list(t, "weights")
    size = np.diff(at)
    row = np.repeat(np.arange(len(group)), size)
    # a term of a group: terms of other groups never meet it
    code = np.unique(terms.dictionary_encode().indices.to_numpy().astype(np.int64) * (group[-1] + 1) + group[row], return_inverse=True)[1]
    weights = weights.to_numpy()
    id_at, ids = _list(t, "ids")
    for left, right in ((side == 2, side == 2), (side == 0, side == 1)):
        if not left.any() or not right.any():
            continue
        same = bool(side[left][0] == 2)
        for x, y, dot in _products(np.flatnonzero(left), np.flatnonzero(right), same, at, row, code, weights):
            score, as_left, as_right = judge(dot, size[x], size[y])
            if only_left:
                found = np.unique(x[as_left])
                if len(found):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(_spread(id_at[found], np.diff(id_at)[found])))], ["left_id"])
                continue
            keep = as_left | as_right
            yield from _pairs(x[keep], y[keep], score[keep], as_left[keep], as_right[keep], id_at, ids)


def _products(lefts, rights, same: bool, at, row, code, weights) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, product) of rows that share a term, slice by slice; if both sides are the same, with right
    rows from the left one on."""
    place = np.full(at.size - 1, -1, np.int64)
    place[rights] = np.arange(len(rights))
    mine = np.flatnonzero(place[row] >= 0)
    mine = mine[np.argsort(code[mine], kind="stable")]  # by term, then by row
    post, post_w = place[row[mine]], weights[mine]
    n_codes = int(code.max()) + 1 if len(code) else 0
    count = np.bincount(code[mine], minlength=n_codes)
    start = np.cumsum(count) - count
    s = 0
    while s < len(lefts):
        first = s if same else 0
        width = len(rights) - first
        e = min(len(lefts), s + max(1, CELLS // width))
        some = lefts[s:e]
        entry = _spread(at[some], at[some + 1] - at[some])
        c, n = code[entry], count[code[entry]]
        to = _spread(start[c], n)
        cell = np.repeat((np.repeat(np.arange(e - s), at[some + 1] - at[some]) * width - first), n) + post[to]
        dots = np.bincount(cell, np.repeat(weights[entry], n) * post_w[to], (e - s) * width) if len(cell) else np.zeros(0)
        hit = np.flatnonzero(dots > 0)
        x, y = hit // width, hit % width + first
        if same:
            keep = y >= x + s
            x, y, hit = x[keep], y[keep], hit[keep]
            used = np.bincount(c, minlength=n_codes)
            start, count = start + used, count - used
        yield some[x], rights[y], dots[hit]
        s = e


def _pairs(x, y, score, as_left, as_right, id_at, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Pairs of the ids of pairs of rows, the smaller id left, where the row of the left one may be left."""
    have = np.diff(id_at)
    values = ids.to_numpy(zero_copy_only=False)
    total = np.cumsum(have[x] * have[y])
    s = 0
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + CELLS)))
        a, b = x[s:e], y[s:e]
        n, m = have[a], have[b]
        pair = np.repeat(np.arange(e - s), n * m)
        k = _spread(np.zeros(e - s, np.int64), n * m)
        i, j = values[id_at[a][pair] + k // m[pair]], values[id_at[b][pair] + k % m[pair]]
        less = i < j
        keep = np.where(less, as_left[s:e][pair], as_right[s:e][pair]) & (i != j) & (less | (a != b)[pair])
        less, i, j = less[keep], i[keep], j[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(less, i, j), ids.type), pa.array(np.where(less, j, i), ids.type), pa.array(score[s:e][pair][keep])], ["left_id", "right_id", "score"])
        s = e


def collapsed(rows: DataFrame, block: str, content: list[str], id_col: str = "id") -> DataFrame:
    """(block, content, ids): a row for each distinct content of a block, or some if it has more than `IDS` ids."""
    each = rows.groupBy(block, *content).agg(F.collect_list(id_col).alias("__all"))
    parts = F.transform(F.sequence(F.lit(0), (F.size("__all") - 1).cast("int"), F.lit(IDS)), lambda s: F.slice("__all", s + 1, IDS))
    return each.select(block, *content, F.explode(parts).alias("ids"))
