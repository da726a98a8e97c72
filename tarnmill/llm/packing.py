"""Packing of token sequences into windows by non-negative least squares over shallow length combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.llm import token_counts
from tarnmill.llm.common import written

WINDOW = 2048
#: For the least squares, lengths are rounded up to window / BINS tokens, so that the combinations number some 1,400.
BINS = 128
DEPTH = 3
#: Pieces that are numbered together.
PIECES_PER_BUCKET = 50_000


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most `depth` lengths from 1 to `bins` that fill `bins` exactly: a column each, with the
    count of every length (row length - 1)."""
    found: list[list[int]] = []

    def extend(left: int, most: int, parts: list[int]) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, most), 0, -1):
                extend(left - x, x, [*parts, x])

    extend(bins, bins, [])
    out = np.zeros((bins, len(found)))
    for j, parts in enumerate(found):
        for x in parts:
            out[x - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(rhs).max(initial=0.0))
    for _ in range(3 * a.shape[0] + 10):
        gradient = rhs - gram[:, active] @ x[active]
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            try:
                z = np.linalg.solve(gram[np.ix_(on, on)], rhs[on])
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            low = on[z <= 0]
            step = min(x[i] / (x[i] - z[k]) if x[i] > z[k] else 0.0 for k, i in enumerate(on) if z[k] <= 0)
            x[on] += step * (z - x[on])
            gone = low[x[low] <= 1e-12]
            gone = gone if len(gone) else low[:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


Patterns = list[tuple[int, dict[int, int]]]


def plan(histogram: np.ndarray, depth: int = DEPTH, bins: int = BINS) -> Patterns:
    """[(repeats, {length: count})] that use up the histogram (index 0: length 1, last: the window) exactly.

    Lengths are rounded up to one of `bins` steps of the window. Repeat counts of the combinations that fill it are
    solved by least squares, with longer lengths weighing more, as a long sequence left over costs more of a window;
    they are rounded and cut to what is there. Each combination takes the longest exact lengths of its bins. What
    remains is packed greedily by exact lengths: first into the room that rounding left in those windows, the longest
    that fits, then into new ones: the longest that is left, and again and again the longest that still fits."""
    window = len(histogram)
    bins = min(bins, window)
    step = window // bins
    left = histogram.astype(np.int64).copy()
    if left.sum() == 0:
        return []
    binned = left.reshape(bins, step).sum(axis=1)
    table = combinations(bins, depth)
    weight = np.sqrt(np.arange(1, bins + 1) / bins)[:, None]
    scale = float(binned.max())
    repeats = nnls(table * weight, binned / scale * weight[:, 0]) * scale
    solved: Patterns = []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        on = np.flatnonzero(table[:, j])
        times = min(int(round(repeats[j])), int((binned[on] // table[on, j]).min()))
        if times <= 0:
            continue
        binned[on] -= times * table[on, j].astype(np.int64)
        parts = [int(i) for i in on for _ in range(int(table[i, j]))]
        while times:
            exact: dict[int, int] = {}
            for i in parts:  # the longest of the bin that is left besides what this window has of it already
                here = np.arange(i * step, (i + 1) * step)
                free = here[left[here] > [exact.get(int(x) + 1, 0) for x in here]]
                exact[int(free[-1]) + 1] = exact.get(int(free[-1]) + 1, 0) + 1
            n = min(times, *(int(left[x - 1]) // c for x, c in exact.items()))
            for x, c in exact.items():
                left[x - 1] -= n * c
            solved.append((n, exact))
            times -= n
    out: Patterns = []
    for times, exact in sorted(solved, key=lambda p: sum(x * c for x, c in p[1].items())):
        while times:
            more = dict(exact)
            n = _fill(left, more, window - sum(x * c for x, c in exact.items()), times)
            out.append((n, more))
            times -= n
    while left.any():
        parts: dict[int, int] = {}
        n = _fill(left, parts, window, int(left.sum()))
        out.append((n, parts))
    return out


def _fill(left: np.ndarray, parts: dict[int, int], room: int, times: int) -> int:
    """Puts what fits into `room` of each of at most `times` windows, the longest first, and takes it from `left`;
    returns of how many windows that holds."""
    added: dict[int, int] = {}
    for x in (np.flatnonzero(left[:room])[::-1] + 1).tolist():
        if x > room:
            continue
        count = min(int(left[x - 1]), room // x)
        if count:
            added[x] = count
            room -= count * x
        if not room:
            break
    n = min([times, *(int(left[x - 1]) // c for x, c in added.items())])
    for x, c in added.items():
        left[x - 1] -= n * c
        parts[x] = parts.get(x, 0) + c
    return n


def layout(patterns: Patterns) -> tuple[np.ndarray, ...]:
    """(length, first, base, per pack, offset): the pieces of a length from number `first` on, up to the next row's, go
    `per pack` to a window from window `base` on, side by side from `offset`; sorted by length and first."""
    rows, base = [], 0
    used: dict[int, int] = {}
    for times, parts in patterns:
        at = 0
        for x, count in sorted(parts.items(), reverse=True):
            rows.append((x, used.get(x, 0), base, count, at))
            used[x] = used.get(x, 0) + times * count
            at += x * count
        base += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def _placer(table: tuple[np.ndarray, ...]):
    length, first, base, per, offset = table
    key = length << 44 | first  # numbers of pieces stay far under 2^44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (k, piece, start, n_tokens, i): window and position of the i-th piece of its length."""
        for batch in batches:
            x, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            row = np.searchsorted(key, x << 44 | i, "right") - 1
            nth = i - first[row]
            yield pa.record_batch([*batch.columns[:4], pa.array(base[row] + nth // per[row]), pa.array(offset[row] + nth % per[row] * x)], names=["k", "piece", "start", "n_tokens", "pack_id", "position"])

    return run


def n_words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """(id, piece, start, n_tokens, pack_id, position): where each piece of each sequence goes. `length`: the column of
    sequence lengths, by default the number of words of `text`; `pack_texts` counts tokens.

    A sequence longer than the window is cut into whole windows and a rest. `start` is the piece's first token in its
    sequence, `position` its place in the window in tokens; pieces of a pack never overlap. A sequence of no tokens
    (null, empty or negative length) takes no room: one row with null pack_id and position. Repeated rows are packed as
    often as they occur; with equal ids and lengths it doesn't matter which goes where. A null id is an id like others.
    Very long texts make many pieces. Empty table: empty result. Columns other than the id and those that `length`
    uses are not read.

    Rounding to bins only steers the least squares; windows are filled by exact lengths, so short pieces waste no room
    (tested: at most 2 % more windows than first fit decreasing).

    What reaches the driver is the histogram of the `window` lengths. Pieces are numbered within a length in hash
    buckets of a bounded size, so that no task sees all pieces of a common length; a bucket's first number comes from a
    running sum over bucket counts. The layout has a few rows for each pattern in use, bounded by the window."""
    if window % bins:
        raise ValueError("window must be a multiple of bins")
    key = F.col("`" + id_col.replace("`", "``") + "`")
    length = n_words(F.col("`text`")) if length is None else length
    rows = df.select(key.alias("k"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    pieces = rows.select("k", F.posexplode(F.expr(f"transform(sequence(0L, greatest(n - 1, 0L) div {window}L), i -> named_struct('start', i * {window}L, 'n', greatest(0L, least(n - i * {window}L, {window}L))))")).alias("piece", "p"))
    pieces = pieces.select("k", F.col("piece").cast("long"), "p.start", F.col("p.n").alias("n_tokens"))
    # narrow rows, written once: the texts are read and counted only once, and both uses see the same rows
    pieces = written(pieces, "pieces")
    histogram = np.zeros(window, np.int64)
    for row in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect():
        histogram[row["n_tokens"] - 1] = row["count"]
    # buckets of each length by its count; as an array literal of one number a length
    buckets = F.element_at(F.lit([1 + int(n) // PIECES_PER_BUCKET for n in histogram]), F.col("n_tokens").cast("int"))
    placed = pieces.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("k", "piece"), buckets).cast("int"))
    counts = placed.groupBy("n_tokens", "bucket").agg(F.count("*").alias("size"))
    firsts = counts.select("n_tokens", "bucket", (F.sum("size").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("size")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("k", "piece")) - 1
    numbered = placed.withColumn("i", nth).join(firsts, ["n_tokens", "bucket"]).select("k", "piece", "start", "n_tokens", (F.col("i") + F.col("before")).alias("i"))
    kind = rows.schema["k"].dataType.simpleString()
    found = numbered.mapInArrow(_placer(layout(plan(histogram, depth, bins))), f"k {kind}, piece long, start long, n_tokens long, pack_id long, position long")
    empty = pieces.where("n_tokens = 0").select("k", "piece", "start", "n_tokens", F.lit(None).cast("long").alias("pack_id"), F.lit(None).cast("long").alias("position"))
    return found.unionByName(empty).withColumnRenamed("k", id_col)


def pack_texts(docs: DataFrame, vocabulary: str = token_counts.VOCABULARY, window: int = WINDOW) -> DataFrame:
    """`pack` of (doc_id, text) by the tokens of a vocabulary, as `token_counts` counts them: null and empty texts have
    none, very long ones are counted in pieces. Everything else as there."""
    return pack(token_counts.token_counts(docs, path=vocabulary), length=F.col("n_tokens"), window=window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
