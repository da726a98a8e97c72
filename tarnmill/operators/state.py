"""State that depends on the order of events, as folds and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURES_TO_OPEN, SECONDS_OPEN, SUCCESSES_TO_CLOSE = 5, 60, 2


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, whether a new key begins, columns) of stretches of one key in rows sorted by the first column."""
    last, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        text = np.array(key.cast(pa.string()).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(text[1:] != text[:-1]) + 1).tolist(), len(text)]
        for f, l in zip(cuts, cuts[1:]):
            yield key[f], not begun or text[f] != last, [c.slice(f, l - f) for c in batch.columns[1:]]
            last, begun = text[f], True


def breaker(events: DataFrame, key: str, at: str, ok: str, failures: int = FAILURES_TO_OPEN, seconds: float = SECONDS_OPEN, successes: int = SUCCESSES_TO_CLOSE) -> DataFrame:
    """(key, state, failures, trips): where a circuit breaker stands after all events of a key in order.

    closed -> open after `failures` failures in a row; open -> half open at the first event `seconds` later, which is
    let through; half open -> closed after `successes` successes, -> open at a failure. Events while open are refused.

    A machine has to see its events in order, so the events of a key are one stream of a sorted partition; it is folded
    batch by batch, and no more than a batch and the state are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, f, n, since, trips, own = "closed", 0, 0, 0.0, 0, None
        out = lambda: pa.record_batch([pa.array([own.as_py()], own.type), pa.array([state]), pa.array([f], pa.int32()), pa.array([trips], pa.int32())], names=[key, "state", "failures", "trips"])
        for name, new, (times, goods) in _streams(batches):
            if new:
                if own is not None:
                    yield out()
                state, f, n, since, trips, own = "closed", 0, 0, 0.0, 0, name
            for t, good in zip(times.to_pylist(), goods.to_pylist()):
                if state == "open":
                    if t - since < seconds:
                        continue
                    state, n = "half", 0
                if state == "closed":
                    f = 0 if good else f + 1
                    if f >= failures:
                        state, f, since, trips = "open", 0, t, trips + 1
                elif not good:
                    state, n, since, trips = "open", 0, t, trips + 1
                else:
                    n += 1
                    if n >= successes:
                        state, n = "closed", 0
        if own is not None:
            yield out()

    rows = events.where(F.col(key).isNotNull()).select(key, F.col(at).cast("timestamp").cast("double").alias("t"), F.col(ok).cast("boolean").alias("ok"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "t", "ok").mapInArrow(run, f"{key} {kind}, state string, failures int, trips int")


def failures_in_a_row(events: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """events with the number of failures up to each since the last success."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(ok.cast("int")).over(w)
    island = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__run", run).withColumn("in_a_row", F.sum((~ok).cast("int")).over(island)).drop("__run")


def retry_due(queue: DataFrame, as_of: Column, hours: dict[str, int], other: int = 6, attempts: int = 3) -> DataFrame:
    """Queued rows whose waiting time, by kind of failure, is over and that have attempts left."""
    wait = F.lit(other)
    for kind, h in hours.items():
        wait = F.when(F.col("failure") == kind, h).otherwise(wait)
    at = F.timestamp_add("HOUR", wait, F.col("at"))
    return queue.withColumn("retry_at", at).where((F.col("attempts") < attempts) & (F.col("retry_at") <= as_of))


def cooled_down(alerts: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """Alerts that are sent: each at least `hours` after the last one sent of its key. A stream of a sorted partition,
    in which each step jumps to the next time that is late enough."""
    gap = hours * 3_600_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for name, new, (times,) in _streams(batches):
            t = times.cast(pa.int64()).to_numpy()
            last = None if new else last
            picked, i = [], 0
            while i < len(t):
                i = i if last is None else max(i, int(np.searchsorted(t, last + gap)))
                if i < len(t):
                    last = int(t[i])
                    picked.append(i)
                    i += 1
            if picked:
                yield pa.record_batch([pa.array([name.as_py()] * len(picked), name.type), times.take(pa.array(picked))], names=[key, at])

    rows = alerts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at)
    return rows.repartition(key).sortWithinPartitions(key, at).mapInArrow(run, rows.schema)


def within_ttl(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def newest(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def replay(transactions: DataFrame, retries: int = 3) -> DataFrame:
    """Pending transactions with attempts left, oldest first within an operation."""
    w = Window.partitionBy("operation").orderBy("created_at", "tx_id")
    return transactions.where((F.col("status") == "pending") & (F.col("retries") < retries)).withColumn("turn", F.row_number().over(w))
