"""Streams: dedup with time to live, daily counters, an incremental run, a breaker with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files; times become instants, since watermarks need those."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_within(events: DataFrame, keys: list[str], at: str, days: int) -> DataFrame:
    """First event of each key; the key is forgotten `days` after by the watermark, so state stays bounded."""
    return events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(keys)


def daily_counters(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """(key, day, sent, bounced, tripped) of tumbling days, emitted once a day is over."""
    bounced = F.count_if(F.col("value") < 2)
    d = events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("sent"), bounced.alias("bounced"))
    return d.select(key, F.to_date("w.start").alias("day"), "sent", "bounced", ((F.col("bounced") >= 2) & (F.col("bounced") >= 0.03 * F.col("sent"))).alias("tripped"))


def breaker_stream(events: DataFrame, key: str, failures: int = 5, seconds: float = 60.0, successes: int = 2) -> DataFrame:
    """(key, state, failures, trips) after each batch, of a breaker held as state; rows need ts and ok. Events of a batch
    are taken in the order of time; see tarnmill.operators.state.breaker for the rules."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, f, n, since, trips = state.get if state.exists else ("closed", 0, 0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "ok"], kind="stable")
        for t, ok in zip(rows["ts"].map(pd.Timestamp.timestamp), rows["ok"].astype(bool)):
            if s == "open" and t - since >= seconds:
                s, n = "half", 0
            if s == "open":
                continue
            if s == "half":
                n += 1
                if not ok:
                    s, f, n, since, trips = "open", 0, 0, t, trips + 1
                elif n >= successes:
                    s, f, n = "closed", 0, 0
            elif ok:
                f = 0
            elif f + 1 >= failures:
                s, f, n, since, trips = "open", 0, 0, t, trips + 1
            else:
                f += 1
        state.update((s, int(f), int(n), float(since), int(trips)))
        yield pd.DataFrame({key: [k[0]], "state": [s], "failures": [int(f)], "trips": [int(trips)]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, failures long, trips long", "s string, f long, n long, since double, trips long", "update", GroupStateTimeout.NoTimeout)


def incremental_run(stream: DataFrame, accepted: str, rejected: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads what is new, decides, and appends to two tables. A batch writes to folders named by its number in overwrite
    mode, so that one that is repeated after a failure leaves no second copy."""

    def batch(df: DataFrame, number: int) -> None:
        decided = decide(df).persist()
        try:
            decided.where("reject_reason is null").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            decided.where("reject_reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            decided.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table in memory; for small results."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
