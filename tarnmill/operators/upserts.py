"""Upserts as unions and aggregations, and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both, of each key the last in order; at a tie the new one. One aggregation, no window."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "__new")).alias("r"))
    return last.select(*keys, "r.*").drop("__new").select(*old.columns)


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))


def counters(events: DataFrame, key: str, kind: str, kinds: list[str], at: str) -> DataFrame:
    """A column of counts for each known kind and the last time; unknown kinds are left out."""
    known = events.where(F.col(kind).isin(kinds))
    return known.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.max(at).alias("last_seen_at"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def serials(rows: DataFrame, key: str, order: str, start: int = 1, bucket: int = 100_000) -> DataFrame:
    """rows, the first of each key, with serial numbers from `start` in the order of a whole-number column.

    Numbers are counted in ranges of the order column and offset by a running sum over the ranges' sizes, so that no
    task sorts all rows."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    ranged = first.withColumn("__b", F.floor(F.col(order) / bucket))
    sizes = ranged.groupBy("__b").agg(F.count("*").alias("n"))
    before = sizes.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("__b").orderBy(order)) + F.col("before") + F.lit(start - 1)
    return ranged.join(before, "__b").withColumn("serial", number).drop("__b", "before")


def write_facts(rows: DataFrame, path: str, day: str, mode: str = "append") -> None:
    """Facts by day, so that a look-back reads only its days."""
    rows.withColumn("day", F.to_date(day)).repartition("day").write.mode(mode).partitionBy("day").parquet(path)


def snapshot(df: DataFrame, path: str) -> int:
    """A CSV copy, read back and counted before anything destructive is done; ValueError if rows are missing."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    n = df.sparkSession.read.schema(df.schema).option("header", True).csv(path).count()
    if n != df.count():
        raise ValueError(f"the snapshot at {path} is not complete")
    return n


def lines(rows: DataFrame, text, order: list) -> DataFrame:
    """One row with the lines of a small report."""
    return rows.select(F.struct(*order, text.alias("line")).alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "\n").alias("report"))


def ensure_tables(spark: SparkSession, schemas: dict[str, str], base: str) -> None:
    """Creates empty Parquet tables that don't exist; existing ones stay."""
    for name, kinds in schemas.items():
        spark.createDataFrame([], kinds).write.mode("ignore").parquet(f"{base}/{name}")


def sheet_layout(rows: DataFrame, reason: Column) -> DataFrame:
    """Fact rows as rows of a sheet's tab, with a reason and defaults for what they don't hold."""
    unknown = F.lit("Unknown")
    return rows.select(
        F.col("id").alias("serial"), reason.alias("reason"), "company", F.col("source").alias("title"), F.date_format("processed_at", "yyyy-MM-dd").alias("applied_on"), F.lit("").alias("url"), F.concat(F.lit("R-"), F.col("k").cast("string")).alias("job_id"),
        unknown.alias("job_type"), unknown.alias("location"), F.lit("SDE").alias("resume"), unknown.alias("remote"), F.date_format("processed_at", "dd MMM, yyyy").alias("entry_date"), "source", unknown.alias("sponsorship"),
    )
