"""Aggregations over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; null for no whole."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def outcome_counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "valid").alias("valid"),
        F.count_if(F.col("outcome") == "discarded").alias("discarded"),
    ]


def source_quality(jobs: DataFrame) -> DataFrame:
    counted = jobs.groupBy("source").agg(*outcome_counts(), F.round(F.avg("processing_time_ms"), 1).alias("avg_ms"))
    return counted.withColumn("valid_pct", pct(F.col("valid"), F.col("total")))


def share_of(rows: DataFrame, key: str, whole: DataFrame, most: int | None = None) -> DataFrame:
    """(key, count, pct): counts by key as a share of the rows of `whole`, the `most` largest, ties by key."""
    total = whole.agg(F.count("*").alias("_all"))
    counted = rows.groupBy(key).agg(F.count("*").alias("count"))
    out = counted.crossJoin(F.broadcast(total)).select(key, "count", pct(F.col("count"), F.col("_all")).alias("pct"))
    return out.orderBy(F.desc("count"), F.asc(key)).limit(most) if most else out


#: Half the share of rows that a bracket around a rank holds, and rows up to which there is no bracket.
BRACKET, FEW = 1e-4, 100_000


def indexed_percentiles(rows: DataFrame, value: str, points: dict[str, float], small: int = 100) -> DataFrame:
    """One row with the element of rank int(n * p), counted from 0, for each point, and count. Points of 0.99 and
    above give the last element up to `small` rows. Zeros without rows.

    A first aggregation brackets each rank by approximate quantiles, whose error is a tenth of the bracket; a second
    counts what lies below each bracket and the distinct values in it, so that a few values in ten thousand are shuffled
    and ordered, and the result is exact. Up to FEW rows all lie in the bracket."""
    from pyspark.sql import Window

    valid = rows.where(F.col(value) > 0).select(F.col(value).alias("v"))
    ends = [min(1.0, max(0.0, p + side)) for p in points.values() for side in (-BRACKET, BRACKET)]
    around = F.broadcast(valid.agg(F.count("*").alias("all"), F.percentile_approx("v", ends, int(10 / BRACKET)).alias("q")))
    both = valid.crossJoin(around)
    place = lambda i: F.when(F.col("all") <= FEW, 0).when(F.col("v") < F.col("q")[2 * i], -1).when(F.col("v") > F.col("q")[2 * i + 1], 1).otherwise(0)
    # below a bracket one row a point; inside one a row for each value; above nothing
    parts = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), place(i).alias("at")) for i in range(len(points))]), lambda x: x["at"] <= 0)
    each = both.select("v", "all", F.explode(parts).alias("p")).select("all", "p.i", F.when(F.col("p.at") == 0, F.col("v")).alias("v"))
    counted = each.groupBy("i", "v", "all").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first())))
    picks = []
    for i, (name, p) in enumerate(points.items()):
        rank = F.floor(F.col("all") * F.lit(p))
        if p >= 0.99:
            rank = F.when(F.col("all") > small, rank).otherwise(F.col("all") - 1)
        picks.append(F.coalesce(F.min(F.when((F.col("i") == i) & (F.col("upto") > rank), F.col("v"))), F.lit(0.0)).alias(name))
    return upto.agg(*picks, F.coalesce(F.max("all"), F.lit(0)).alias("count"))


def weekly(rows: DataFrame, day: str) -> DataFrame:
    """(week_ending, n, cumulative): counts by week ending on Sunday, weeks without rows included."""
    from pyspark.sql import Window

    week = F.next_day(F.date_sub(F.col(day), 1), "SUN")
    counted = rows.where(F.col(day).isNotNull()).groupBy(week.alias("week_ending")).agg(F.count("*").alias("n"))
    span = counted.agg(F.min("week_ending").alias("a"), F.max("week_ending").alias("b")).where("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week_ending"))
    full = calendar.join(counted, "week_ending", "left").select("week_ending", F.coalesce("n", F.lit(0)).alias("n"))
    # a row a week: one window over all is bounded by the calendar
    return full.withColumn("cumulative", F.sum("n").over(Window.orderBy("week_ending").rowsBetween(Window.unboundedPreceding, 0)))
