"""Statistical process control over daily rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_rates(jobs: DataFrame) -> DataFrame:
    """(source, day, volume, rate): share of valid postings in percent of each source and day."""
    days = jobs.where(~F.col("source").isin("", "Unknown")).groupBy("source", F.to_date("processed_at").alias("day"))
    return days.agg(F.count("*").alias("volume"), (F.lit(100.0) * F.count_if(F.col("outcome") == "valid") / F.count("*")).alias("rate"))


def source_stats(rates: DataFrame, least_days: int = 3) -> DataFrame:
    """Mean, sample deviation (0 for one day), last value, its z score (0 without deviation) and control limits, with
    the two values before the last. One aggregation: days of a source are ordered within its sorted array."""
    ordered = rates.groupBy("source").agg(
        F.avg("rate").alias("mean"),
        F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("std"),
        F.count("*").alias("days"),
        F.sum("volume").alias("total_volume"),
        F.max_by(F.struct("rate", "volume"), "day").alias("last"),
        F.sort_array(F.collect_list(F.struct("day", "rate")), asc=False).alias("series"),
    )
    out = ordered.where(F.col("days") >= least_days).select(
        "source", "mean", "std", "days", "total_volume",
        F.col("last.rate").alias("current"), F.col("last.volume").alias("current_volume"),
        F.col("series")[1]["rate"].alias("previous"), F.col("series")[2]["rate"].alias("before_previous"),
    )
    return out.withColumns({
        "z": F.when(F.col("std") > 0, (F.col("current") - F.col("mean")) / F.col("std")).otherwise(0.0),
        "ucl": F.col("mean") + 2 * F.col("std"),
        "lcl": F.greatest(F.lit(0.0), F.col("mean") - 2 * F.col("std")),
    })


def spc_report(stats: DataFrame) -> DataFrame:
    status = F.when(F.col("z") < -2.5, "critical").when(F.col("z") < -2.0, "warning").when(F.col("current") < F.col("lcl"), "degraded").otherwise("healthy")
    r = lambda c, n: F.round(c, n).alias
    return stats.select("source", r("mean", 1)("mean_rate"), r("std", 1)("std"), r("current", 1)("current_rate"), r("z", 2)("z_score"), r("ucl", 1)("ucl"), r("lcl", 1)("lcl"), F.col("days").alias("days_tracked"), "total_volume", status.alias("status"))


def alerts(stats: DataFrame) -> DataFrame:
    """(source, alert_type, severity, current_rate, baseline_rate): outage, degradation or anomaly, the first that
    holds, and recovery besides."""
    kind = lambda t, s, rank: F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(rank).alias("rank"))
    first = (
        F.when(F.col("current_volume") == 0, kind("outage", "critical", 0))
        .when(F.col("z") < -2.0, kind("degradation", "warning", 1))
        .when((F.col("current") < F.col("lcl")) & (F.col("std") > 0), kind("anomaly", "info", 2))
    )
    back = (F.col("previous") < F.col("lcl")) & (F.col("before_previous") < F.col("lcl")) & (F.col("current") >= F.col("mean"))
    recovery = F.when(back, kind("recovery", "info", 2))
    found = stats.select("source", F.round("current", 2).alias("current_rate"), F.round("mean", 2).alias("baseline_rate"), F.explode(F.array_compact(F.array(first, recovery))).alias("a"))
    return found.select("source", F.col("a.t").alias("alert_type"), F.col("a.s").alias("severity"), "current_rate", "baseline_rate", F.col("a.rank").alias("rank"))


def fill_days(rates: DataFrame) -> DataFrame:
    """Days without postings between the first and last day of all sources, with volume 0 and rate 0."""
    span = rates.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    full = rates.select("source").distinct().crossJoin(F.broadcast(days))
    return full.join(rates, ["source", "day"], "left").select("source", "day", F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def streaks(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, start, length) of runs of consecutive days."""
    w = Window.partitionBy(*keys).orderBy(day)
    island = F.date_sub(F.col(day), F.row_number().over(w))
    return days.select(*keys, day).distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min(day).alias("start"), F.count("*").alias("length")).drop("island")
