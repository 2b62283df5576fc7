"""Industry benchmarks, comparisons and gaps over KPI snapshots.

Snapshots are long: entity, group, kpi, value, ts. Every operator is one
grouped aggregate; per-brand loops have no place here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import text as T


def latest_values(snapshots: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The latest value of each entity and KPI that is at most ``days`` old."""
    fresh = snapshots.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.make_interval(days=F.lit(days))))
    return fresh.groupBy("group", "entity", "kpi").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def quality_level(n: Column, least: int) -> Column:
    return F.when(n < least, "insufficient").when(n < 1.5 * least, "low").when(n >= 3 * least, "high").otherwise("medium")


def industry_benchmark(values: DataFrame, least: int = 5, digits: int = 6) -> DataFrame:
    """Per group and KPI: quartiles (linear interpolation) and mean from two values on, a 95 % interval of the mean within [0, 1] from four on."""
    v, n = F.col("value"), F.count("value")
    at = lambda p: F.when(n >= 2, F.round(F.percentile(v, F.lit(p)), digits))
    half = 1.96 * F.stddev_samp(v) / F.sqrt(n)
    return values.groupBy("group", "kpi").agg(
        n.alias("n"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.when(n >= 2, F.round(F.avg(v), digits)).alias("mean"),
        F.when(n >= 4, F.round(F.greatest(F.lit(0.0), F.avg(v) - half), digits)).alias("ci_lower"), F.when(n >= 4, F.round(F.least(F.lit(1.0), F.avg(v) + half), digits)).alias("ci_upper"),
        quality_level(n, least).alias("quality"),
    )


def exclusions(brands: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``brands`` with the first reason that excludes each, or null."""
    reason = F.lit(None).cast("string")
    for name, hit in reversed(reasons.items()):
        reason = F.when(hit, name).otherwise(reason)
    return brands.withColumn("excluded", reason)


def gap_significance(gap: Column) -> Column:
    return T.ladder(F.abs(gap), [(0.20, "large"), (0.10, "moderate"), (0.05, "small")], "none")


def gap_table(own: DataFrame, rivals: DataFrame, bench: DataFrame) -> DataFrame:
    """Per KPI: own value, average of the rivals, median of the industry, and the gap with its significance."""
    average = rivals.groupBy("entity", "kpi").agg(F.avg("value").alias("rivals"))
    joined = own.join(average, ["entity", "kpi"], "left").join(bench.select("group", "kpi", "p50"), ["group", "kpi"], "left")
    gap = F.col("value") - F.col("rivals")
    return joined.select("entity", "kpi", "value", "rivals", "p50", gap.alias("gap"), F.when(gap.isNotNull(), gap_significance(gap)).alias("significance"))


def display_mode(n: Column, quality: Column, freshness: Column) -> Column:
    """hidden, reference or full."""
    return F.when((freshness == "expired") | (quality == "insufficient") | (n == 0), "hidden").when((quality == "low") | (freshness == "stale"), "reference").otherwise("full")


def freshness(valid_until: Column, as_of: Column, grace_days: int = 7) -> Column:
    return F.when(valid_until >= as_of, "fresh").when(valid_until >= as_of - F.make_interval(days=F.lit(grace_days)), "stale").otherwise("expired")
