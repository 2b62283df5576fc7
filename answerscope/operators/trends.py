"""Time-series analysis of metric series: resampling, stability, drops, trends, attribution.

Series are long: entity, kpi, ts, value and ``seq``, the order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators.ranking import numbered

KEYS = ("entity", "kpi")


def bucket(ts: Column, granularity: str) -> Column:
    return {"daily": F.date_format(ts, "yyyy-MM-dd"), "monthly": F.date_format(ts, "yyyy-MM"), "weekly": T.week_bucket(ts)}[granularity]


def resample(series: DataFrame, granularity: str = "weekly", aggregation: str = "median", keys: Sequence[str] = KEYS) -> DataFrame:
    v = F.col("value")
    agg = {"median": F.median(v), "latest": F.max_by(v, F.col("seq")), "mean": F.avg(v)}[aggregation]
    return series.where(v.isNotNull()).groupBy(*keys, bucket(F.col("ts"), granularity).alias("period")).agg(agg.alias("value"), F.count("*").alias("point_count"))


def with_steps(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each point with its number, its predecessor, and mean and deviation of its whole series."""
    ordered, whole = W.partitionBy(*keys).orderBy("seq"), W.partitionBy(*keys)
    std = F.stddev_pop("value").over(whole)
    return series.select(
        "*", F.row_number().over(ordered).alias("i"), F.lag("value").over(ordered).alias("previous"), F.count("*").over(whole).alias("n"),
        F.avg("value").over(whole).alias("mean"), F.when(std > 0, std).otherwise(0.01).alias("std"),
    )


def cliff_drops(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Steps down by 0.10 or more and a fifth or more, to two deviations or more below the mean."""
    s = with_steps(series, keys)
    drop = F.col("previous") - F.col("value")
    share = F.when(F.col("previous") > 0, drop / F.col("previous")).otherwise(0.0)
    z = (F.col("value") - F.col("mean")) / F.col("std")
    hit = (F.col("n") >= 4) & (drop > 0) & (share >= 0.20) & (drop >= 0.10) & (z <= -2)
    return s.where(hit).select(*keys, "seq", F.round(drop, 4).alias("drop_abs"), F.round(share * 100, 1).alias("drop_pct"), F.round(z, 2).alias("z_score"), F.when(drop >= 0.20, "critical").otherwise("warning").alias("severity"))


def sustained(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series of six points or more whose at least five moves all go one way."""
    s = with_steps(series, keys)
    ups, downs = F.count_if(F.col("value") > F.col("previous")), F.count_if(F.col("value") < F.col("previous"))
    first, last, n = F.min_by("value", "seq"), F.max_by("value", "seq"), F.count("*")
    found = s.groupBy(*keys).agg(n.alias("periods"), ups.alias("ups"), downs.alias("downs"), (last - first).alias("change"))
    one_way = (F.col("ups") == 0) != (F.col("downs") == 0)
    slope = F.col("change") / (F.col("periods") - 1)
    found = found.where((F.col("periods") >= 6) & one_way & (F.col("ups") + F.col("downs") >= 5))
    business = (F.abs(slope) >= 0.02) & (F.abs("change") >= 0.08)
    return found.select(*keys, "periods", F.when(F.col("change") > 0, "improvement").otherwise("decline").alias("direction"), F.round("change", 4).alias("overall_change"), business.alias("business_significant"))


def stability(series: DataFrame, cliffs: DataFrame, missing: Column, spread: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score of 0 to 100 with its penalties; 0 for series of fewer than two points."""
    base = series.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), missing.alias("missing"), spread.alias("spread"))
    joined = base.join(cliffs.groupBy(*keys).agg(F.count("*").alias("cliffs")), list(keys), "left").withColumn("cliffs", F.coalesce("cliffs", F.lit(0)))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(1.0)
    penalties = [F.least(cv * 100, F.lit(40)), F.least(F.col("cliffs") * 15, F.lit(30)), F.least(F.col("missing") * 20, F.lit(20)), F.least(F.col("spread") * 20, F.lit(20))]
    score = F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - sum(penalties[1:], penalties[0])))
    grade = F.when(F.col("n") < 2, "insufficient").otherwise(T.ladder(score, [(80, "stable"), (60, "slight"), (40, "marked")], "unstable"))
    return joined.select(*keys, F.round(score, 4).alias("score"), grade.alias("grade"), F.round(penalties[0], 1).alias("volatility_penalty"), F.round(penalties[1].cast("double"), 1).alias("cliff_penalty"), T.ladder(F.col("n"), [(12, "high"), (6, "medium")], "low").alias("confidence"))


def volatility(series: DataFrame, keys: Sequence[str] = ("platform", "kpi")) -> DataFrame:
    n, mean = F.count("value"), F.avg("value")
    cv = F.when(mean > 0, F.stddev_pop("value") / mean).otherwise(0.0)
    return series.groupBy(*keys).agg(F.when(n >= 5, F.round(mean, 4)).otherwise(0.0).alias("mean"), F.when(n >= 5, F.round(cv, 4)).alias("cv"), F.coalesce(F.when(n >= 5, cv > 0.30), F.lit(False)).alias("is_volatile"), (n < 5).alias("insufficient_data"))


def change_scope(n_platforms: Column, competitors: Column, industry: Column) -> Column:
    return F.when(n_platforms == 0, "unknown").when((n_platforms == 1) & ~competitors, "platform_specific").when(competitors & industry, "industry_wide").when(~competitors, "brand_specific").otherwise("competitor_shared")


# The least change that means something.
THRESHOLDS = {"citation_rate": 0.03, "recommendation_quality": 0.03}


def attribution(published: DataFrame, series: DataFrame, pre_days: int = 14, lag_days: int = 7, count: int = 2) -> DataFrame:
    """Per publication: the last ``count`` values before it against the first ones after the lag, however late, with an effect label.

    ``published``: id, entity, at, confounded, threshold. ``series``: entity, ts, value. Values and the two marks of each
    publication are numbered in one range sort; a mark's number among the values of its entity says which values it needs,
    so that the rest is an equi-join by entity and number.
    """
    day = lambda n: F.make_interval(days=F.lit(n))
    marks = published.select("id", "entity", F.explode(F.array(F.struct(F.lit("pre").alias("side"), F.col("at").alias("ts")), F.struct(F.lit("post").alias("side"), (F.col("at") + day(lag_days)).alias("ts")))).alias("mark")).select("id", "entity", "mark.*")
    values = series.where("ts is not null and value is not null").select("entity", "ts", "value")
    both = marks.withColumn("is_value", F.lit(0)).unionByName(values.withColumn("is_value", F.lit(1)), allowMissingColumns=True)
    # a mark stands before the values of its own time
    placed = numbered(both, ["entity"], [F.col("ts"), F.col("is_value"), F.col("value"), F.col("id")])
    # among marks and values each has a place; among marks alone another; their difference counts the values before a mark
    held = numbered(placed.where("is_value = 0").drop("size"), ["entity"], [F.col("place")], "mark_place")
    upto = held.select("id", "entity", "side", (F.col("place") - F.col("mark_place")).alias("n_before"))
    wanted = F.when(F.col("side") == "pre", F.sequence(F.col("n_before") - (count - 1), F.col("n_before"))).otherwise(F.sequence(F.col("n_before") + 1, F.col("n_before") + count))
    asked = upto.select("id", "entity", "side", F.explode(wanted).alias("i"))
    by_number = numbered(placed.where("is_value = 1").select("entity", "ts", "value", F.col("place").alias("order")), ["entity"], [F.col("order")], "i").select("entity", "i", "ts", "value")
    met = asked.join(by_number, ["entity", "i"]).join(published.select("id", "at", "confounded", "threshold"), "id")
    near = met.where((F.col("side") == "post") | (F.col("ts") >= F.col("at") - day(pre_days)))
    of = lambda side: F.avg(F.when(F.col("side") == side, F.col("value")))
    n = lambda side: F.count_if(F.col("side") == side)
    found = near.groupBy("id").agg(of("pre").alias("pre"), of("post").alias("post"), n("pre").alias("n_pre"), n("post").alias("n_post"), F.first("confounded").alias("confounded"), F.first("threshold").alias("threshold")).where((F.col("n_pre") >= count) & (F.col("n_post") >= count))
    change = F.col("post") - F.col("pre")
    label = F.when(F.col("n_pre") + F.col("n_post") < 4, "insufficient_sample").when(F.col("confounded"), "confounded").when(F.abs(change) < F.col("threshold"), "no_obvious_effect").when(change > F.col("threshold"), "possible_action_effect").otherwise("negative_effect_possible")
    return found.select("id", F.round("pre", 4).alias("pre_avg"), F.round("post", 4).alias("post_avg"), F.round(change, 4).alias("change"), (F.abs(change) >= F.col("threshold")).alias("is_meaningful"), label.alias("label"))
