"""A brand beside its competitors: the matrix of latest snapshots, and why a KPI differs from theirs.

Snapshots are wide, one row a run of collecting: entity, ts and one column a KPI. The latest row of an entity is one
``max_by``; a competitor set is exploded and joined on the entity, so a brand that half of all sets name is the only hot
key: the joined side holds one row an entity, and adaptive execution splits the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators.benchmark import gap_significance

# KPIs with their names for customers, metrics of the matrix, findings, caveats and reasons.
LABELS = {
    "sov": "品牌被 AI 看见的程度", "first_rec_rate": "AI 优先推荐品牌的比例", "accuracy_rate": "AI 描述品牌的准确程度", "completeness_rate": "AI 对品牌描述的完整程度",
    "citation_rate": "AI 引用官方来源的频率", "scenario_recall": "AI 在真实场景中想到品牌的能力", "semantic_stability": "AI 对品牌描述的一致性", "differentiation": "AI 是否区分品牌与竞品的差异",
    "cross_platform_consistency": "不同 AI 平台对品牌说法的一致程度", "recommendation_quality": "AI 推荐品牌时的理由质量",
}
MATRIX = ("sov", "first_rec_rate", "accuracy_rate", "completeness_rate", "citation_rate")
NO_GAP = "品牌与该指标在竞品中无明显差距"
CAVEATS = ("该判断基于当前采集样本", "差距较小，可能属于正常波动范围", "仍需通过后续内容发布和复测验证")
CONFIDENCE = {"none": ("low", "无竞品数据"), "few": ("low", "竞品数据不足"), "many": ("high", "数据充分，基准可靠"), "some": ("medium", "竞品数据有限，结论仅供参考")}
LEAST, SMALL = 0.01, 0.05


def latest(snapshots: DataFrame, kpis: Sequence[str], since: Column | None = None) -> DataFrame:
    """The newest row of each entity, at or after ``since``; of rows of one time, that with the greatest values."""
    rows = snapshots if since is None else snapshots.where(F.col("ts") >= since)
    return rows.where("entity IS NOT NULL").groupBy("entity").agg(F.max(F.struct("ts", *kpis)).alias("_row")).select("entity", "_row.*")


def active_sets(sets: DataFrame) -> DataFrame:
    """The newest active set of each brand: ``sets`` has brand, competitors (array), active, updated_at."""
    return sets.where("active AND brand IS NOT NULL").groupBy("brand").agg(F.max(F.struct("updated_at", F.coalesce("competitors", F.array().cast(sets.schema["competitors"].dataType)).alias("competitors"))).alias("_set")).select("brand", "_set.competitors")


def competitor_matrix(snapshots: DataFrame, sets: DataFrame, metrics: Sequence[str] = MATRIX) -> DataFrame:
    """Brand, member (itself and each competitor once), is_own, ts, metrics and sample_size of the member's latest overall snapshot.

    ``snapshots`` also has platform and dimension; only rows where both are null are overall ones. Brands without an
    active set and members without an overall snapshot have no rows.
    """
    overall = latest(snapshots.where("platform IS NULL AND dimension IS NULL"), [*metrics, "sample_size"])
    members = active_sets(sets).select("brand", F.explode(F.array_distinct(F.concat(F.array("brand"), "competitors"))).alias("member"))
    joined = members.join(overall, F.col("member") == F.col("entity"))
    return joined.select("brand", "member", (F.col("brand") == F.col("member")).alias("is_own"), "ts", *metrics, "sample_size")


def compare(snapshots: DataFrame, sets: DataFrame, kpis: Sequence[str], as_of: Column, own_days: int = 30, days: int = 14) -> DataFrame:
    """Per brand with a snapshot or a set, and KPI: value, rivals (mean), total_competitors and with_data.

    Own snapshots count for ``own_days``, those of competitors for ``days``. A competitor named twice counts twice, as
    it does in the mean; one without a recent snapshot counts only in total_competitors.
    """
    day = lambda n: as_of - F.make_interval(days=F.lit(n))
    fresh = snapshots.where(F.col("ts") <= as_of)
    own, theirs = latest(fresh, kpis, day(own_days)), latest(fresh, kpis, day(days))
    named = active_sets(sets)
    members = named.select("brand", F.explode("competitors").alias("member")).join(theirs, F.col("member") == F.col("entity"))
    means = members.groupBy("brand").agg(F.count("*").alias("with_data"), *[F.avg(k).alias(f"_mean_{k}") for k in kpis])
    brands = own.withColumnRenamed("entity", "brand").join(named.select("brand", F.size("competitors").alias("total_competitors")), "brand", "full").join(means, "brand", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.col(f"_mean_{k}").alias("rivals")) for k in kpis]))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_competitors", "with_data")]
    return brands.select("brand", *counts, each.alias("_k")).select("brand", "_k.*", "total_competitors", "with_data")


def gap_attribution(compared: DataFrame, bench: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """``compared`` with p50, gap, significance, finding, drivers, counters, confidence, reason and caveat.

    The gap is to the competitors' mean, else to the industry's median (``bench``: kpi, p50, quality; one row a KPI),
    else 0. Below LEAST nothing differs; behind is a driver, ahead speaks against one. A KPI without a label is its own.
    """
    joined = compared.join(bench.select("kpi", "p50", F.col("quality").alias("_quality")), "kpi", "left")
    gap = F.coalesce(F.col("value") - F.col("rivals"), F.col("value") - F.col("p50"), F.lit(0.0))
    label = F.col("kpi")
    for kpi, text in labels.items():
        label = F.when(F.col("kpi") == kpi, text).otherwise(label)
    g, n = F.col("gap"), F.col("with_data")
    said = lambda before, after: F.concat(F.lit(before), label, F.lit(after))
    none, behind, ahead = F.abs(g) < LEAST, g <= -LEAST, g >= LEAST
    finding = F.when(none, NO_GAP).when(ahead, said("品牌在「", "」上领先于竞品均值")).otherwise(said("品牌在「", "」上落后于竞品均值"))
    level = F.when(F.col("total_competitors") == 0, "none").when(n < 2, "few").when((n >= 5) & F.col("_quality").isin("high", "medium"), "many").otherwise("some")
    picked = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in CONFIDENCE.items() for x in (k, v[i])]), level)
    return joined.withColumn("gap", gap).select(
        *compared.columns, "p50", "gap", gap_significance(g).alias("significance"), finding.alias("finding"),
        F.array(F.when(behind, said("在「", "」方面可能存在改进空间")).otherwise(said("建议关注「", "」相关指标"))).alias("drivers"),
        F.when(ahead, F.array(said("在「", "」方面品牌表现较好"))).otherwise(F.array().cast("array<string>")).alias("counters"),
        picked(0).alias("confidence"), picked(1).alias("reason"), F.concat_ws("，", F.lit(CAVEATS[0]), F.when(F.abs(g) < SMALL, CAVEATS[1]), F.lit(CAVEATS[2])).alias("caveat"),
    )


def with_status(log: DataFrame) -> DataFrame:
    """A log of attributions (brand, kpi, id, generated_at) with status: the newest of a brand and KPI is active, all others stale, with stale_reason.

    Of results of one time the one with the greatest id is active.
    """
    newest = log.groupBy("brand", "kpi").agg(F.max(F.struct("generated_at", "id")).alias("_newest"))
    newest = newest.select(F.col("brand").alias("_brand"), F.col("kpi").alias("_kpi"), F.col("_newest.id").alias("_id"))
    joined = log.drop("status", "stale_reason").join(newest, F.col("brand").eqNullSafe(F.col("_brand")) & F.col("kpi").eqNullSafe(F.col("_kpi")), "left")
    active = F.col("id").eqNullSafe(F.col("_id"))
    return joined.withColumns({"status": F.when(active, "active").otherwise("stale"), "stale_reason": F.when(~active, "newer result available")}).drop("_brand", "_kpi", "_id")


def kpi_cards(results: DataFrame, names: dict[str, str] = LABELS) -> DataFrame:
    """One row a brand with cards, in the order of ``names``: key, name, value, numerator, denominator, sample_size, confidence.

    ``results`` is long: brand, kpi and these columns; of repeated rows the greatest stands. A KPI without a row has
    zeros and low confidence, a null value is 0. KPIs that ``names`` does not hold have no card.
    """
    zero = {"value": "double", "numerator": "bigint", "denominator": "bigint", "sample_size": "bigint"}
    row = F.struct(*[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in zero.items()], F.coalesce("confidence", F.lit("low")).alias("confidence"))
    known = results.where(F.col("kpi").isin(*names)).groupBy("brand", "kpi").agg(F.max(row).alias("r"))
    brands = known.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("kpi", "r"))).alias("_found")).join(results.select("brand").distinct(), "brand", "right")

    def card(key: str) -> Column:
        r = F.try_element_at("_found", F.lit(key))
        return F.struct(F.lit(key).alias("key"), F.lit(names[key]).alias("name"), *[F.coalesce(r[c], F.lit(0)).cast(t).alias(c) for c, t in zero.items()], F.coalesce(r["confidence"], F.lit("low")).alias("confidence"))

    return brands.select("brand", F.array(*[card(k) for k in names]).alias("cards"))
