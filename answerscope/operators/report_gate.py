"""The quality summary of a run's claims, and the gate that says whether its report may go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Core KPIs of the gate, its limits, levels of evidence, claim types.
CORE_KPIS = ("information_accuracy", "completeness_rate", "citation_rate")
LIMITS = {"max_speculation_ratio": 0.30, "speculation_block_threshold": 0.50, "max_opinion_ratio": 0.60, "max_unknown_ratio": 0.20}
LEAST_COVERAGE, LEAST_PLATFORM, MOST_UNSUPPORTED, MOST_WEAK, MOST_CRITICAL = 0.60, 0.50, 100, 0.60, 2
STRENGTHS = ("strong", "moderate", "weak", "disputed", "insufficient_evidence")
CLAIM_TYPES = ("fact", "opinion", "speculation", "unknown")


def quality_summary(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each run of ``runs``: counts of its claims by verdict, severity, nature and evidence, and the fields in conflict.

    ``claims``: run, verdict, severity, subject_type, claim_type, strength, conflict, field. Contradictions count only for
    the target brand; their claim types other than CLAIM_TYPES, null among them, are unknown, a null severity is "Info".
    Runs without claims have zeros and empty lists. Claims are first combined by run, nature and severity.
    """
    verdict, severity = F.col("verdict"), F.coalesce("severity", F.lit("Info"))
    wrong = F.coalesce((verdict == "contradicted") & (F.col("subject_type") == "target_brand"), F.lit(False))
    nature = F.when(wrong, F.when(F.col("claim_type").isin(*CLAIM_TYPES), F.col("claim_type")).otherwise("unknown"))
    counts = {
        "n_p0": wrong & (severity == "P0"), "n_p1": wrong & (severity == "P1"), "n_p2": wrong & (severity == "P2"), "n_confirmed": wrong,
        "n_generic": verdict == "generic_statement", "n_irrelevant": verdict == "not_about_brand", "n_unsupported": verdict.isin("unsupported", "gt_insufficient"), "n_template_invalid": verdict == "template_invalid",
    } | {f"n_{t}": nature == t for t in CLAIM_TYPES} | {f"n_{s}": F.col("strength") == s for s in STRENGTHS}
    named = F.coalesce("field", F.lit("")) != ""
    fields = lambda *levels: F.collect_set(F.when(named & F.col("conflict").isin(*levels), F.col("field")))
    parts = claims.groupBy("run", nature.alias("_nature"), F.when(wrong, severity).alias("_severity")).agg(
        *[F.count_if(hit).alias(name) for name, hit in counts.items()], fields("strong_conflict", "critical_conflict").alias("conflicts"), fields("critical_conflict").alias("critical")
    )
    whole = parts.groupBy("run").agg(
        *[F.sum(name).alias(name) for name in counts], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("conflicts", "critical")],
        F.sort_array(F.collect_list(F.when(F.col("_nature").isNotNull(), F.struct(F.col("_nature").alias("claim_type"), F.col("_severity").alias("severity"), F.col("n_confirmed").alias("n"))))).alias("breakdown"),
    )
    rows = runs.select("run").distinct().join(whole, "run", "left")
    zeros = {name: F.coalesce(name, F.lit(0)).cast("bigint") for name in counts}
    return rows.withColumns(zeros | {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("conflicts", "critical", "breakdown")}).withColumn("n_classified", sum((F.col(f"n_{t}") for t in CLAIM_TYPES), F.lit(0)))


def publishable(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """``runs`` with blocks, warnings (codes in the order of the checks) and publishable (no block).

    ``runs``: run, templates (struct of critical_invalid, can_collect, optional_skipped), coverage (double),
    platform_coverage (map to double), denominators (map of KPI to bigint), limits (map of LIMITS' names to double).
    Null templates, coverage or denominators, or an empty map of these, are missing data and block; null entries of a
    struct or map count as absent. A run without a row in ``summaries`` lacks its summary and blocks.
    """
    joined = runs.join(summaries, "run", "left")
    c, has = F.col, F.col("n_classified").isNotNull()
    limit = lambda name: F.coalesce(F.try_element_at("limits", F.lit(name)), F.lit(LIMITS[name]))
    share = lambda t: F.when(c("n_classified") > 0, c(f"n_{t}") / c("n_classified"))
    denominators = F.coalesce(F.size("denominators"), F.lit(0)) > 0
    zero = sum_or(F.coalesce(F.try_element_at("denominators", F.lit(k)), F.lit(1)) == 0 for k in CORE_KPIS)
    low = F.coalesce(F.exists(F.map_values("platform_coverage"), lambda v: F.coalesce(v < LEAST_PLATFORM, F.lit(False))), F.lit(False))
    weak = c("n_weak") + c("n_insufficient_evidence")
    rated = c("n_strong") + c("n_moderate") + weak
    excessive = share("speculation") > limit("speculation_block_threshold")
    blocks = [
        F.when(~has, "QUALITY_SCHEMA_MISSING"),
        F.when(c("templates").isNull(), "TEMPLATE_HEALTH_MISSING").when(c("templates.critical_invalid") > 0, "CRITICAL_TEMPLATE_INVALID").when(~c("templates.can_collect"), "CANNOT_COLLECT"),
        F.when(c("coverage").isNull(), "COVERAGE_DATA_MISSING").when(c("coverage") < LEAST_COVERAGE, "METRIC_COVERAGE_LOW"),
        F.when(~denominators, "METRIC_DATA_MISSING").when(zero, "CORE_KPI_ZERO_DENOMINATOR"),
        F.when(excessive, "EXCESSIVE_SPECULATION"),
        F.when(F.size("critical") > 0, "CRITICAL_EVIDENCE_CONFLICT"),
    ]
    warnings = [
        F.when(c("templates.optional_skipped") > 0, "OPTIONAL_SKIPPED"),
        F.when(low, "PLATFORM_LOW_COVERAGE"),
        F.when(c("n_unsupported") > MOST_UNSUPPORTED, "HIGH_GT_UNSUPPORTED"),
        F.when(~excessive & (share("speculation") > limit("max_speculation_ratio")), "HIGH_SPECULATION_RATIO"),
        F.when(share("opinion") > limit("max_opinion_ratio"), "HIGH_OPINION_RATIO"),
        F.when(share("unknown") > limit("max_unknown_ratio"), "HIGH_UNKNOWN_RATIO"),
        F.when((F.size("critical") <= 0) & (F.size("conflicts") > 0), "EVIDENCE_STRONG_CONFLICT"),
        F.when((rated > 0) & (weak / F.nullif(rated, F.lit(0)) > MOST_WEAK), "WEAK_EVIDENCE_DOMINANCE"),
        F.when((c("n_insufficient_evidence") > 0) & (F.size("critical") > MOST_CRITICAL), "INSUFFICIENT_EVIDENCE_FIELDS"),
    ]
    found = joined.withColumns({"blocks": F.array_compact(F.array(*blocks)), "warnings": F.array_compact(F.array(*warnings))})
    return found.select(*[runs[x] for x in runs.columns], "blocks", "warnings", (F.size("blocks") == 0).alias("publishable"))


def sum_or(conditions) -> Column:
    found = F.lit(False)
    for hit in conditions:
        found |= hit
    return found
