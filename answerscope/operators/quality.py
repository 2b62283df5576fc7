"""Checks of report texts, question templates and collecting platforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that promise too much, terms that a summary for executives must not hold, and sections by edition.
ABSOLUTE_TERMS = ("一定", "必然", "肯定", "保证", "所有用户都会", "永远", "绝对", "毫无疑问", "100%")
TECHNICAL_TERMS = (
    "SOV", "Share of Voice", "hallucination", "semantic anchor", "semantic stability", "citation rate", "scenario recall", "first recommendation rate", "accuracy rate",
    "completeness rate", "cross-platform consistency", "differentiation", "recommendation quality", "GT", "Ground Truth", "KPI", "LLM",
)
SECTIONS = {
    "executive": ("一句话结论", "关键数字", "最大风险", "建议行动"),
    "implementation": ("当前状态", "优先级行动清单", "审核要求", "复测验证计划"),
    "customer": ("品牌 AI 认知仪表盘", "AI 对品牌的主要误解", "数据质量说明", "优化建议", "附录：方法论"),
}
ASSETS, EXPLAINED = "内容资产", "得分:"

# Question types with the KPIs that they suit, allow and exclude; levels, scopes and variables of templates.
QUESTION_KPIS = {
    "brand_definition": (("information_accuracy", "completeness_rate"), ("citation_rate", "brand_mention_rate"), ("sov", "first_rec_rate")),
    "brand_attribute": (("information_accuracy", "completeness_rate"), ("citation_rate", "hallucination_rate"), ("sov", "first_rec_rate")),
    "brand_comparison": (("sov", "competitor_accuracy"), ("information_accuracy", "first_rec_rate"), ("completeness_rate",)),
    "brand_trust": (("citation_rate", "trust_risk_rate"), ("information_accuracy", "hallucination_rate"), ("sov",)),
    "category_recommendation": (("sov", "first_rec_rate"), ("brand_mention_rate",), ("information_accuracy", "completeness_rate")),
    "scenario_solution": (("scenario_coverage",), ("sov", "brand_mention_rate"), ("information_accuracy", "completeness_rate")),
    "user_recommendation": (("sov", "brand_mention_rate"), ("first_rec_rate",), ("information_accuracy", "completeness_rate")),
    "generic_advice": ((), ("brand_mention_rate",), ("information_accuracy", "completeness_rate", "sov", "citation_rate")),
}
LEVELS = ("critical", "important", "optional")
SCOPES = ("brand_directed", "brand_adjacent", "category_directed", "scenario_directed", "generic")
DIRECTED = (0.0, 0.25, 0.5, 0.75, 1.0)
VARIABLES = {
    "品牌": "official_name", "行业": "industry", "品类": "category", "竞品": "target_competitors", "场景": "core_scenarios", "目标用户": "target_users",
    "产品": "core_products", "功能": "core_features", "定位": "positioning", "域名": "official_domains",
}
LONGEST_TEMPLATE = 2000


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def count_of(text: Column, mark: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def outside_code(text: Column, term: Column) -> Column:
    """Whether the first occurrence of a term is neither in a fenced code block nor in a URL."""
    at = F.instr(text, term)
    before, after = F.substr(text, F.lit(1), at - 1), F.substr(text, at)
    fenced = (count_of(before, "```") % 2 == 1) & F.contains(after, F.lit("```"))
    return (at > 0) & ~fenced & ~before.rlike(r"https?://\S*$")


def check_reports(reports: DataFrame, absolute: Sequence[str] = ABSOLUTE_TERMS, technical: Sequence[str] = TECHNICAL_TERMS, sections: Mapping[str, Sequence[str]] = SECTIONS) -> DataFrame:
    """``reports`` (text, edition) with violations ("check:what"), report_score and report_status.

    100 points, less 5 for each absolute term, 10 for open placeholders, 10 for each section that the edition needs,
    5 for each technical term outside code and URLs (executive), 15 without an action table (implementation),
    10 with fewer than three explained figures (customer). 80 passes, 60 warns. A null text is an empty one.
    """
    text, edition = F.coalesce("text", F.lit("")), F.col("edition")
    named = lambda check, words: F.transform(words, lambda w: F.concat(F.lit(f"{check}:"), w))
    one = lambda check, cond: F.when(cond, F.array(F.lit(check))).otherwise(strings([]))
    missing = F.lit(None).cast("array<string>")
    for name, wanted in sections.items():
        missing = F.when(edition == name, F.filter(strings(wanted), lambda s: ~F.contains(text, s))).otherwise(missing)
    found = {
        "forbidden_absolute_terms": (5, named("forbidden_absolute_terms", F.filter(strings(absolute), lambda w: F.contains(text, w)))),
        "empty_placeholder": (10, one("empty_placeholder", F.contains(text, F.lit("{{")) | F.contains(text, F.lit("}}")))),
        "missing_section": (10, named("missing_section", F.coalesce(missing, strings([])))),
        "technical_term_in_executive": (5, F.when(edition == "executive", named("technical_term_in_executive", F.filter(strings(technical), lambda w: outside_code(text, w)))).otherwise(strings([]))),
        "missing_action_table": (15, one("missing_action_table", (edition == "implementation") & ~(F.contains(text, F.lit("|")) & F.contains(text, F.lit(ASSETS))))),
        "few_kpi_explanations": (10, one("few_kpi_explanations", (edition == "customer") & (count_of(text, EXPLAINED) < 3))),
    }
    out = reports.select("*", *[c.alias(f"_{name}") for name, (_, c) in found.items()])
    score = F.lit(100)
    for name, (points, _) in found.items():
        score = score - points * F.size(f"_{name}")
    out = out.select(*reports.columns, F.concat(*[F.col(f"_{name}") for name in found]).alias("violations"), score.alias("report_score"))
    return out.withColumn("report_status", F.when(F.col("report_score") >= 80, "passed").when(F.col("report_score") >= 60, "warning").otherwise("failed"))


def check_templates(templates: DataFrame) -> DataFrame:
    """``templates`` with errors and warnings (codes, one for each offence), valid, variables and required_fields.

    Input: template_text, question_type, template_level, question_scope, brand_directed, metric_eligibility (array),
    applicable and excluded (arrays). An empty text is the only error of its template.
    """
    text, kind = F.coalesce("template_text", F.lit("")), F.col("question_type")
    variables = F.regexp_extract_all(text, F.lit(r"\{([^{}]+)\}"), F.lit(1))
    fields = F.create_map(*[F.lit(x) for kv in VARIABLES.items() for x in kv])
    kpis = F.coalesce("metric_eligibility", strings([]))
    part = lambda i: F.coalesce(F.element_at(F.create_map(*[x for k, v in QUESTION_KPIS.items() for x in (F.lit(k), strings(v[i]))]), kind), strings([]))
    suits, allows, excludes = part(0), part(1), part(2)
    code = lambda name, cond: F.when(cond, F.array(F.lit(name))).otherwise(strings([]))
    each = lambda name, values: F.transform(values, lambda v: F.lit(name))
    scope = F.coalesce("question_scope", F.lit(""))
    errors = F.concat(
        code("TEMPLATE_TOO_LONG", F.length(text) > LONGEST_TEMPLATE),
        code("INVALID_QTYPE", ~F.coalesce(kind.isin(*QUESTION_KPIS), F.lit(False))),
        code("INVALID_LEVEL", ~F.coalesce(F.col("template_level").isin(*LEVELS), F.lit(False))),
        code("INVALID_BRAND_DIRECTED", ~F.coalesce(F.col("brand_directed").isin(*DIRECTED), F.lit(False))),
        each("UNKNOWN_VARIABLE", F.filter(variables, lambda v: ~F.map_contains_key(fields, v))),
        each("KPI_QTYPE_MISMATCH", F.filter(kpis, lambda k: F.array_contains(excludes, k))),
        code("INDUSTRY_CONFLICT", F.coalesce(F.arrays_overlap("applicable", "excluded"), F.lit(False))),
    )
    warnings = F.concat(
        code("INVALID_SCOPE", (scope != "") & ~scope.isin(*SCOPES)),
        code("CRITICAL_NO_BRAND_VAR", (F.col("template_level") == "critical") & ~F.array_contains(variables, "品牌")),
        code("SCOPE_DIRECTED_MISMATCH", (scope == "brand_directed") & (F.col("brand_directed") < 0.5)),
        each("KPI_NOT_RECOMMENDED", F.filter(kpis, lambda k: ~F.array_contains(F.concat(excludes, suits, allows), k))),
    )
    empty = F.trim(F.translate(text, "\t\r\n", "   ")) == ""
    needed = F.sort_array(F.array_distinct(F.array_compact(F.transform(variables, lambda v: F.element_at(fields, v)))))
    out = templates.select("*", F.when(empty, F.array(F.lit("EMPTY_TEMPLATE"))).otherwise(errors).alias("errors"), F.when(empty, strings([])).otherwise(warnings).alias("warnings"))
    return out.select("*", (F.size("errors") == 0).alias("valid"), F.when(empty, strings([])).otherwise(variables).alias("variables"), F.when(empty, strings([])).otherwise(needed).alias("required_fields"))


def platform_health(results: DataFrame, platforms: DataFrame, now: Column) -> DataFrame:
    """One row for each of ``platforms`` (platform, enabled, disabled_reason): success rate, latency and limits of the hour before ``now``, and the last success and error ever.

    ``results``: platform, status, latency_ms, error_code, collected_at. One aggregate; the configuration is small.
    """
    recent = F.col("collected_at") >= now - F.expr("interval 1 hour")
    ok, bad = F.col("status") == "success", F.col("status") == "error"
    seen = results.groupBy("platform").agg(
        F.count_if(recent).alias("total"), F.count_if(recent & ok).alias("success"), F.count_if(recent & (F.col("error_code") == "platform_rate_limited")).alias("limited"),
        F.round(F.avg(F.when(recent, F.col("latency_ms")))).cast("long").alias("latency"), F.max(F.when(ok, F.col("collected_at"))).alias("last_success_at"),
        F.max(F.when(bad, F.col("collected_at"))).alias("last_error_at"), F.max_by("error_code", F.when(bad, F.col("collected_at"))).alias("last_error_code"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    joined = platforms.join(seen, "platform", "left")
    total, success, limited = n("total"), n("success"), n("limited")
    status = F.when(~F.col("enabled"), "disabled").when((total > 0) & (limited > 5), "rate_limited").when((total > 0) & ((total - success) / total > 0.3), "degraded").otherwise("healthy")
    rate = F.when(total > 0, F.round(success / total * 100, 1)).otherwise(100.0)
    reason = F.when(~F.col("enabled"), F.coalesce("disabled_reason", F.lit("未启用"))).otherwise("")
    return joined.select("platform", status.alias("status"), reason.alias("disabled_reason"), rate.alias("success_rate_1h"), total.alias("total_1h"), limited.alias("limited_1h"), n("latency").alias("avg_latency_ms"), "last_success_at", "last_error_at", "last_error_code")
