"""Whether a collection run has enough answers: counts in four tiers, breakdowns by platform, question type and KPI, a status and its reasons.

Answers are combined once, into cells of (run, platform, question type, kind of error); everything else is made from the
cells, whose number depends on the configuration and not on the answers, so a run with a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error codes of answers that are not valid, KPIs whose denominators count, texts of reasons.
NOT_VALID = ("template_invalid", "empty_response", "content_filtered", "system_error")
KPIS = ("accuracy", "completeness", "citation", "sov", "first_rec")
SUMMARIES = {
    "ok": "样本充分度达标，诊断结果可信",
    "no_data": "采集失败, 需重新执行采集",
    "partial": "部分维度样本不足，报告可酌情发布。样本不足不等于品牌表现差",
}
TOO_LITTLE = ("样本不充分（", "），当前数据不足以支撑正式诊断。样本不足不等于品牌表现差")
ALL_FAILED = "采集完全失败, 检查平台 Key 和任务状态"

KINDS = "array<struct<kind:string,n:bigint>>"


@dataclass(frozen=True)
class Needs:
    """Least numbers of valid answers, and the names that must reach theirs."""

    total: int = 10
    platforms: int = 2
    per_platform: int = 3
    per_type: int = 2
    per_kpi: int = 5
    all_platforms: bool = False
    by_platform: Mapping[str, int] = field(default_factory=dict)
    by_type: Mapping[str, int] = field(default_factory=dict)
    by_kpi: Mapping[str, int] = field(default_factory=dict)
    critical_platforms: tuple[str, ...] = ()
    critical_types: tuple[str, ...] = ()
    critical_kpis: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("total", "per_platform", "per_type", "per_kpi"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.platforms < 1:
            raise ValueError("platforms must be at least 1")
        for name in ("by_platform", "by_type", "by_kpi"):
            if any(n < 0 for n in getattr(self, name).values()):
                raise ValueError(f"{name} must not hold negative numbers")


def question_types(answers: DataFrame, versions: DataFrame, templates: DataFrame) -> DataFrame:
    """``answers`` (version_id, template_id) with question_type: that of the version, else, where it is missing or "unknown", of the template, else "unknown".

    Versions and templates hold one row an id: (version_id, question_type), (template_id, question_type).
    """
    v = versions.select(F.col("version_id"), F.col("question_type").alias("_of_version"))
    t = templates.select(F.col("template_id"), F.col("question_type").alias("_of_template"))
    kind = F.coalesce(F.nullif("_of_version", F.lit("unknown")), "_of_template", F.lit("unknown"))
    joined = answers.drop("question_type").join(v, "version_id", "left").join(t, "template_id", "left")
    return joined.withColumn("question_type", kind).drop("_of_version", "_of_template")


def cells(answers: DataFrame) -> DataFrame:
    """Counts of each (run, platform, question_type, kind of error): raw, success, given (an answer not empty) and valid (not blank)."""
    success = F.col("status") == "success"
    fit = success & ~F.coalesce(F.col("error_code").isin(*NOT_VALID), F.lit(False))
    said = F.coalesce("error_message", F.lit("")) != ""
    kind = F.when(said & F.contains("error_message", F.lit("429")), "rate_limited").when(said, F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown")))
    return answers.groupBy("run", F.coalesce("platform", F.lit("unknown")).alias("platform"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"), kind.alias("kind")).agg(
        F.count("*").alias("raw"), F.count_if(success).alias("success"), F.count_if(fit & (F.length("answer") > 0)).alias("given"), F.count_if(fit & F.col("answer").rlike(r"\S")).alias("valid")
    )


def needed(name: Column, own: Mapping[str, int], otherwise: int) -> Column:
    found = F.lit(otherwise)
    for key, n in own.items():
        found = F.when(name == key, n).otherwise(found)
    return found.cast("bigint")


def among(name: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(name.isin(*names), F.lit(False)) if names else F.lit(False)


def by_platform(found: DataFrame, needs: Needs) -> DataFrame:
    """Per run and platform: counts, errors by kind, min_required, sufficient, critical and status.

    A platform is ok, insufficient or without a valid answer; one error of the limiter makes it rate_limited.
    """
    kinds = found.groupBy("run", "platform", "kind").agg(*[F.sum(c).alias(c) for c in ("raw", "success", "given")])
    p = kinds.groupBy("run", "platform").agg(
        *[F.sum(c).alias(c) for c in ("raw", "success", "given")],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", F.col("raw").alias("n"))))).cast(KINDS).alias("errors"),
    )
    p = p.withColumn("min_required", needed(F.col("platform"), needs.by_platform, needs.per_platform)).withColumn("sufficient", F.col("given") >= F.col("min_required"))
    limited = F.exists("errors", lambda e: (e.kind == "rate_limited") | F.contains(e.kind, F.lit("429")))
    status = F.when(limited, "rate_limited").when(F.col("sufficient"), "ok").when(F.col("given") == 0, "no_valid_answer").otherwise("insufficient")
    return p.withColumn("status", status).withColumn("critical", among(F.col("platform"), needs.critical_platforms))


def by_type(found: DataFrame, needs: Needs) -> DataFrame:
    """Per run and question type with a valid answer: valid, min_required, sufficient, critical."""
    t = found.groupBy("run", "question_type").agg(F.sum("valid").alias("valid")).where("valid > 0")
    t = t.withColumn("min_required", needed(F.col("question_type"), needs.by_type, needs.per_type))
    return t.withColumn("sufficient", F.col("valid") >= F.col("min_required")).withColumn("critical", among(F.col("question_type"), needs.critical_types))


def by_kpi(runs: DataFrame, denominators: DataFrame, needs: Needs) -> DataFrame:
    """Per run and each of KPIS: denominator (0 where none is given; the largest of repeated rows), min_required, sufficient, critical."""
    every = runs.select("run", F.explode(F.array(*[F.lit(k) for k in KPIS])).alias("kpi"))
    given = denominators.groupBy("run", "kpi").agg(F.max("denominator").alias("denominator"))
    k = every.join(given, ["run", "kpi"], "left").withColumn("denominator", F.coalesce("denominator", F.lit(0)).cast("bigint"))
    k = k.withColumn("min_required", needed(F.col("kpi"), needs.by_kpi, needs.per_kpi))
    return k.withColumn("sufficient", F.col("denominator") >= F.col("min_required")).withColumn("critical", among(F.col("kpi"), needs.critical_kpis))


def lacking(items: Column, code: str, prefix: str, name: str, actual: str) -> Column:
    """Blocks for the critical items that fall short."""
    return F.transform(F.filter(items, lambda i: i.critical & ~i.sufficient), lambda i: block(code, F.concat(F.lit(prefix), i[name]), i[actual], i.min_required))


def block(code: str, dimension: Column, actual: Column, required: Column) -> Column:
    message = F.concat(dimension, F.lit(" 样本不足: 实际"), actual.cast("string"), F.lit(", 要求"), required.cast("string"))
    return F.struct(F.lit(code).alias("code"), dimension.alias("dimension"), actual.cast("bigint").alias("actual"), required.cast("bigint").alias("required"), message.alias("message"))


def assess(runs: DataFrame, answers: DataFrame, denominators: DataFrame, needs: Needs = Needs()) -> DataFrame:  # noqa: B008  (frozen)
    """One row for each run of ``runs``: counts, breakdowns, data_status, blocks, warnings, actions, summary.

    ``answers``: run, platform, question_type, status, error_code, error_message, answer. ``denominators``: run, kpi,
    denominator. Runs without answers have no data. Null platforms and types are "unknown"; answers and denominators of
    runs that ``runs`` does not name, null ones among them, are left out. An answer of white space counts for its
    platform, but is neither valid nor eligible. Breakdowns and blocks are ordered by name. A critical platform
    without any answer makes a run insufficient without a block of its own, as it has no counts to show.
    """
    runs = runs.select("run").distinct()
    found = cells(answers)
    n = found.groupBy("run").agg(F.sum("raw").alias("n_raw"), F.sum("success").alias("n_success"), F.sum("valid").alias("n_valid"))
    listed = lambda rows, name, *columns: rows.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    platforms = listed(by_platform(found, needs), "platforms", "platform", "raw", "success", "given", "errors", "min_required", "sufficient", "status", "critical")
    types = listed(by_type(found, needs), "types", "question_type", "valid", "min_required", "sufficient", "critical")
    kpis = listed(by_kpi(runs, denominators, needs), "kpis", "kpi", "denominator", "min_required", "sufficient", "critical")
    rows = runs.join(n, "run", "left").join(platforms, "run", "left").join(types, "run", "left").join(kpis, "run", "left")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("platforms", "types")}
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_raw", "n_success", "n_valid")} | empty).withColumn("n_eligible", F.col("n_valid"))
    rows = rows.withColumns({"n_platforms": F.size("platforms"), "n_ok_platforms": F.size(F.filter("platforms", lambda p: p.status == "ok"))})

    failed = lambda items: F.exists(items, lambda i: i.critical & ~i.sufficient)
    absent = F.lit(False)
    for name in needs.critical_platforms:
        absent |= ~F.array_contains(F.col("platforms.platform"), name)
    some = F.exists("platforms", lambda p: ~p.sufficient) | F.exists("types", lambda t: ~t.sufficient)
    short = (F.col("n_valid") < needs.total) | (F.col("n_ok_platforms") < needs.platforms) | failed("platforms") | failed("types") | failed("kpis") | absent
    if needs.all_platforms:
        short |= F.col("n_ok_platforms") < F.col("n_platforms")
    nothing = F.col("n_valid") == 0
    rows = rows.withColumn("data_status", F.when(nothing, "no_data").when(short, "insufficient").when(some, "partial").otherwise("ok"))

    few = ~nothing & (F.col("n_valid") < needs.total)
    blocks = F.concat(
        F.when(few, F.array(block("SAMPLE_TOTAL_TOO_LOW", F.lit("total"), F.col("n_valid"), F.lit(needs.total)))).otherwise(F.array()),
        lacking(F.col("platforms"), "SAMPLE_CRITICAL_PLATFORM_MISSING", "platform:", "platform", "given"),
        lacking(F.col("types"), "SAMPLE_QTYPE_TOO_LOW", "qtype:", "question_type", "valid"),
        lacking(F.col("kpis"), "SAMPLE_KPI_TOO_LOW", "kpi:", "kpi", "denominator"),
    )
    none = F.struct(F.lit("NO_DATA").alias("code"), F.lit("all").alias("dimension"), F.lit(None).cast("bigint").alias("actual"), F.lit(None).cast("bigint").alias("required"), F.lit("无成功 QueryResult").alias("message"))
    action = lambda reason: F.array(F.struct(F.lit("collect_more").alias("action_type"), reason.alias("reason"), F.lit("high").alias("priority")))
    too_few = F.concat(F.lit("总有效样本不足, 实际"), F.col("n_valid").cast("string"), F.lit(f", 要求{needs.total}"))
    rows = rows.withColumns({
        "blocks": F.when(nothing, F.array(none)).otherwise(blocks),
        "warnings": F.when(F.col("data_status") == "partial", F.array(F.lit("SAMPLE_PARTIAL_PLATFORM"))).otherwise(F.array().cast("array<string>")),
        "actions": F.when(nothing, action(F.lit(ALL_FAILED))).when(few, action(too_few)).otherwise(F.array()),
    })
    summary = F.concat(F.lit(TOO_LITTLE[0]), F.array_join(F.transform("blocks", lambda b: b.dimension), ", "), F.lit(TOO_LITTLE[1]))
    for status, text in SUMMARIES.items():
        summary = F.when(F.col("data_status") == status, text).otherwise(summary)
    return rows.withColumn("summary", summary)
