"""KPIs of assistant answers about a brand.

``answers`` has a row per answer: the grouping columns, ``platform``,
``question``, ``question_type``, ``status`` and ``answer_text``. All counting
KPIs come from one aggregate over the eligible answers; confidence ladders and
zero guards are columns of its result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import text as T

# Words that mark a differentiating or a substantiated answer.
DIFFERENTIATORS = ("独特", "唯一", "专有", "专利", "特色", "差异化", "不同于", "区别", "优势", "独创")
QUALITY_MARKERS = ("因为", "所以", "相比", "根据", "数据", "%", "年", "案例", "例如", "具体")

# Sample sizes of the high and medium confidence of each KPI.
CONFIDENCE = {
    "sov": (20, 10), "first_rec_rate": (15, 8), "accuracy_rate": (15, 8), "completeness_rate": (15, 8), "citation_rate": (15, 8),
    "scenario_recall": (8, 3), "differentiation": (10, 5), "cross_platform_consistency": (12, 6), "recommendation_quality": (10, 5),
}

# Levels of the fields of a fact record; all but forbidden_claims count for completeness.
FIELD_LEVELS = {
    "official_name": "P0", "aliases": "P0", "industry": "P0", "category": "P0", "positioning": "P0", "official_domains": "P0", "target_competitors": "P0", "core_products": "P0",
    "target_users": "P1", "core_scenarios": "P1", "key_differentiators": "P1", "source_of_truth_by_field": "P1", "forbidden_claims": "P1", "core_features": "P1",
    "scenario_keywords": "P2", "subcategory": "P2", "best_fit_users": "P2", "alternative_solutions": "P2", "common_misconceptions": "P2", "official_docs": "P2", "official_channels": "P2", "preferred_recommendation_reasons": "P2",
}


@dataclass
class Brand:
    """What answers are matched against."""

    name: str
    aliases: Sequence[str] = ()
    domains: Sequence[str] = ()
    differentiators: Sequence[str] = DIFFERENTIATORS
    quality_markers: Sequence[str] = QUALITY_MARKERS
    # fixed values: patterns of a recommendation in running text
    recommendations: Sequence[str] = (r"(?:首选|最推荐|优先考虑|强烈推荐|最值得|第一名)[^。\n]{0,20}({brand})", r"({brand})[^。\n]{0,10}(?:最好|最佳|最合适|首选|推荐)")
    variants: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.variants = list(dict.fromkeys([self.name, *self.aliases]))


def eligible(answers: DataFrame, mapping: DataFrame, kpi: str) -> DataFrame:
    """Successful answers with a text whose question type the KPI allows; ``mapping`` (kpi, question_type, mode) is configuration."""
    allowed = mapping.where((F.col("kpi") == kpi) & F.col("mode").isin("allowed", "conditional")).select("question_type").distinct()
    return answers.where("status = 'success' and answer_text <> ''").join(F.broadcast(allowed), "question_type", "left_semi")


def confidence(kpi: str, n: Column) -> Column:
    high, medium = CONFIDENCE[kpi]
    return T.ladder(n, [(high, "high"), (medium, "medium")], "low")


def rate(hits: Column, n: Column, digits: int = 4) -> Column:
    return F.when(n > 0, F.round(hits / n, digits)).otherwise(0.0)


def is_mentioned(brand: Brand, text: Column | None = None) -> Column:
    return T.mentions(F.col("answer_text") if text is None else text, F.array(*[F.lit(a) for a in brand.variants]))


def is_first(brand: Brand) -> Column:
    """The first list item holds the name, or a recommendation pattern does."""
    text, item = F.col("answer_text"), T.first_list_item(F.col("answer_text"))
    said = F.lit(False)
    for pattern in brand.recommendations:
        said = said | text.rlike(pattern.replace("{brand}", f"\\Q{brand.name}\\E"))
    return F.coalesce(F.contains(item, F.lit(brand.name)), F.lit(False)) | said


def cites_domain(brand: Brand) -> Column:
    if not brand.domains:
        return F.lit(False)
    names = F.array(*[F.lit(n.lower()) for n in brand.domains])
    return F.exists(T.urls(F.col("answer_text")), lambda u: F.exists(names, lambda n: F.contains(F.lower(u), n)))


def counting(answers: DataFrame, brand: Brand, by: Sequence[str]) -> DataFrame:
    """SOV, first recommendation, citation, scenario recall, differentiation and recommendation quality in one pass."""
    text = F.col("answer_text")
    # each flag is a column of its own, so that a text is searched once for all KPIs that ask
    flags = {
        "_valid": (F.col("status") == "success") & (text != ""),
        "_said": is_mentioned(brand),
        "_plain": ~is_mentioned(brand, F.coalesce("question", F.lit(""))),
        "_first": is_first(brand),
        "_cited": cites_domain(brand),
        "_differs": T.any_contains(text, brand.differentiators),
        "_founded": T.count_contains(text, brand.quality_markers) >= 2,
    }
    flagged = answers.select(*by, *[c.alias(name) for name, c in flags.items()])
    valid, said, plain = F.col("_valid"), F.col("_said"), F.col("_plain")
    n = F.count_if(valid)
    mentioned, scenarios = F.count_if(valid & said), F.count_if(valid & plain)
    parts = {
        "sov": (mentioned, n),
        "first_rec_rate": (F.count_if(valid & F.col("_first")), n),
        "citation_rate": (F.count_if(valid & said & F.col("_cited")), mentioned),
        "scenario_recall": (F.count_if(valid & plain & said), scenarios),
        "differentiation": (F.count_if(valid & F.col("_differs")), n),
        "recommendation_quality": (F.count_if(valid & F.col("_founded")), n),
    }
    columns = [F.count("*").alias("attempted"), n.alias("n_valid"), mentioned.alias("n_mentioned"), F.round((F.count("*") - n) / F.count("*"), 4).alias("failure_rate")]
    for kpi, (hits, of) in parts.items():
        columns += [rate(hits, of).alias(kpi), confidence(kpi, of).alias(f"{kpi}_confidence")]
    return flagged.groupBy(*by).agg(*columns)


def stability(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean pairwise Jaccard of the platforms' token sets; 1 with fewer than two platforms.

    Pairs of platforms are counted over shared tokens, so that no token set is collected.
    """
    tokens = answers.select(*by, "platform", F.explode(T.space_tokens(F.col("answer_text"))).alias("token")).distinct()
    sizes = tokens.groupBy(*by, "platform").agg(F.count("*").alias("n"))
    a = tokens.withColumnRenamed("platform", "a")
    b = tokens.withColumnRenamed("platform", "b")
    both = a.join(b, [*by, "token"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("both"))
    sized = both.join(sizes.withColumnsRenamed({"platform": "a", "n": "n_a"}), [*by, "a"]).join(sizes.withColumnsRenamed({"platform": "b", "n": "n_b"}), [*by, "b"])
    found = sized.groupBy(*by).agg(F.sum(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("total"))
    k = sizes.groupBy(*by).agg(F.count("*").alias("k")).withColumn("pairs", (F.col("k") * (F.col("k") - 1) / 2).cast("long"))
    value = F.when(F.col("pairs") > 0, F.round(F.coalesce("total", F.lit(0.0)) / F.col("pairs"), 4)).otherwise(1.0)
    return k.join(found, list(by), "left").select(*by, value.alias("semantic_stability"), "pairs", F.when(F.col("pairs") >= 3, "high").otherwise("medium").alias("confidence"))


def consistency(answers: DataFrame, brand: Brand, by: Sequence[str]) -> DataFrame:
    """One minus the variance of the platforms' mention rates (name only, case matters)."""
    said = F.contains("answer_text", F.lit(brand.name)).cast("double")
    each = answers.where("answer_text <> ''").groupBy(*by, "platform").agg(F.avg(said).alias("rate"), F.count("*").alias("n"))
    value = F.round(1 - F.least(F.var_pop("rate"), F.lit(1.0)), 4)
    n = F.sum("n")
    return each.groupBy(*by).agg(value.alias("cross_platform_consistency"), n.alias("n"), confidence("cross_platform_consistency", n).alias("confidence"))


def field_verdict(value: Column, items: Column, text: Column) -> Column:
    """correct, partial or not_mentioned for a scalar ``value``, or a list of ``items`` where these are given."""
    low = F.lower(text)
    covered = F.size(F.filter(items, lambda i: F.contains(low, F.lower(i))))
    fuzzy = F.size(F.filter(items, lambda i: F.arrays_overlap(T.ngram_tokens(i), T.ngram_tokens(text))))
    share = F.when(covered > 0, covered).otherwise(fuzzy) / F.size(items)
    listed = F.when(share >= 0.8, "correct").when(share > 0, "partial").otherwise("not_mentioned")
    scalar = F.when(F.contains(low, F.lower(value)), "correct").when(T.overlap(T.ngram_tokens(value), T.ngram_tokens(text)) >= 0.2, "partial").otherwise("not_mentioned")
    empty = F.coalesce(value, F.lit("")) == ""
    return F.when(F.size(items) > 0, listed).when(empty, "not_mentioned").otherwise(scalar)


def accuracy(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """From facts (field, verdict): correct over mentioned, and correct over the fields that completeness requires."""
    required = F.col("field") != "forbidden_claims"
    correct, mentioned = F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") != "not_mentioned")
    done, n = F.count_if(required & (F.col("verdict") == "correct")), F.count_if(required)
    return facts.groupBy(*by).agg(correct.alias("n_correct"), mentioned.alias("n_mentioned"), rate(correct, mentioned).alias("accuracy_rate"), rate(done, n).alias("completeness_rate"))


# Weights of the health score.
HEALTH_WEIGHTS = {
    "accuracy_rate": 0.25, "citation_rate": 0.20, "sov": 0.15, "completeness_rate": 0.10, "first_rec_rate": 0.10,
    "scenario_recall": 0.05, "differentiation": 0.05, "cross_platform_consistency": 0.05, "recommendation_quality": 0.05, "semantic_stability": 0.05,
}


def health(kpis: DataFrame, weights: Mapping[str, float] = HEALTH_WEIGHTS) -> DataFrame:
    """``kpis`` (a column per KPI, n_p0, sample_size) with score, grade and confidence; weights renormalise over the KPIs that are there."""
    there = {k: w for k, w in weights.items() if k in kpis.columns}
    total = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in there.items()), F.lit(0.0))
    parts = sum((F.when(F.col(k).isNotNull(), F.round(F.col(k) * w / F.col("_weight") * 100, 1)).otherwise(0.0) for k, w in there.items()), F.lit(0.0))
    missing = sum((F.col(k).isNull().cast("int") for k in there), F.lit(len(weights) - len(there)))
    penalty = F.least(F.col("n_p0") * 5, F.lit(15)) + (F.when(F.col("citation_rate") < 0.20, 5).otherwise(0) if "citation_rate" in there else F.lit(0))
    scored = kpis.withColumn("_weight", total).withColumn("_points", F.round(T.clamp(parts - penalty, 0.0, 100.0), 1))
    grade = T.ladder(F.col("_points"), [(80, "healthy"), (60, "watch"), (40, "act")], "risk")
    sure = F.when((missing > 5) | (F.col("sample_size") < 30), "low").when(missing > 2, "medium").otherwise("high")
    return scored.withColumn("grade", grade).withColumn("confidence", sure).withColumn("score", F.bround("_points").cast("long")).drop("_weight", "_points")
