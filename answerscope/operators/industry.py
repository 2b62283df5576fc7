"""Industry of a brand by weighted signals.

Signal words come as a parameter (industry -> kind of signal -> words), for
example from a YAML table of any size; weights, caps and ladders are fixed. The
term engine finds all words of all industries in one pass over each text, so
nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators import terms

# Points of a hit and the most a signal can add, in thousandths; labels of the signals.
POINTS = {"brand_name": (100, 100), "product": (50, 250), "scenario": (40, 150), "competitor": (50, 100), "gt_field": (30, 100), "business_model": (10, 20)}
LABELS = {"brand_name": "品牌名称", "product": "产品关键词", "scenario": "场景关键词", "competitor": "竞品信号", "gt_field": "GT字段", "business_model": "业务模式"}
TAGS = (
    "subscription", "offline_chain", "online_platform", "marketplace", "hardware", "software", "developer_tool", "service_network", "retail", "franchise", "direct_to_consumer",
    "regulated_service", "licensed_institution", "b2b", "consumer_brand",
)
TOO_WEAK = "所有行业得分均过低，无法确定品牌所属行业。建议补充官网、产品或目标用户信息。"

Signals = Mapping[str, Mapping[str, Sequence[str]]]


def with_terms(brands: DataFrame, signals: Signals) -> DataFrame:
    """``brands`` with, by kind of text, the signal words found in it: one pass of the term engine over each text."""
    fields = F.coalesce(F.col("gt_fields"), F.array().cast("array<string>"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    product = F.concat_ws(" ", text("products"), text("official_site"), F.array_join(fields, " "))
    where = {"brand_name": text("brand_name"), "product": product, "scenario": text("scenarios"), "competitor": text("competitors"), "business_model": product}
    out = brands.withColumns({f"_in_{kind}": c for kind, c in where.items()})
    for kind in where:
        words = {slug: tuple(own.get(kind, ())) for slug, own in signals.items()}
        out = terms.with_hits(out, f"_in_{kind}", terms.table_of(brands.sparkSession, words), f"_{kind}")
    return out


def n_terms(hits: Column, group: str) -> Column:
    """How many different terms of a group are hit."""
    return F.size(F.array_distinct(F.transform(F.filter(hits, lambda h: h["group"] == group), lambda h: h["term"])))


def scored(signals: Signals) -> Column:
    """Array of (order, position, slug, signals) of the industries, the best first; equal scores keep the given order."""
    fields = F.coalesce(F.col("gt_fields"), F.array().cast("array<string>"))
    rows = []
    for position, (slug, words) in enumerate(signals.items()):
        each = []
        for kind, (points, most) in POINTS.items():
            if kind == "gt_field":
                n = F.size(F.filter(F.array(*[F.lit(w) for w in words.get(kind, ())]).cast("array<string>"), lambda w: F.array_contains(fields, w)))
            else:
                n = n_terms(F.col(f"_{kind}"), slug)
            each.append(F.struct(F.lit(kind).alias("signal"), F.least(n * points, F.lit(most)).alias("points")))
        kept = F.filter(F.array(*each), lambda s: s["points"] > 0)
        total = F.aggregate(kept, F.lit(0), lambda a, s: a + s["points"])
        rows.append(F.struct((-total).alias("order"), F.lit(position).alias("position"), F.lit(slug).alias("slug"), kept.alias("signals")))
    return F.array_sort(F.array(*rows))


def classify(brands: DataFrame, signals: Signals, names: Mapping[str, str] | None = None) -> DataFrame:
    """``brands`` with primary, primary_name, confidence, score, secondary, alternatives, evidence, needs_confirmation, tags and reason.

    Input columns: brand_name, products, scenarios, competitors, gt_fields (array), official_site; nulls count as empty.
    High confidence needs 0.3 points and a lead of 0.15, medium 0.15 and 0.05, low 0.05; below that the industry is unknown.
    """
    ranked = with_terms(brands, signals).withColumn("_ranked", scored(signals))
    best, points = F.col("_ranked")[0], lambda i: -F.col("_ranked")[i]["order"]
    top, lead = points(0), points(0) - F.coalesce(points(1), F.lit(0))
    confidence = F.when((top >= 300) & (lead >= 150), "high").when((top >= 150) & (lead >= 50), "medium").otherwise("low")
    known = top >= 50
    others = F.filter(F.slice("_ranked", 2, 3), lambda x: -x["order"] > 30)
    strong = F.filter(F.slice(others, 1, 2), lambda x: -x["order"] > 50)
    table = F.create_map(*[F.lit(x) for kv in (names or {}).items() for x in kv]) if names else None
    name = F.coalesce(F.element_at(table, best["slug"]), best["slug"]) if names else best["slug"]
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    said = F.array_join(F.transform(F.slice(best["signals"], 1, 3), lambda s: F.element_at(labels, s["signal"])), ",")
    site = F.lower(F.concat_ws(" ", F.coalesce("products", F.lit("")), F.coalesce("official_site", F.lit(""))))
    tags = F.slice(F.filter(F.array(*[F.lit(t) for t in TAGS]), lambda t: F.contains(site, t)), 1, 8)
    nothing = F.array().cast("array<string>")
    thousandth = lambda c: c / F.lit(1000.0)
    return ranked.select(
        *brands.columns,
        F.when(known, best["slug"]).otherwise("unknown").alias("primary"),
        F.when(known, name).otherwise("未知行业").alias("primary_name"),
        F.when(known, confidence).otherwise("low").alias("confidence"),
        thousandth(top).alias("score"),
        F.when(known, F.transform(strong, lambda x: x["slug"])).otherwise(nothing).alias("secondary"),
        F.when(known, F.transform(others, lambda x: x["slug"])).otherwise(nothing).alias("alternatives"),
        F.when(known, F.transform(best["signals"], lambda s: F.concat(s["signal"], F.lit("="), s["points"].cast("string")))).otherwise(nothing).alias("evidence"),
        (~known | (confidence != "high")).alias("needs_confirmation"),
        F.when(known, tags).otherwise(nothing).alias("tags"),
        F.when(known, F.format_string("品牌%s等信号匹配%s行业。置信度得分 %.2f。", said, name, thousandth(top))).otherwise(TOO_WEAK).alias("reason"),
    )
