"""Evidence for facts: field matchers, tier ladders, source weights, consensus and conflicts.

``matches`` compares a claimed value with a found one, by a rule per field.
Everything else aggregates sources per fact and field.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.functions import text as T

# Ranks and scores of the tiers; words of the field rules.
TIER_RANK = {"S": 5, "A": 4, "B": 3, "C": 2, "D": 1}
TIER_SCORE = {"S": 1.0, "A": 0.7, "B": 0.4, "C": 0.2, "D": 0.0}
OFFICIAL = ("official_site", "official_report", "regulatory")
OTHER_YEAR = ("list", "ipo", "public", "enter", "entered", "china", "market", "open", "first store", "launch")
FOUNDED = ("founded", "found", "established", "成立", "创始")
GLOBAL, CHINA = ("global", "全球", "worldwide"), ("china", "中国", "china market")
CHINA_PLACES = ("china", "中国", "shanghai", "beijing")
CITIES = ("seattle", "new york", "london", "tokyo", "首尔", "东京", "西雅图", "纽约", "伦敦", "shanghai", "beijing", "上海", "北京")


def outcome(kind: str, score: Column | float | None = None, match: bool = False, contradiction: bool = False) -> Column:
    value = F.lit(score).cast("double") if score is None or isinstance(score, float) else score
    return F.struct(F.lit(match).alias("is_match"), F.lit(contradiction).alias("is_contradiction"), F.lit(kind).alias("kind"), value.alias("score"))


def generic(a: Column, b: Column, substring: float = 0.7, share: float = 0.5) -> Column:
    x, y = F.lower(a), F.lower(b)
    t, u = T.word_tokens(a), T.word_tokens(b)
    ratio = T.overlap(t, u)
    return F.when(F.contains(y, x) | F.contains(x, y), outcome("substring_match", substring, match=True)).when((F.size(t) == 0) | (F.size(u) == 0), outcome("none")).when(ratio >= share, outcome("token_overlap", F.round(ratio, 3), match=True)).otherwise(outcome("no_match"))


def founded_year(a: Column, b: Column) -> Column:
    x, y, low = T.four_digits(a), T.four_digits(b), F.lower(b)
    founded, other = T.any_contains(low, FOUNDED), T.any_contains(low, OTHER_YEAR)
    return F.when(x.isNull() | y.isNull(), outcome("none")).when(other & ~founded, outcome("year_scope_mismatch")).when(x == y, outcome("number_exact", 1.0, match=True)).when(founded & ~other, outcome("year_mismatch", contradiction=True)).otherwise(outcome("none"))


def domains(a: Column, b: Column) -> Column:
    x, y = T.domain(a), T.domain(b)
    under = F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))
    return F.when((x == "") | (y == ""), outcome("none")).when(x == y, outcome("domain_exact", 1.0, match=True)).when(under, outcome("domain_subdomain", 0.9, match=True)).otherwise(outcome("domain_mismatch"))


def store_count(a: Column, b: Column) -> Column:
    x, y = T.first_number(a), T.first_number(b)
    wide_a, wide_b, china_b = T.any_contains(F.lower(a), GLOBAL), T.any_contains(F.lower(b), GLOBAL), T.any_contains(F.lower(b), CHINA)
    return F.when(x.isNull() | y.isNull(), outcome("none")).when(wide_a & china_b, outcome("scope_mismatch")).when(x == y, outcome("number_exact", 0.9, match=True)).when(wide_a == wide_b, outcome("count_mismatch", contradiction=True)).otherwise(outcome("scope_mismatch"))


def products(a: Column, b: Column, share: float = 0.5) -> Column:
    t, u = T.word_tokens(a), T.word_tokens(b)
    ratio = T.overlap(t, u)
    score = F.round(ratio, 3)
    return (
        F.when((F.size(t) == 0) | (F.size(u) == 0), outcome("none")).when(ratio == 0, outcome("no_overlap"))
        .when(ratio >= share, outcome("token_overlap", score, match=True)).when(ratio >= 0.2, outcome("partial_overlap", score, match=True)).otherwise(outcome("weak_overlap"))
    )


def headquarters(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    cities = F.array(*[F.lit(c) for c in CITIES])
    own, found = F.filter(cities, lambda c: F.contains(x, c)), F.filter(cities, lambda c: F.contains(y, c))
    both = (F.size(own) > 0) & (F.size(found) > 0)
    return F.when(T.any_contains(x, CHINA_PLACES) != T.any_contains(y, CHINA_PLACES), outcome("scope_mismatch")).when(both & F.arrays_overlap(own, found), outcome("city_match", 0.9, match=True)).when(both, outcome("city_mismatch", contradiction=True)).otherwise(generic(a, b))


def official_name(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(b)
    ratio = T.overlap(T.space_tokens(a), T.space_tokens(b))
    return F.when(F.contains(y, x) | F.contains(x, y), outcome("substring_match", 0.95, match=True)).when(ratio >= 0.5, outcome("token_overlap", ratio, match=True)).otherwise(outcome("no_match"))


MATCHERS = {"founded_year": founded_year, "official_domains": domains, "store_count": store_count, "core_products": products, "headquarters": headquarters, "official_name": official_name}


def matches(field: Column, claimed: Column, found: Column) -> Column:
    """Struct (is_match, is_contradiction, kind, score) by the rule of the field."""
    out = None
    for name, rule in MATCHERS.items():
        out = F.when(field == name, rule(claimed, found)) if out is None else out.when(field == name, rule(claimed, found))
    return out.otherwise(generic(claimed, found))


def verified_tier(good: Callable[..., Column], bad: Callable[..., Column]) -> tuple[Column, Column]:
    """Tier and status of a claim from the numbers of its matching and of its contradicting sources: ``good("A", "B")`` counts those of two tiers, ``good()`` all.

    One S or two A/B contradictions take it down to D; a claim never gets S itself.
    """
    down = (bad("S") > 0) | (bad("A", "B") >= 2)
    s, a, b = (good(x) > 0 for x in "SAB")
    tier = F.when(down, "D").when(s, "A").when(a | b, "B").otherwise("C")
    status = (
        F.when(down, "contradicted").when(good() == 0, "unverified").when(s, "confirmed_strong").when(a & (good("A", "B") >= 2), "confirmed_multi")
        .when(a, "confirmed_strong").when(b & (good("B") >= 2), "confirmed_multi").when(b, "confirmed_single").otherwise("weak_support")
    )
    return tier, status


def cross_validate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``claims`` (id, field, value) against ``sources`` (field, value, tier) of the same field and brand key.

    Distinct claimed values meet distinct found values, which carry the number of
    their sources by tier: equal rows cost one comparison, and no list is collected.
    """
    tiers = {"n": F.lit(True), **{f"n_{x}": F.col("tier") == x for x in "SAB"}}
    found = sources.where("tier is not null and value is not null").groupBy("key", "field", F.col("value").alias("found")).agg(*[F.count_if(c).alias(n) for n, c in tiers.items()])
    met = claims.select("key", "field", "value").distinct().join(found, ["key", "field"]).withColumn("m", matches(F.col("field"), F.col("value"), F.col("found")))
    sum_if = lambda c, n, name: F.sum(F.when(c, F.col(n)).otherwise(0)).alias(f"{name}_{n}")
    values = met.groupBy("key", "field", "value").agg(*[sum_if(F.col(f"m.{c}"), n, name) for name, c in (("good", "is_match"), ("bad", "is_contradiction")) for n in tiers])
    values = values.withColumnsRenamed({c: f"_{c}" for c in ("key", "field", "value")})
    # claims without a source, or with a null, keep their row
    same_value = (F.col("key") == F.col("_key")) & (F.col("field") == F.col("_field")) & (F.col("value") == F.col("_value"))
    names = [f"{name}_{n}" for name in ("good", "bad") for n in tiers]
    grouped = claims.join(values, same_value, "left").groupBy("id", "field").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    counted = lambda name: lambda *x: sum((F.col(f"{name}_n_{t}") for t in x[1:]), F.col(f"{name}_n_{x[0]}")) if x else F.col(f"{name}_n")
    tier, status = verified_tier(counted("good"), counted("bad"))
    return grouped.select("id", "field", F.col("good_n").cast("int").alias("n_matches"), F.col("bad_n").cast("int").alias("n_contradictions"), tier.alias("tier"), status.alias("status"))


def rank(tier: Column) -> Column:
    return F.when(tier == "S", 5).when(tier == "A", 4).when(tier == "B", 3).when(tier == "C", 2).otherwise(1)


def source_weight(tier: Column, source_type: Column, evidence_text: Column, confirmed_by: Column) -> Column:
    factor = F.when(source_type.isin(*OFFICIAL), 1.2).otherwise(1.0) * F.when(F.trim(F.coalesce(evidence_text, F.lit(""))) != "", 1.1).otherwise(1.0) * F.when(F.coalesce(confirmed_by, F.lit("")) != "", 1.1).otherwise(1.0)
    weight = rank(tier) * factor
    return F.round(F.when(tier == "D", F.least(weight, F.lit(1.0))).otherwise(weight), 3)


def consensus(sources: DataFrame, keys: Sequence[str], critical: Column) -> DataFrame:
    """Per fact: the variant of the greatest weight, agreement, conflict and strength.

    ``sources``: keys, value, tier, source_type, evidence_text, confirmed_by. Two
    levels of aggregation; no fact's sources are collected.
    """
    weight = source_weight(F.col("tier"), F.col("source_type"), F.col("evidence_text"), F.col("confirmed_by"))
    firm = F.col("source_type").isin(*OFFICIAL) & (F.trim(F.coalesce("evidence_text", F.lit(""))) != "")
    variants = sources.select(*keys, T.normalise_value(F.col("value")).alias("variant"), weight.alias("weight"), rank(F.col("tier")).alias("rank"), firm.alias("firm"))
    variants = variants.groupBy(*keys, "variant").agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("decimal(18,3)")).alias("weight"), F.max("rank").alias("best"), F.max_by("firm", F.struct("rank", "firm")).alias("firm"))
    order = W.partitionBy(*keys).orderBy(F.desc("weight"), "variant")
    placed = variants.withColumn("place", F.row_number().over(order))
    top = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    facts = placed.groupBy(*keys).agg(
        top("variant").alias("consensus"), top("best").alias("best"), top("firm").alias("firm"), top("n").alias("supporting"), F.sum("n").alias("total"), F.count("*").alias("n_variants"),
        (top("weight").cast("double") / F.sum("weight").cast("double")).alias("ratio"), F.max(F.when(F.col("place") > 1, F.col("best"))).alias("dissent"),
    )
    best, n = F.col("best"), F.col("total")
    conflict = F.when(F.col("n_variants") <= 1, "none").when((F.col("dissent") >= 4) & critical, "critical").when(F.col("dissent") >= 4, "strong").when(F.col("dissent") == 3, "moderate").otherwise("weak")
    single = F.when((best >= 4) & F.col("firm"), "strong").when(best >= 3, "moderate").otherwise("weak")
    several = F.when((F.col("ratio") >= 0.70) & (best >= 4), "strong").when((F.col("ratio") >= 0.50) & best.isin(3, 4), "moderate").otherwise("weak")
    strength = F.when(F.col("n_variants") > 1, "disputed").when(n == 1, single).otherwise(several)
    return facts.select(*keys, "consensus", "supporting", "total", F.round(F.col("supporting") / n, 4).alias("agreement"), F.round("ratio", 6).alias("weighted_agreement"), conflict.alias("conflict"), strength.alias("strength"))


def field_confidence(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """high, medium, low or uncertain from the average tier score and whether values differ."""
    score = F.when(F.col("tier") == "S", 1.0).when(F.col("tier") == "A", 0.7).when(F.col("tier") == "B", 0.4).when(F.col("tier") == "C", 0.2).otherwise(0.0)
    has = lambda *x: F.bool_or(F.col("tier").isin(*x))
    conflict = F.countDistinct(T.normalise_value(F.col("value"))) > 1
    mean = F.round(F.avg(score), 6)
    level = F.when(conflict, "uncertain").when(has("S") & (mean >= 0.8), "high").when(has("S", "A") & (mean >= 0.5), "medium").otherwise("low")
    return sources.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("score"), conflict.alias("has_conflict"), level.alias("confidence"))


# --- verification of high-risk fields by search --------------------------------

# Search queries by field; the first QUERIES are asked, for RESULTS answers each.
SEARCHES = {
    "official_name": ("{brand} 官方名称", "{brand} 公司简介", "{brand} official name", "{brand} 公司全称"),
    "founded_year": ("{brand} 成立时间", "{brand} founded {value}", "{brand} company history {value}", "{brand} 公司历史"),
    "official_domains": ("{brand} 官方网站", "{brand} 官网", "{brand} official website", "{brand} 官方网址"),
    "headquarters": ("{brand} 总部", "{brand} headquarters", "{brand} 公司地址", "{brand} 总部地址"),
    "core_products": ("{brand} 产品", "{brand} 核心产品", "{brand} products", "{brand} 产品列表"),
}
QUERIES, RESULTS = 3, 5
# Words of the verifier's own year and place rules.
NOT_FOUNDED = ("list", "ipo", "public", "enter", "china", "market", "first store", "open")
PLACES_CHINA = ("china", "中国", "shanghai", "beijing", "上海", "北京")


def search_queries(values: DataFrame, searches=SEARCHES) -> DataFrame:
    """(brand, field, n, query): the queries that ask for each of ``values`` (brand, field, value)."""
    field, known = F.col("field"), None
    for name, templates in searches.items():
        known = (F.when if known is None else known.when)(field == name, F.array(*[F.lit(t) for t in templates[:QUERIES]]))
    known = known.otherwise(F.array(F.lit("{brand} {field}")))
    each = values.select("brand", "field", "value", F.posexplode(known).alias("n", "query"))
    text = F.replace(F.replace(F.replace("query", F.lit("{brand}"), F.col("brand")), F.lit("{field}"), field), F.lit("{value}"), F.coalesce("value", F.lit("")))
    return each.select("brand", "field", (F.col("n") + 1).alias("n"), text.alias("query"))


def verifier_matches(field: Column, claimed: Column, snippet: Column, url: Column) -> Column:
    """Like ``matches``, with the verifier's thresholds: a claim must be in the text, products overlap by 0.4, domains come from the URL."""
    a, b = F.lower(F.coalesce(claimed, F.lit(""))), F.lower(snippet)
    t, u = T.word_tokens(claimed), T.word_tokens(snippet)
    share, neither = T.overlap(t, u), outcome("none")
    inside = (a != "") & F.contains(b, a)
    no_words = (F.size(t) == 0) | (F.size(u) == 0)
    plain = F.when(inside, outcome("substring_match", 0.7, match=True)).when(no_words, neither).when(share >= 0.5, outcome("token_overlap", F.round(share, 3), match=True)).otherwise(neither)
    x, y = T.four_digits(claimed), T.four_digits(snippet)
    founded, other = T.any_contains(b, FOUNDED), T.any_contains(b, NOT_FOUNDED)
    year = F.when(x.isNull() | y.isNull(), neither).when(other & ~founded, outcome("year_scope_mismatch")).when(x == y, outcome("number_exact", 1.0, match=True)).when(founded & ~other, outcome("year_mismatch", contradiction=True)).otherwise(neither)
    d, e = T.domain(claimed), T.domain(url)
    same = (d == e) | F.endswith(d, F.concat(F.lit("."), e)) | F.endswith(e, F.concat(F.lit("."), d))
    site = F.when((d != "") & (e != "") & same, outcome("domain_match", 0.95, match=True)).otherwise(neither)
    place = F.when(T.any_contains(a, PLACES_CHINA) != T.any_contains(b, PLACES_CHINA), outcome("scope_mismatch")).otherwise(plain)
    kind = F.when(share < 0.7, outcome("partial_overlap", F.round(share, 3), match=True)).otherwise(outcome("token_overlap", F.round(share, 3), match=True))
    product = F.when(no_words | (share < 0.4), neither).otherwise(kind)
    name = F.when((F.trim(a) != "") & F.contains(b, F.trim(a)), outcome("substring_match", 0.9, match=True)).otherwise(plain)
    rules = F.when(field == "founded_year", year).when(field == "official_domains", site).when(field == "headquarters", place).when(field == "core_products", product).when(field == "official_name", name).otherwise(plain)
    return F.when(F.coalesce(snippet, F.lit("")) == "", neither).otherwise(rules)


def verify_fields(values: DataFrame, results: DataFrame) -> DataFrame:
    """``values`` (brand, field, value) with the tier that search ``results`` (brand, field, n, rank, url, snippet, tier) support.

    The first RESULTS of the first QUERIES queries count, tier D never. Support of tier C alone is weak and upgrades
    nothing; one S or two A or B contradictions take the value down to D. Without any result it is unconfirmed.
    """
    used = results.where((F.col("n") <= QUERIES) & (F.col("rank") <= RESULTS) & (F.col("tier") != "D"))
    met = used.select("brand", "field", "n", "rank", "url", "snippet", "tier").join(values, ["brand", "field"]).withColumn("m", verifier_matches(F.col("field"), F.col("value"), F.col("snippet"), F.col("url")))
    good, bad, tier = F.col("m.is_match"), F.col("m.is_contradiction"), F.col("tier")
    firm = good & tier.isin("S", "A", "B")
    counts = [F.count_if(good & (tier == x)).alias(f"good_{x}") for x in "SABC"] + [F.count_if(bad & (tier == x)).alias(f"bad_{x}") for x in "SAB"]
    score = F.round(F.avg(F.when(firm, F.coalesce("m.score", F.lit(0.5)))), 3).alias("found_score")
    # at most QUERIES * RESULTS rows a field
    sources = F.slice(F.transform(F.array_sort(F.collect_list(F.when(firm, F.struct("n", "rank", "url")))), lambda s: s["url"]), 1, 5).alias("found_sources")
    g = met.groupBy("brand", "field").agg(*counts, score, sources)
    n = lambda *x: sum((F.coalesce(F.col(c), F.lit(0)) for c in x[1:]), F.coalesce(F.col(x[0]), F.lit(0)))
    down, ab = (n("bad_S") > 0) | (n("bad_A", "bad_B") >= 2), n("good_A", "good_B")
    s, a = n("good_S") > 0, n("good_A") > 0
    status = (
        F.when(down, "contradicted").when(s, "confirmed_strong").when(a & (ab >= 2), "confirmed_multi").when(a, "confirmed_strong")
        .when(ab >= 2, "confirmed_multi").when(ab == 1, "confirmed_single").when(n("good_C") > 0, "weak_support").otherwise("unconfirmed")
    )
    level = F.when(down, "D").when(s, "A").when(ab > 0, "B").otherwise("C")
    held = ~down & (s | (ab > 0))
    return values.join(g, ["brand", "field"], "left").select(
        "brand", "field", "value", level.alias("validated_tier"), status.alias("validation_status"),
        F.when(held, F.col("found_score")).otherwise(0.0).alias("match_score"), F.when(held, F.col("found_sources")).otherwise(F.array().cast("array<string>")).alias("matched_sources"),
    )
