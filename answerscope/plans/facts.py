"""Claim and evidence queries. The driver's texts hold no Chinese, so rules run with stand-in words where SQL checks them."""

from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import claims as C
from answerscope.operators import evidence as E
from answerscope.plans.registry import query, table

SIGNALS = {"industry": ("ation", "heit"), "category": ("idiot", "icense"), "positioning": ("the of", "der die")}


@query(
    "c1_relevance",
    """WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts, len(regexp_split_to_array(text, '[.\\n]+')) AS n FROM documents),
    k AS (SELECT *, len(list_filter(parts, lambda x: contains(x, 'The') AND instr(x, 'The') - 1 < least(length(x) / 3, 20))) AS subject FROM s)
    SELECT doc_id, CASE WHEN subject >= 1 THEN 'brand_centric' WHEN contains(text, 'The') AND n <= 5 THEN 'brand_mentioned' WHEN contains(text, 'ation') OR contains(text, 'heit') THEN 'category_general' ELSE 'irrelevant' END AS relevance FROM k""",
)
def _(s, d):
    return table(s, d, "documents").select("doc_id", C.relevance(F.col("text"), F.array(F.lit("The")), ("ation", "heit"), "[.\n]+").alias("relevance"))


@query("c2_subject_type", "SELECT doc_id, CASE WHEN contains(text, 'Onthe') THEN 'target_brand' WHEN contains(text, 'idiot') OR contains(text, 'clown') THEN 'competitor' ELSE 'generic' END AS subject FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", C.subject_type(F.col("text"), F.array(F.lit("Onthe")), F.array(F.lit("idiot"), F.lit("clown"))).alias("subject"))


def extraction_sql() -> str:
    parts = []
    for field, words in SIGNALS.items():
        first = "CASE " + " ".join(f"WHEN contains(lower(x), '{w}') THEN '{w}'" for w in words) + " END"
        n = " + ".join(f"contains(lower(x), '{w}')::INT" for w in words)
        parts.append(f"SELECT doc_id, '{field}' AS field, x, {first} AS w, {n} AS n FROM s WHERE {first} IS NOT NULL")
    return f"""WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\\n]+'))) AS x FROM documents), h AS ({' UNION ALL '.join(parts)}), p AS (SELECT *, instr(lower(x), w) AS at_ FROM h WHERE length(x) >= 10)
    SELECT doc_id, field, left(trim(substring(x, greatest(1, at_ - 20), at_ + length(w) + 40 - greatest(1, at_ - 20))), 150) AS claim_text, round(0.6::DOUBLE + 0.1::DOUBLE * n, 2) AS confidence FROM p"""


@query("c3_extract_claims", extraction_sql())
def _(s, d):
    answers = table(s, d, "documents").select("doc_id", F.col("text").alias("answer_text"))
    return C.extract(answers, SIGNALS, "[.\n]+").select("doc_id", "field", "claim_text", "confidence")


def stated(s, d):
    """Claims about parts: names against types, with a fact record per part."""
    p = table(s, d, "part")
    field = F.element_at(F.array(*[F.lit(x) for x in ("official_name", "category", "core_products", "core_scenarios")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    fact = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.col("p_name")).when(F.col("p_partkey") % 5 == 2, F.concat_ws(" ", "p_type", F.reverse("p_name"))).otherwise(F.col("p_type"))
    kind = F.when(F.col("p_size") % 7 == 0, "generic").when(F.col("p_size") % 7 == 1, "competitor").otherwise("target_brand")
    nature = F.when(F.col("p_size") % 3 == 0, "opinion").when(F.col("p_size") % 3 == 1, "speculation").otherwise("fact")
    return p.select("p_partkey", field.alias("field"), F.col("p_name").alias("claim_text"), kind.alias("subject_type"), nature.alias("nature"), fact.alias("fact"))


@query("c4_verify_claims")
def _(s, d):
    # the near-miss rule compares characters by matching blocks, which SQL cannot express
    return C.verify(stated(s, d))


@query("c4_verdict_counts")
def _(s, d):
    return C.verify(stated(s, d)).groupBy("verdict", "severity").agg(F.count("*").alias("n"))


@query("c10_claim_nature")
def _(s, d):
    return C.with_nature(table(s, d, "benchmark").select("item_id", F.col("text").alias("claim_text"))).select("item_id", "nature", "nature_confidence", "signal_strength", "negated")


@query("c13_review_flags")
def _(s, d):
    said = table(s, d, "benchmark").select("item_id", F.col("text").alias("claim_text"), F.lit("fintech").alias("industry"), F.lit("identity").alias("predicate"))
    return C.review_flag(C.with_nature(said)).select("item_id", "nature", "speculation_risk", "industry_risk", "needs_review")


@query("f28_char_ratio")
def _(s, d):
    pairs = table(s, d, "part").select("p_partkey", F.round(C.char_ratio(F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type"))), 6).alias("ratio"))
    return pairs


def sources(s, d):
    """Sources of facts: line items of an order, the supplier's number for their value."""
    l = table(s, d, "lineitem")
    tier = F.element_at(F.array(*[F.lit(x) for x in "SABCD"]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return l.select(
        F.col("l_orderkey").alias("fact"), F.concat(F.lit("Value "), (F.col("l_partkey") % 3).cast("string")).alias("value"), tier.alias("tier"), F.when(F.col("l_returnflag") == "R", "official_site").otherwise("other").alias("source_type"),
        F.when(F.col("l_linestatus") == "O", "text").otherwise("").alias("evidence_text"), F.when(F.col("l_linenumber") == 1, "reviewer").alias("confirmed_by"),
    )


WEIGHT = "round(CASE WHEN t = 0 THEN 5 WHEN t = 1 THEN 4 WHEN t = 2 THEN 3 WHEN t = 3 THEN 2 ELSE 1 END * CASE WHEN l_returnflag = 'R' THEN 1.2::DOUBLE ELSE 1.0 END * CASE WHEN l_linestatus = 'O' THEN 1.1::DOUBLE ELSE 1.0 END * CASE WHEN l_linenumber = 1 THEN 1.1::DOUBLE ELSE 1.0 END, 3)"
SOURCES = f"(SELECT *, CASE WHEN t = 4 THEN least({WEIGHT}, 1.0) ELSE {WEIGHT} END AS weight, 5 - t AS rank, 'value ' || l_partkey % 3 AS v FROM (SELECT *, l_suppkey % 5 AS t FROM lineitem))"


@query("c14_source_weight", f"SELECT l_orderkey AS fact, count(*) AS n, round(sum(weight), 3) AS weight FROM {SOURCES} GROUP BY 1")
def _(s, d):
    w = E.source_weight(F.col("tier"), F.col("source_type"), F.col("evidence_text"), F.col("confirmed_by"))
    return sources(s, d).groupBy("fact").agg(F.count("*").alias("n"), F.round(F.sum(w), 3).alias("weight"))


@query(
    "c15_consensus",
    f"""WITH v AS (SELECT l_orderkey AS fact, v AS variant, count(*) AS n, sum(weight::DECIMAL(18,3)) AS weight, max(rank) AS best, arg_max(l_returnflag = 'R' AND l_linestatus = 'O', rank * 2 + (l_returnflag = 'R' AND l_linestatus = 'O')::INT) AS firm FROM {SOURCES} GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY weight DESC, variant) AS place FROM v),
    f AS (SELECT fact, max(variant) FILTER (place = 1) AS consensus, max(best) FILTER (place = 1) AS best, bool_or(firm) FILTER (place = 1) AS firm, max(n) FILTER (place = 1) AS supporting, sum(n)::BIGINT AS total, count(*) AS k, max(weight) FILTER (place = 1) / sum(weight)::DOUBLE AS ratio, max(best) FILTER (place > 1) AS dissent FROM p GROUP BY 1)
    SELECT fact, consensus, supporting, total, round(supporting / total, 4) AS agreement, round(ratio, 6) AS weighted_agreement, CASE WHEN k <= 1 THEN 'none' WHEN dissent >= 4 AND fact % 2 = 0 THEN 'critical' WHEN dissent >= 4 THEN 'strong' WHEN dissent = 3 THEN 'moderate' ELSE 'weak' END AS conflict,
      CASE WHEN k > 1 THEN 'disputed' WHEN total = 1 THEN CASE WHEN best >= 4 AND firm THEN 'strong' WHEN best >= 3 THEN 'moderate' ELSE 'weak' END WHEN ratio >= 0.7 AND best >= 4 THEN 'strong' WHEN ratio >= 0.5 AND best IN (3, 4) THEN 'moderate' ELSE 'weak' END AS strength FROM f""",
)
def _(s, d):
    return E.consensus(sources(s, d), ["fact"], F.col("fact") % 2 == 0)


@query(
    "c19_field_confidence",
    f"""WITH c AS (SELECT l_orderkey AS fact, count(*) AS n, round(avg(CASE t WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.2 ELSE 0.0 END), 6) AS score, count(DISTINCT v) > 1 AS has_conflict, bool_or(t = 0) AS s, bool_or(t <= 1) AS a FROM {SOURCES} GROUP BY 1)
    SELECT fact, n, score, has_conflict, CASE WHEN has_conflict THEN 'uncertain' WHEN s AND score >= 0.8 THEN 'high' WHEN a AND score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
)
def _(s, d):
    return E.field_confidence(sources(s, d), ["fact"])


@query("c20_conflicts", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, count(DISTINCT o_orderpriority) > 1 AS has_conflict FROM orders GROUP BY 1")
def _(s, d):
    n = F.countDistinct("o_orderpriority")
    return table(s, d, "orders").groupBy("o_custkey").agg(n.alias("n_values"), (n > 1).alias("has_conflict"))


@query("c21_queries", "SELECT n_name, q AS query FROM nation, (SELECT unnest(['official site', 'founded', 'products']) AS q)")
def _(s, d):
    # at most nine queries per brand and field, from a fixed list of templates
    asked = F.slice(F.array(F.lit("official site"), F.lit("founded"), F.lit("products")), 1, 9)
    return table(s, d, "nation").select("n_name", F.explode(asked).alias("query"))


@query("c22_overall_confidence", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= 0.6 * count(*) THEN 'high' WHEN count(*) FILTER (o_orderstatus = 'F') >= 0.3 * count(*) THEN 'medium' ELSE 'low' END AS confidence FROM orders GROUP BY 1")
def _(s, d):
    k, n = F.count_if(F.col("o_orderstatus") == "F"), F.count("*")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.when(k >= F.expr("0.6BD") * n, "high").when(k >= F.expr("0.3BD") * n, "medium").otherwise("low").alias("confidence"))


@query("c23_promote_ready", f"SELECT l_orderkey AS fact, count(*) >= 2 AND max(rank) >= 4 AS ready FROM {SOURCES} GROUP BY 1")
def _(s, d):
    return sources(s, d).groupBy("fact").agg(((F.count("*") >= 2) & (F.max(E.rank(F.col("tier"))) >= 4)).alias("ready"))


@query(
    "c24_candidate_outcome",
    "WITH a AS (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_orderkey, CASE WHEN a.v IS NULL THEN 'created' WHEN a.v = o_orderpriority THEN 'evidence_attached' ELSE 'conflict' END AS outcome FROM orders o LEFT JOIN a ON o.o_custkey = a.o_custkey WHERE o_orderstatus = 'O'",
)
def _(s, d):
    o = table(s, d, "orders")
    active = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("v"))
    outcome = F.when(F.col("v").isNull(), "created").when(F.col("v") == F.col("o_orderpriority"), "evidence_attached").otherwise("conflict")
    return o.where("o_orderstatus = 'O'").join(active, "o_custkey", "left").select("o_orderkey", outcome.alias("outcome"))


@query("c26_template_health", "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 9 = 0) AS n_invalid, count(*) FILTER (p_size % 9 = 0) / count(*) <= 0.2 AS can_collect FROM part GROUP BY 1")
def _(s, d):
    template = F.concat(F.lit("What of {brand}"), F.when(F.col("p_size") % 9 == 0, " and {rival}").otherwise(""))
    bad = F.size(T.unresolved(T.render(template, {"brand": F.col("p_name")}))) > 0
    n, k = F.count("*"), F.count_if(bad)
    return table(s, d, "part").groupBy("p_brand").agg(n.alias("n"), k.alias("n_invalid"), (k / n <= 0.2).alias("can_collect"))


@query(
    "c28_version_diff",
    "WITH a AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS type FROM part), b AS (SELECT p_partkey AS id, CASE WHEN p_size < 5 THEN 'x' ELSE p_brand END AS brand, p_type AS type FROM part) SELECT id, 'brand' AS field, a.brand AS old, b.brand AS new FROM a JOIN b USING (id) WHERE a.brand <> b.brand UNION ALL SELECT id, 'type', a.type, b.type FROM a JOIN b USING (id) WHERE a.type <> b.type",
)
def _(s, d):
    p = table(s, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).unpivot("id", ["brand", "type"], "field", "old")
    new = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 5, "x").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("type")).unpivot("id", ["brand", "type"], "field", "new")
    return old.join(new, ["id", "field"]).where("old <> new")


@query("c34_longest_answer", "SELECT source AS field, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("field")).agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n"))


MATCH_CASES = [
    ("founded_year", "1971 ", "founded in 1971 there"), ("founded_year", "1971 ", "founded in 1985 there"), ("founded_year", "1971 ", "listed on 1992 market"), ("official_domains", "https://www.a.com/x", "a.com"), ("official_domains", "shop.a.com", "a.com"),
    ("store_count", "32,000 stores", "32000 cafes"), ("store_count", "global 32000", "china 6000"), ("store_count", "32000", "29000"), ("core_products", "coffee tea", "coffee and cake"), ("core_products", "a b c d e f", "a x"),
    ("headquarters", "Seattle", "in seattle, wa"), ("headquarters", "Seattle", "in London"), ("headquarters", "Shanghai", "in London"), ("official_name", "Acme Corp", "the acme corp group"), ("official_name", "Acme Corp", "Acme Holdings"), ("slogan", "good coffee", "very good coffee"), ("slogan", "good coffee", "tea"),
]
MATCH_KINDS = ["number_exact", "year_mismatch", "year_scope_mismatch", "domain_exact", "domain_subdomain", "number_exact", "scope_mismatch", "count_mismatch", "token_overlap", "weak_overlap", "city_match", "city_mismatch", "scope_mismatch", "substring_match", "token_overlap", "substring_match", "no_match"]


@query(
    "m1_m7_matchers",
    f"SELECT p_partkey, kind FROM part JOIN (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(MATCH_KINDS))}) v(i, kind) ON p_partkey % {len(MATCH_KINDS)} = i",
)
def _(s, d):
    # every part is a case by its number; the years are its own
    cases = s.createDataFrame([(i, *c) for i, c in enumerate(MATCH_CASES)], "i long, field string, claimed string, found string")
    met = table(s, d, "part").join(F.broadcast(cases), F.col("p_partkey") % len(MATCH_CASES) == F.col("i"))
    year = (F.col("p_size") + 1901).cast("string")
    other = (F.col("p_size") + 1915).cast("string")
    own = lambda c: F.replace(F.replace(F.replace(c, F.lit("1971"), year), F.lit("1985"), other), F.lit("1992"), other)
    is_year = F.col("field") == "founded_year"
    claimed, found = (F.when(is_year, own(F.col(c))).otherwise(F.col(c)) for c in ("claimed", "found"))
    return met.select("p_partkey", E.matches(F.col("field"), claimed, found)["kind"].alias("kind"))


@query(
    "j15_m9_cross_validation",
    """WITH c AS (SELECT p_partkey AS id, p_brand AS key, p_name AS value FROM part), s AS (SELECT p_brand AS key, p_name AS found, CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS tier FROM part),
    m AS (SELECT id, tier, lower(value) = lower(found) OR (len(list_intersect(string_split(lower(value), ' '), string_split(lower(found), ' '))) / 2 >= 0.5) AS hit FROM c LEFT JOIN s USING (key)),
    g AS (SELECT id, count(*) FILTER (hit) AS n, count(*) FILTER (hit AND tier = 'S') AS s, count(*) FILTER (hit AND tier = 'A') AS a, count(*) FILTER (hit AND tier = 'B') AS b FROM m GROUP BY 1)
    SELECT id, 'official_name' AS field, n::INT AS n_matches, 0 AS n_contradictions, CASE WHEN s > 0 THEN 'A' WHEN a + b > 0 THEN 'B' ELSE 'C' END AS tier, CASE WHEN n = 0 THEN 'unverified' WHEN s > 0 THEN 'confirmed_strong' WHEN a > 0 AND a + b >= 2 THEN 'confirmed_multi' WHEN a > 0 THEN 'confirmed_strong' WHEN b >= 2 THEN 'confirmed_multi' WHEN b > 0 THEN 'confirmed_single' ELSE 'weak_support' END AS status FROM g""",
)
def _(s, d):
    p = table(s, d, "part")
    tier = F.element_at(F.array(*[F.lit(x) for x in "SABC"]), (F.col("p_size") % 4 + 1).cast("int"))
    claims = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.lit("official_name").alias("field"), F.col("p_name").alias("value"))
    found = p.select(F.col("p_brand").alias("key"), F.lit("official_name").alias("field"), F.col("p_name").alias("value"), tier.alias("tier"))
    return E.cross_validate(claims, found)
