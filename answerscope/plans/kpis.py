"""KPI queries: documents stand in for answers, their sources for platforms, their languages for question types."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.operators import kpi
from answerscope.plans.registry import query, table

BRAND = kpi.Brand(name="the", aliases=("idiot", "Onthe"), domains=("example.com",), differentiators=("token", "icense"), quality_markers=("and", "of", "is"), recommendations=("was[ ]{brand}", "For {brand}"))
ALIASES = "(contains(lower({0}), 'the') OR contains(lower({0}), 'idiot') OR contains(lower({0}), 'onthe'))"
ITEM = "'(?:^|\\n)\\s*(?:[0-9]+[.)、]|[-*])\\s*([^\\n]{0,80})'"
MAPPING = [("sov", "en", "allowed"), ("sov", "fr", "conditional"), ("sov", "de", "excluded"), ("accuracy", "en", "allowed")]


def answers(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    status = F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("success")
    return docs.select("doc_id", F.col("source").alias("platform"), F.col("lang").alias("question_type"), F.substring("text", 1, 40).alias("question"), status.alias("status"), F.col("text").alias("answer_text"))


ANSWERS = "(SELECT doc_id, source AS platform, lang AS question_type, substring(text, 1, 40) AS question, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, text AS answer_text FROM documents)"


def ladder(n: str, name: str) -> str:
    high, medium = kpi.CONFIDENCE[name]
    return f"CASE WHEN {n} >= {high} THEN 'high' WHEN {n} >= {medium} THEN 'medium' ELSE 'low' END"


def core_sql() -> str:
    said, plain = ALIASES.format("answer_text"), f"NOT {ALIASES.format('question')}"
    item = f"CASE WHEN regexp_matches(answer_text, {ITEM}) THEN contains(regexp_extract(answer_text, {ITEM}, 1), 'the') ELSE false END"
    counts = {
        "sov": ("said", "true"), "first_rec_rate": ("first", "true"), "citation_rate": ("said AND cited", "said"),
        "scenario_recall": ("plain AND said", "plain"), "differentiation": ("diff", "true"), "recommendation_quality": ("marks >= 2", "true"),
    }
    out = []
    for name, (hit, of) in counts.items():
        n = f"count(*) FILTER (valid AND {of})"
        out += [f"CASE WHEN {n} > 0 THEN round(count(*) FILTER (valid AND {hit}) / {n}, 4) ELSE 0.0 END AS {name}", f"{ladder(n, name)} AS {name}_confidence"]
    return f"""WITH a AS (SELECT platform, status = 'success' AND answer_text <> '' AS valid, {said} AS said, {plain} AS plain,
      {item} OR contains(answer_text, 'was the') OR contains(answer_text, 'For the') AS first, len(list_filter(regexp_extract_all(answer_text, 'https?://[^\\s)\\]】]+'), lambda u: contains(lower(u), 'example.com'))) > 0 AS cited,
      contains(answer_text, 'token') OR contains(answer_text, 'icense') AS diff, contains(answer_text, 'and')::INT + contains(answer_text, 'of')::INT + contains(answer_text, 'is')::INT AS marks FROM {ANSWERS})
    SELECT platform, count(*) AS attempted, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND said) AS n_mentioned, round((count(*) - count(*) FILTER (valid)) / count(*), 4) AS failure_rate, {', '.join(out)} FROM a GROUP BY 1"""


@query("kpi_core", core_sql())
def _(s, d):
    return kpi.counting(answers(s, d), BRAND, ["platform"])


@query(
    "kpi1_sov",
    f"SELECT platform, count(*) AS n, count(*) FILTER ({ALIASES.format('answer_text')}) AS n_mentioned, round(count(*) FILTER ({ALIASES.format('answer_text')}) / count(*), 4) AS sov, {ladder('count(*)', 'sov')} AS confidence FROM {ANSWERS} WHERE status = 'success' AND answer_text <> '' AND question_type IN ('en', 'fr') GROUP BY 1",
)
def _(s, d):
    mapping = s.createDataFrame(MAPPING, "kpi string, question_type string, mode string")
    n, hits = F.count("*"), F.count_if("said")
    asked = kpi.eligible(answers(s, d), mapping, "sov").select("platform", kpi.is_mentioned(BRAND).alias("said"))
    return asked.groupBy("platform").agg(n.alias("n"), hits.alias("n_mentioned"), kpi.rate(hits, n).alias("sov"), kpi.confidence("sov", n).alias("confidence"))


@query(
    "kpi7_stability",
    """WITH t AS (SELECT DISTINCT conv_id % 40 AS brand, conv_id % 5 AS platform, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS token FROM conversations WHERE role = 'assistant'),
    n AS (SELECT brand, platform, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT x.brand, x.platform AS a, y.platform AS b, count(*) AS both_ FROM t x JOIN t y ON x.brand = y.brand AND x.token = y.token AND x.platform < y.platform GROUP BY ALL),
    j AS (SELECT b.brand, sum(both_ / (p.n + q.n - both_)) AS total FROM b JOIN n p ON b.brand = p.brand AND b.a = p.platform JOIN n q ON b.brand = q.brand AND b.b = q.platform GROUP BY 1),
    k AS (SELECT brand, count(*) * (count(*) - 1) // 2 AS pairs FROM n GROUP BY 1)
    SELECT k.brand, CASE WHEN pairs > 0 THEN round(coalesce(total, 0.0) / pairs, 4) ELSE 1.0 END AS semantic_stability, pairs, CASE WHEN pairs >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM k LEFT JOIN j ON k.brand = j.brand""",
)
def _(s, d):
    c = table(s, d, "conversations").where("role = 'assistant'")
    return kpi.stability(c.select((F.col("conv_id") % 40).alias("brand"), (F.col("conv_id") % 5).alias("platform"), F.col("text").alias("answer_text")), ["brand"])


@query(
    "kpi9_consistency",
    f"WITH r AS (SELECT question_type, platform, avg(contains(answer_text, 'the')::INT) AS rate, count(*) AS n FROM {ANSWERS} WHERE answer_text <> '' GROUP BY ALL) SELECT question_type, round(1 - least(var_pop(rate), 1.0), 4) AS cross_platform_consistency, sum(n)::BIGINT AS n, {ladder('sum(n)', 'cross_platform_consistency')} AS confidence FROM r GROUP BY 1",
)
def _(s, d):
    return kpi.consistency(answers(s, d), BRAND, ["question_type"])


@query(
    "kpi11_field_verdicts",
    """WITH g AS (SELECT p_partkey, lower(p_name) AS v, lower(p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE reverse(p_name) END) AS t, string_split(lower(p_name), ' ') AS items FROM part),
    c AS (SELECT *, len(list_filter(items, lambda i: contains(t, i))) AS covered,
      list_concat(string_split(v, ' '), flatten(list_transform(string_split(v, ' '), lambda p: list_concat(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)), list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substring(p, i, 3)))))) AS gv,
      list_concat(string_split(t, ' '), flatten(list_transform(string_split(t, ' '), lambda p: list_concat(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)), list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substring(p, i, 3)))))) AS gt FROM g),
    e AS (SELECT p_partkey, CASE WHEN contains(t, v) THEN 'correct' WHEN len(list_intersect(list_distinct(gv), list_distinct(gt))) / len(list_distinct(gv)) >= 0.2 THEN 'partial' ELSE 'not_mentioned' END AS scalar,
      CASE WHEN covered > 0 THEN covered ELSE len(list_filter(items, lambda i: len(list_intersect(list_concat([i], list_concat(list_transform(range(1, length(i)), lambda k: substring(i, k, 2)), list_transform(range(1, greatest(length(i) - 1, 1)), lambda k: substring(i, k, 3)))), gt)) > 0)) END / len(items) AS share FROM c)
    SELECT p_partkey, scalar, CASE WHEN share >= 0.8 THEN 'correct' WHEN share > 0 THEN 'partial' ELSE 'not_mentioned' END AS listed FROM e""",
)
def _(s, d):
    said = F.concat_ws(" ", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.reverse("p_name")))
    none = F.array().cast("array<string>")
    return table(s, d, "part").select("p_partkey", kpi.field_verdict(F.col("p_name"), none, said).alias("scalar"), kpi.field_verdict(F.lit(None), F.split("p_name", " "), said).alias("listed"))


@query(
    "kpi3_accuracy_completeness",
    """WITH f AS (SELECT o_custkey AS brand, CASE o_orderpriority WHEN '1-URGENT' THEN 'official_name' WHEN '5-LOW' THEN 'forbidden_claims' ELSE o_orderpriority END AS field, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'partial' ELSE 'not_mentioned' END AS verdict FROM orders)
    SELECT brand, count(*) FILTER (verdict = 'correct') AS n_correct, count(*) FILTER (verdict <> 'not_mentioned') AS n_mentioned,
      CASE WHEN count(*) FILTER (verdict <> 'not_mentioned') > 0 THEN round(count(*) FILTER (verdict = 'correct') / count(*) FILTER (verdict <> 'not_mentioned'), 4) ELSE 0.0 END AS accuracy_rate,
      CASE WHEN count(*) FILTER (field <> 'forbidden_claims') > 0 THEN round(count(*) FILTER (field <> 'forbidden_claims' AND verdict = 'correct') / count(*) FILTER (field <> 'forbidden_claims'), 4) ELSE 0.0 END AS completeness_rate FROM f GROUP BY 1""",
)
def _(s, d):
    field = F.when(F.col("o_orderpriority") == "1-URGENT", "official_name").when(F.col("o_orderpriority") == "5-LOW", "forbidden_claims").otherwise(F.col("o_orderpriority"))
    verdict = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "partial").otherwise("not_mentioned")
    return kpi.accuracy(table(s, d, "orders").select(F.col("o_custkey").alias("brand"), field.alias("field"), verdict.alias("verdict")), ["brand"])


@query(
    "kpi12_competitor_matrix",
    """WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1)
    SELECT a.c_custkey AS brand, b.c_custkey AS competitor, l.price, l.priority FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 OR b.c_custkey = a.c_custkey + 7 LEFT JOIN l ON l.o_custkey = b.c_custkey WHERE a.c_mktsegment = b.c_mktsegment""",
)
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    sets = c.select(F.col("c_custkey").alias("brand"), F.col("c_mktsegment").alias("segment"), F.explode(F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 7)).alias("competitor"))
    latest = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_totalprice", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    same = sets.join(c.select(F.col("c_custkey").alias("competitor"), F.col("c_mktsegment").alias("segment")), ["competitor", "segment"])
    return same.join(latest, same.competitor == latest.o_custkey, "left").select("brand", "competitor", F.col("r.o_totalprice").alias("price"), F.col("r.o_orderpriority").alias("priority"))


@query(
    "kpi14_mapping_check",
    "SELECT source AS kpi, count(*) AS n, count(*) FILTER (doc_id % 4 = 3) AS n_bad_mode, count(*) - count(DISTINCT lang) AS n_twice FROM documents GROUP BY 1",
)
def _(s, d):
    # a document is an entry of the mapping: its source the KPI, its language the question type; every fourth mode is unknown
    mode = F.element_at(F.array(*[F.lit(m) for m in ("allowed", "conditional", "excluded", "sometimes")]), (F.col("doc_id") % 4 + 1).cast("int"))
    m = table(s, d, "documents").select(F.col("source").alias("kpi"), F.col("lang").alias("question_type"), mode.alias("mode"))
    bad = F.count_if(~F.col("mode").isin("allowed", "conditional", "excluded"))
    return m.groupBy("kpi").agg(F.count("*").alias("n"), bad.alias("n_bad_mode"), (F.count("*") - F.countDistinct("question_type")).alias("n_twice"))


@query(
    "kpi15_health_score",
    """WITH k AS (SELECT user_id, count(*) AS sample_size, count(*) FILTER (event_type = 'error' AND value > 150) AS n_p0, count(*) FILTER (event_type = 'click') / count(*) AS sov, count(*) FILTER (event_type = 'view') / count(*) AS citation_rate,
      CASE WHEN count(*) FILTER (event_type = 'purchase') > 12 THEN count(*) FILTER (event_type = 'purchase') / count(*) END AS accuracy_rate FROM events GROUP BY 1),
    w AS (SELECT *, 0.15 + 0.20 + CASE WHEN accuracy_rate IS NULL THEN 0 ELSE 0.25 END AS w FROM k),
    s AS (SELECT *, round(least(100, greatest(0, round(sov * 0.15::DOUBLE / w::DOUBLE * 100, 1) + round(citation_rate * 0.20::DOUBLE / w::DOUBLE * 100, 1) + coalesce(round(accuracy_rate * 0.25::DOUBLE / w::DOUBLE * 100, 1), 0) - least(n_p0 * 5, 15) - CASE WHEN citation_rate < 0.2 THEN 5 ELSE 0 END)), 1) AS points FROM w)
    SELECT user_id, round_even(points, 0)::BIGINT AS score, CASE WHEN points >= 80 THEN 'healthy' WHEN points >= 60 THEN 'watch' WHEN points >= 40 THEN 'act' ELSE 'risk' END AS grade, 'low' AS confidence FROM s""",
)
def _(s, d):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    n = F.count("*")
    k = table(s, d, "events").groupBy("user_id").agg(n.alias("sample_size"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("n_p0"), (of("click") / n).alias("sov"), (of("view") / n).alias("citation_rate"), F.when(of("purchase") > 12, of("purchase") / n).alias("accuracy_rate"))
    return kpi.health(k).select("user_id", "score", "grade", "confidence")


@query("kpi16_dashboard_health", "SELECT source, round((round(count(*) FILTER (contains(text, 'the')) * 100 / count(*)) + round(count(*) FILTER (contains(text, 'and')) * 100 / count(*)) + round(count(*) FILTER (contains(text, 'of')) * 100 / count(*))) / 3, 4) AS health FROM documents GROUP BY 1")
def _(s, d):
    shown = sum((F.round(F.count_if(F.contains("text", F.lit(w))) * 100 / F.count("*")) for w in ("the", "and", "of")), F.lit(0.0))
    return table(s, d, "documents").groupBy("source").agg(F.round(shown / 3, 4).alias("health"))
