"""Queries of the rule operators: industries, report and template checks, platform health, field verification, detection, state folds.

The driver's tables hold no brands, so columns of ``part``, ``documents`` and ``events`` stand in, with words that reach every branch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import claims as C
from answerscope.operators import evidence as E
from answerscope.operators import industry as I
from answerscope.operators import nested
from answerscope.operators import quality as Q
from answerscope.operators import terms as TE
from answerscope.plans.registry import query, table
from answerscope.sources import answer_source
from answerscope.streaming import flows, folds

# --- industries --------------------------------------------------------------

SIGNALS = {
    "makers": {"brand_name": ("widget", "gear"), "product": ("EC", "CO", "NO", "OM", "MY"), "scenario": ("#1",), "competitor": ("#13", "#11"), "gt_field": ("cold",), "business_model": ("b2b", "PROMO")},
    "shops": {"brand_name": ("bolt",), "product": ("PRO", "OMO", "retail"), "scenario": ("#2", "#21"), "competitor": ("#2",), "gt_field": ("small", "bolt"), "business_model": ("retail",)},
    "schools": {"brand_name": (), "product": ("STANDARD",), "scenario": ("#3", "#4", "#5"), "competitor": (), "gt_field": ("large",), "business_model": ("ECONOMY",)},
    "homes": {"brand_name": ("panel", "valve"), "product": ("SMALL", "MED"), "scenario": ("#9",), "competitor": ("#19",), "gt_field": ("hot", "large"), "business_model": ()},
}
NAMES = {"makers": "制造", "shops": "零售", "schools": "教育"}
SITES = ("", "hardware b2b retail", "Subscription software", "b2b")


def industry_sql() -> str:
    where = {"brand_name": "brand_name", "product": "product", "scenario": "scenarios", "competitor": "competitors", "business_model": "product"}
    rows = []
    for position, (slug, words) in enumerate(SIGNALS.items()):
        each = []
        for kind, (points, most) in I.POINTS.items():
            test = "list_contains(gt_fields, w)" if kind == "gt_field" else f"contains({where[kind]}, w)"
            some = ", ".join(f"'{w}'" for w in words[kind])
            each.append(f"{{'signal': '{kind}', 'points': least(len(list_filter([{some}]::VARCHAR[], lambda w: {test})) * {points}, {most})::INT}}")
        rows.append(f"(SELECT {{'o': -coalesce(list_sum(list_transform(k, lambda s: s.points)), 0)::INT, 'p': {position}, 'slug': '{slug}', 'signals': k}} FROM (SELECT list_filter([{', '.join(each)}], lambda s: s.points > 0) AS k))")
    site = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SITES)) + " END"
    name = "CASE slug " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE slug END"
    labels = "CASE s.signal " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.LABELS.items()) + " END"
    tags = ", ".join(f"'{t}'" for t in I.TAGS)
    return f"""WITH b AS (SELECT p_partkey, p_name AS brand_name, p_type AS products, p_brand AS scenarios, p_brand AS competitors, string_split(p_name, ' ') AS gt_fields, {site} AS site FROM part),
    t AS (SELECT *, concat(products, ' ', site, ' ', array_to_string(gt_fields, ' ')) AS product FROM b),
    r AS (SELECT p_partkey, products, site, list_sort([{', '.join(rows)}]) AS r FROM t),
    k AS (SELECT *, -r[1].o AS top, r[2].o - r[1].o AS lead, r[1].slug AS slug, r[1].signals AS signals, list_filter(r[2:4], lambda x: -x.o > 30) AS others, lower(concat(products, ' ', site)) AS low FROM r),
    c AS (SELECT *, CASE WHEN top >= 300 AND lead >= 150 THEN 'high' WHEN top >= 150 AND lead >= 50 THEN 'medium' ELSE 'low' END AS conf, {name} AS name FROM k)
    SELECT p_partkey, CASE WHEN top >= 50 THEN slug ELSE 'unknown' END AS "primary", CASE WHEN top >= 50 THEN name ELSE '未知行业' END AS primary_name, CASE WHEN top >= 50 THEN conf ELSE 'low' END AS confidence, top / 1000.0::DOUBLE AS score,
      CASE WHEN top >= 50 THEN array_to_string(list_transform(list_filter(others[1:2], lambda x: -x.o > 50), lambda x: x.slug), ',') ELSE '' END AS secondary,
      CASE WHEN top >= 50 THEN array_to_string(list_transform(others, lambda x: x.slug), ',') ELSE '' END AS alternatives,
      CASE WHEN top >= 50 THEN array_to_string(list_transform(signals, lambda s: s.signal || '=' || s.points), ',') ELSE '' END AS evidence,
      NOT (top >= 50 AND conf = 'high') AS needs_confirmation,
      CASE WHEN top >= 50 THEN array_to_string(list_filter([{tags}], lambda t: contains(low, t))[1:8], ',') ELSE '' END AS tags,
      CASE WHEN top >= 50 THEN printf('品牌%s等信号匹配%s行业。置信度得分 %.2f。', array_to_string(list_transform(signals[1:3], lambda s: {labels}), ','), name, top / 1000.0) ELSE '{I.TOO_WEAK}' END AS reason FROM c"""


@query("c29_industry_classifier", industry_sql())
def _(s, d):
    site = F.element_at(F.array(*[F.lit(x) for x in SITES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    brands = table(s, d, "part").select(
        "p_partkey", F.col("p_name").alias("brand_name"), F.col("p_type").alias("products"), F.col("p_brand").alias("scenarios"), F.col("p_brand").alias("competitors"),
        F.split("p_name", " ").alias("gt_fields"), site.alias("official_site"),
    )
    lists = ("secondary", "alternatives", "evidence", "tags")
    out = I.classify(brands, SIGNALS, NAMES)
    return out.select("p_partkey", "primary", "primary_name", "confidence", "score", *[F.array_join(c, ",").alias(c) for c in lists], "needs_confirmation", "reason")


# --- terms -------------------------------------------------------------------


@query(
    "c11_term_hits",
    """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark), t AS (SELECT term FROM w WHERE length(term) >= 6)
    SELECT doc_id, term, ((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS n, (strpos(text, term) - 1)::BIGINT AS first FROM documents JOIN t ON contains(text, term)""",
)
def _(s, d):
    # every word of the benchmark of six letters or more, in every document; of one word no two places overlap
    words = table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where(F.length("term") >= 6).distinct()
    found = TE.with_hits(table(s, d, "documents").select("doc_id", "text"), "text", words.withColumn("group", F.lit("benchmark")))
    return found.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", F.col("h.term").alias("term")).agg(F.count("*").alias("n"), F.min("h.at").cast("long").alias("first"))


FLAGS = {"absolute_claim": ("best", "ing", "100%"), "ad_tone": ("icense", "token"), "sensitive_medical": ("idiot",), "sensitive_financial": ("scum", "heit")}


def compliance_sql() -> str:
    body = "CASE WHEN doc_id % 3 > 0 THEN coalesce(text, '') ELSE lang || ' ' || coalesce(source, '') END"
    flags = " || ".join(f"list_transform(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(b, w)), lambda w: '{kind}:' || w || ':{TE.SEVERITY.get(kind, 'high')}')" for kind, words in FLAGS.items())
    return f"""WITH b AS (SELECT doc_id, {body} AS b, doc_id % 5 = 0 AND doc_id % 2 = 0 AS missing FROM documents), f AS (SELECT doc_id, {flags} || CASE WHEN missing THEN ['reference_required:百科类内容缺少参考资料:high'] ELSE [] END AS f FROM b)
    SELECT doc_id, array_to_string(f, ',') AS flags, len(list_filter(f, lambda x: x LIKE '%:high'))::INT AS high_count, CASE WHEN len(list_filter(f, lambda x: x LIKE '%:high')) > 0 THEN 'blocked' WHEN len(f) > 0 THEN 'needs_review' ELSE 'passed' END AS status FROM f"""


@query("x12_compliance_flags", compliance_sql())
def _(s, d):
    k = F.col("doc_id")
    variants = table(s, d, "documents").select(
        k, F.when(k % 5 == 0, "baike").otherwise("web").alias("target_type"), F.when(k % 3 > 0, F.col("text")).alias("body_markdown"), F.concat_ws(" ", "lang", F.coalesce("source", F.lit(""))).alias("markdown"),
        F.lit(None).cast("map<string,string>").alias("infobox"), F.lit(None).cast("array<struct<title: string, content: string>>").alias("sections"), (k % 2).cast("int").alias("n_references"),
    )
    variants = variants.withColumn("markdown", F.when(k % 3 > 0, "").otherwise(F.col("markdown")))
    out = TE.compliance(variants, FLAGS)
    return out.select("doc_id", F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["type"], f["text"], f["severity"])), ",").alias("flags"), "high_count", "status")


@query("f26_customer_terms")
def _(s, d):
    # replacement outside of code, URLs, quotes and paths, which SQL has no regions for; tests hold it against a loop
    swaps = {"the": "THE", "then": "THEN", "on": "ON", "pache": "PACHE", "http": "HTTP"}
    out = TE.replaced(table(s, d, "documents").select("doc_id", "text"), "text", swaps, "explain_first")
    return out.select("doc_id", F.sha2("replaced", 256).alias("replaced_sha256"), F.length("replaced").alias("n_chars"))


# --- reports and templates ---------------------------------------------------

ABSOLUTE, TECHNICAL = ("idiot", "clown", "icense", "####", "100%"), ("http", "The", "ation", "heit")
PARTS = {"executive": ("on", "er", "The "), "implementation": ("the", "Apache"), "customer": ("de", "und", "ing", "!!")}


def report_sql() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    needed = "CASE edition " + " ".join(f"WHEN '{k}' THEN {lists(v)}" for k, v in PARTS.items()) + " ELSE []::VARCHAR[] END"
    marks = lambda t: f"(length({t}) - length(replace({t}, '```', ''))) // 3"
    before = "substring(t, 1, instr(t, w) - 1)"
    outside = f"instr(t, w) > 0 AND NOT ({marks(before)} % 2 = 1 AND contains(substring(t, instr(t, w)), '```')) AND NOT regexp_matches({before}, 'https?://\\S*$')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE doc_id % 4 WHEN 0 THEN 'executive' WHEN 1 THEN 'implementation' WHEN 2 THEN 'customer' ELSE 'other' END AS edition FROM documents),
    v AS (SELECT doc_id, list_transform(list_filter({lists(ABSOLUTE)}, lambda w: contains(t, w)), lambda w: 'forbidden_absolute_terms:' || w) AS a,
      CASE WHEN contains(t, '{{{{') OR contains(t, '}}}}') THEN ['empty_placeholder'] ELSE []::VARCHAR[] END AS b,
      list_transform(list_filter({needed}, lambda w: NOT contains(t, w)), lambda w: 'missing_section:' || w) AS c,
      CASE WHEN edition = 'executive' THEN list_transform(list_filter({lists(TECHNICAL)}, lambda w: {outside}), lambda w: 'technical_term_in_executive:' || w) ELSE []::VARCHAR[] END AS e,
      CASE WHEN edition = 'implementation' AND NOT (contains(t, '|') AND contains(t, '{Q.ASSETS}')) THEN ['missing_action_table'] ELSE []::VARCHAR[] END AS f,
      CASE WHEN edition = 'customer' AND (length(t) - length(replace(t, '{Q.EXPLAINED}', ''))) // 3 < 3 THEN ['few_kpi_explanations'] ELSE []::VARCHAR[] END AS g FROM d),
    s AS (SELECT *, 100 - 5 * len(a) - 10 * len(b) - 10 * len(c) - 5 * len(e) - 15 * len(f) - 10 * len(g) AS score FROM v)
    SELECT doc_id, array_to_string(a || b || c || e || f || g, ',') AS violations, score::INT AS report_score, CASE WHEN score >= 80 THEN 'passed' WHEN score >= 60 THEN 'warning' ELSE 'failed' END AS report_status FROM s"""


@query("q7_report_score", report_sql())
def _(s, d):
    k = F.col("doc_id") % 4
    edition = F.when(k == 0, "executive").when(k == 1, "implementation").when(k == 2, "customer").otherwise("other")
    checked = Q.check_reports(table(s, d, "documents").select("doc_id", "text", edition.alias("edition")), ABSOLUTE, TECHNICAL, PARTS)
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"), "report_score", "report_status")


BODIES = ("", "{品牌} 的 {品类} 怎么样", "{品牌} 与 {竞品}", "哪种 {unknown} 最好", "{行业} 推荐 {odd} {场景}", "long")
KINDS = (*Q.QUESTION_KPIS, "odd_type")
KPIS = ((), ("sov", "citation_rate"), ("information_accuracy", "odd_kpi", "sov"), ("first_rec_rate",))


def templates(s, d):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    body = pick(BODIES, k)
    kpis = F.element_at(F.array(*[Q.strings(v) for v in KPIS]), (size % 4 + 1).cast("int"))
    return table(s, d, "part").select(
        "p_partkey", F.when(body == "long", F.repeat(F.lit("x"), F.lit(Q.LONGEST_TEMPLATE + 1))).otherwise(body).alias("template_text"), pick(KINDS, size).alias("question_type"),
        pick((*Q.LEVELS, "odd_level"), k).alias("template_level"), pick((*Q.SCOPES, "odd_scope", ""), k).alias("question_scope"), ((size % 6) / 4.0).cast("double").alias("brand_directed"),
        kpis.alias("metric_eligibility"), F.array(F.lit("a"), F.concat(F.lit("b"), (size % 3).cast("string"))).alias("applicable"), F.array(F.lit("b1")).alias("excluded"),
    )


def template_sql() -> str:
    pick = lambda values, by: f"[{', '.join(repr(v) for v in values)}][{by} % {len(values)} + 1]"
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    part = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {lists(v[i])}" for k, v in Q.QUESTION_KPIS.items()) + " ELSE []::VARCHAR[] END"
    code = lambda name, cond: f"CASE WHEN {cond} THEN ['{name}'] ELSE []::VARCHAR[] END"
    fields = "CASE v " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in Q.VARIABLES.items()) + " END"
    errors = " || ".join((
        code("TEMPLATE_TOO_LONG", f"length(t) > {Q.LONGEST_TEMPLATE}"), code("INVALID_QTYPE", f"kind NOT IN {tuple(Q.QUESTION_KPIS)}"), code("INVALID_LEVEL", f"level NOT IN {Q.LEVELS}"),
        code("INVALID_BRAND_DIRECTED", f"directed NOT IN {Q.DIRECTED}"), f"list_transform(list_filter(vars, lambda v: {fields} IS NULL), lambda v: 'UNKNOWN_VARIABLE')",
        "list_transform(list_filter(kpis, lambda k: list_contains(excludes, k)), lambda k: 'KPI_QTYPE_MISMATCH')", code("INDUSTRY_CONFLICT", "list_has_any(apps, ['b1'])"),
    ))
    warnings = " || ".join((
        code("INVALID_SCOPE", f"scope <> '' AND scope NOT IN {Q.SCOPES}"), code("CRITICAL_NO_BRAND_VAR", "level = 'critical' AND NOT list_contains(vars, '品牌')"),
        code("SCOPE_DIRECTED_MISMATCH", "scope = 'brand_directed' AND directed < 0.5"), "list_transform(list_filter(kpis, lambda k: NOT list_contains(excludes || suits || allows, k)), lambda k: 'KPI_NOT_RECOMMENDED')",
    ))
    kpis = f"[{', '.join(lists(v) for v in KPIS)}][p_size % 4 + 1]"
    return f"""WITH p AS (SELECT p_partkey, {pick(BODIES, 'p_partkey')} AS b, {pick(KINDS, 'p_size')} AS kind, {pick((*Q.LEVELS, 'odd_level'), 'p_partkey')} AS level, {pick((*Q.SCOPES, 'odd_scope', ''), 'p_partkey')} AS scope, (p_size % 6) / 4.0::DOUBLE AS directed, {kpis} AS kpis, ['a', 'b' || (p_size % 3)] AS apps FROM part),
    t AS (SELECT *, CASE WHEN b = 'long' THEN repeat('x', {Q.LONGEST_TEMPLATE + 1}) ELSE b END AS t FROM p),
    v AS (SELECT *, regexp_extract_all(t, '\\{{([^{{}}]+)\\}}', 1) AS vars, {part(0)} AS suits, {part(1)} AS allows, {part(2)} AS excludes FROM t),
    c AS (SELECT p_partkey, vars, CASE WHEN trim(t) = '' THEN ['EMPTY_TEMPLATE'] ELSE {errors} END AS e, CASE WHEN trim(t) = '' THEN []::VARCHAR[] ELSE {warnings} END AS w FROM v)
    SELECT p_partkey, array_to_string(e, ',') AS errors, array_to_string(w, ',') AS warnings, len(e) = 0 AS valid, array_to_string(vars, ',') AS variables, array_to_string(list_sort(list_distinct(list_filter(list_transform(vars, lambda v: {fields}), lambda f: f IS NOT NULL))), ',') AS required_fields FROM c"""


@query("c27_template_codes", template_sql())
def _(s, d):
    lists = ("errors", "warnings", "variables", "required_fields")
    return Q.check_templates(templates(s, d)).select("p_partkey", "valid", *[F.array_join(c, ",").alias(c) for c in lists])


# --- platforms and field verification ----------------------------------------


@query(
    "x4_platform_health",
    """WITH e AS (SELECT user_id % 7 AS platform, ts, value, event_type, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 7 = 2 THEN 'platform_rate_limited' ELSE 'code' || (event_id % 3) END END AS code, ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR * 1 AS recent FROM (SELECT event_id, user_id, value, event_type, TIMESTAMP '2024-01-01' + (ts - TIMESTAMP '2024-01-01') / 1000 AS ts FROM events)),
    m AS (SELECT max(ts) AS now FROM e), g AS (SELECT platform, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS total, count(*) FILTER (ts >= now - INTERVAL 1 HOUR AND event_type <> 'error') AS ok, count(*) FILTER (ts >= now - INTERVAL 1 HOUR AND code = 'platform_rate_limited') AS limited, max(event_type) AS x FROM e, m GROUP BY 1)
    SELECT p.i AS platform, CASE WHEN p.i = 3 THEN 'disabled' WHEN coalesce(total, 0) > 0 AND limited > 5 THEN 'rate_limited' WHEN coalesce(total, 0) > 0 AND (total - ok) / total > 0.3 THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN p.i = 3 THEN '未启用' ELSE '' END AS disabled_reason, coalesce(total, 0) AS total_1h, coalesce(limited, 0) AS limited_1h, (SELECT arg_max(code, ts) FROM e WHERE e.platform = p.i AND event_type = 'error') AS last_error_code
    FROM range(9) p(i) LEFT JOIN g ON g.platform = p.i""",
)
def _(s, d):
    e = table(s, d, "events")
    # the month of events is squeezed by a thousand, so that the last hour holds many
    at = F.expr("timestamp_micros(unix_micros(timestamp '2024-01-01') + cast(floor((unix_micros(cast(ts as timestamp)) - unix_micros(timestamp '2024-01-01')) / 1000.0) as bigint))")
    code = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 7 == 2, "platform_rate_limited").otherwise(F.concat(F.lit("code"), (F.col("event_id") % 3).cast("string"))))
    results = e.select((F.col("user_id") % 7).alias("platform"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("value").alias("latency_ms"), code.alias("error_code"), at.alias("collected_at"))
    now = results.agg(F.max("collected_at").alias("now")).first()["now"]
    platforms = s.range(9).select(F.col("id").alias("platform"), (F.col("id") != 3).alias("enabled"), F.lit(None).cast("string").alias("disabled_reason"))
    return Q.platform_health(results, platforms, F.lit(now)).select("platform", "status", "disabled_reason", "total_1h", "limited_1h", "last_error_code")


@query(
    "c35_field_verification",
    """WITH v AS (SELECT p_partkey::VARCHAR AS brand, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'official_name' ELSE 'core_products' END AS field, p_name AS value, p_size FROM part),
    r AS (SELECT v.*, q AS n, i AS rank, CASE (k + q * 2 + i * p_size) % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'D' END AS tier, CASE (k + q + i + p_size) % 6 WHEN 0 THEN 'the ' || value || ' of all' WHEN 1 THEN string_split(value, ' ')[1] || ' thing' ELSE 'no word in common' END AS snippet FROM v, range(1, 5) a(q), range(1, 7) b(i) WHERE (k + q) % 3 > 0 OR i = 1),
    m AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(value), '\\w+')), list_distinct(regexp_extract_all(lower(snippet), '\\w+')))) / len(list_distinct(regexp_extract_all(lower(value), '\\w+'))) AS share, contains(lower(snippet), lower(value)) AS inside FROM r WHERE n <= 3 AND rank <= 5 AND tier <> 'D'),
    h AS (SELECT *, CASE WHEN field = 'official_name' THEN inside OR share >= 0.5 ELSE share >= 0.4 END AS hit, CASE WHEN field = 'official_name' AND inside THEN 0.9 ELSE round(share, 3) END AS score FROM m),
    g AS (SELECT k, count(*) FILTER (hit AND tier = 'S') AS s, count(*) FILTER (hit AND tier = 'A') AS a, count(*) FILTER (hit AND tier = 'B') AS b, count(*) FILTER (hit AND tier = 'C') AS c, round(avg(score) FILTER (hit AND tier <> 'C'), 3) AS score FROM h GROUP BY 1)
    SELECT brand, field, CASE WHEN s > 0 THEN 'A' WHEN a + b > 0 THEN 'B' ELSE 'C' END AS validated_tier, CASE WHEN s > 0 THEN 'confirmed_strong' WHEN a > 0 AND a + b >= 2 THEN 'confirmed_multi' WHEN a > 0 THEN 'confirmed_strong' WHEN b >= 2 THEN 'confirmed_multi' WHEN b = 1 THEN 'confirmed_single' WHEN c > 0 THEN 'weak_support' ELSE 'unconfirmed' END AS validation_status, coalesce(CASE WHEN s + a + b > 0 THEN score END, 0.0) AS match_score FROM v LEFT JOIN g USING (k)""",
)
def _(s, d):
    k = F.col("p_partkey")
    values = table(s, d, "part").select(k.cast("string").alias("brand"), F.when(k % 2 == 0, "official_name").otherwise("core_products").alias("field"), F.col("p_name").alias("value"), k.alias("k"), "p_size")
    n, rank, size = F.col("n"), F.col("rank"), F.col("p_size")
    asked = values.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(6)))).where(((F.col("k") + n) % 3 > 0) | (rank == 1))
    tier = F.element_at(F.array(*[F.lit(x) for x in "SABCD"]), ((F.col("k") + n * 2 + rank * size) % 5 + 1).cast("int"))
    said = (F.col("k") + n + rank + size) % 6
    snippet = F.when(said == 0, F.concat(F.lit("the "), "value", F.lit(" of all"))).when(said == 1, F.concat(F.split("value", " ")[0], F.lit(" thing"))).otherwise("no word in common")
    results = asked.select("brand", "field", "n", "rank", F.lit("https://example.com").alias("url"), snippet.alias("snippet"), tier.alias("tier"))
    return E.verify_fields(values.select("brand", "field", "value"), results).select("brand", "field", "validated_tier", "validation_status", "match_score")


@query("c35_search_queries", """SELECT p_partkey::VARCHAR AS brand, 'founded_year' AS field, n, CASE n WHEN 1 THEN p_partkey || ' 成立时间' WHEN 2 THEN p_partkey || ' founded ' || p_size ELSE p_partkey || ' company history ' || p_size END AS query FROM part, range(1, 4) r(n)""")
def _(s, d):
    values = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("brand"), F.lit("founded_year").alias("field"), F.col("p_size").cast("string").alias("value"))
    return E.search_queries(values).withColumn("n", F.col("n").cast("long"))


# --- detection ---------------------------------------------------------------

DETECT = {"industry": ("ation", "heit"), "positioning": ("the of", "der die"), "official_name": ("Onthe", "Die")}


@query("c7_detect")
def _(s, d):
    # natures and near misses are beyond SQL; tests hold the chain against its stages and known outcomes
    brand = (F.col("item_id") % 3).cast("string")
    answers = table(s, d, "benchmark").select(F.col("item_id").alias("answer_id"), brand.alias("brand"), F.col("text").alias("answer_text"), F.array(F.lit("The"), F.lit("Die")).alias("names"), F.array(F.lit("clown")).alias("competitors"), F.lit("fintech").alias("industry"))
    facts = s.createDataFrame([("0", "industry", "the information of the nation"), ("1", "industry", "a nation's station"), ("1", "positioning", "the of")], "brand string, field string, fact string")
    return C.detect(answers, facts, DETECT, ("ation",), "[.\n]+")


# --- state folds as streams --------------------------------------------------


def requests(s, d):
    """Events as requests to tasks: moves, locks, heartbeats and progress in turn."""
    e = flows.read(s, f"{d}/events.parquet")
    k = F.col("event_id") % 8
    moves = F.element_at(F.array(*[F.lit(x) for x in ("running", "retrying", "running", "completed", "failed", "dead_lettered", "requeued", "queued")]), (F.floor(F.col("value")) % 8 + 1).cast("int"))
    action = F.when(k < 4, "move").when(k == 4, "lock").when(k == 5, "heartbeat").when(k == 6, "progress").otherwise("release")
    arg = F.when(k < 4, moves).otherwise(F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")))
    return e.select(F.col("user_id").alias("task"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("second"), action.alias("action"), arg.alias("arg"), (F.floor(F.col("value")) % 100 / 100.0).cast("double").alias("pct"))


@query("st6_task_lifecycle")
def _(s, d):
    # folds with feedback, here and below: tests hold them against plain loops
    return flows.drained(folds.task_states(requests(s, d)))


def readings(s, d):
    e = flows.read(s, f"{d}/events.parquet")
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind.isin("view", "click"), "warning")
    return e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("id"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("hour"), severity.alias("severity"), F.col("value").cast("double").alias("value"))


@query("st11_alert_lifecycle")
def _(s, d):
    return flows.drained(folds.alert_states(readings(s, d)))


def platform_requests(s, d):
    e = flows.read(s, f"{d}/events.parquet")
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) / 600.0
    return e.select((F.col("user_id") % 5).alias("platform"), F.col("event_id").alias("id"), second.cast("double").alias("second"), F.col("event_type").isin("error", "view").alias("limited"), (F.col("value") % 120).cast("double").alias("retry_after"))


@query("st3_limiter_cooldown")
def _(s, d):
    return flows.drained(folds.limiter_states(platform_requests(s, d), most_per_minute=20))


# --- nested JSON, signatures, the answer source ------------------------------


@query(
    "f24_masked_tree",
    """SELECT event_id, '{"inner":{"apiKey":"***REDACTED***","type":"' || event_type || '"},"list":[{"k":' || json_extract_string(props, '$.k') || ',"user_token":"***REDACTED***"}],"password":"***REDACTED***"}' AS masked FROM events""",
)
def _(s, d):
    inner = F.struct(F.lit("x").alias("apiKey"), F.col("event_type").alias("type"))
    one = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit("t").alias("user_token"))
    return table(s, d, "events").select("event_id", nested.masked(F.to_json(F.struct(F.lit(1).alias("password"), inner.alias("inner"), F.array(one).alias("list")))).alias("masked"))


@query(
    "c30_resolved_layers",
    """SELECT c_custkey, '{"hallucination_thresholds":{"ratio":' || CASE WHEN c_custkey % 3 = 0 THEN '0.9' WHEN c_nationkey % 2 = 0 THEN '0.7' ELSE '0.5' END || ',"steps":' || CASE WHEN c_nationkey % 2 = 0 THEN '[3]' ELSE '[1,2]' END || '},"kpi_weights":{' ||
      CASE WHEN c_custkey % 3 = 0 THEN '"own":1' WHEN c_nationkey % 2 = 0 THEN '"a":0.6,"b":0.5' ELSE '"a":0.5,"b":0.5' END || '}}' AS config FROM customer""",
)
def _(s, d):
    default = F.lit('{"kpi_weights":{"a":0.5,"b":0.5},"hallucination_thresholds":{"ratio":0.5,"steps":[1,2]}}')
    industry = F.when(F.col("c_nationkey") % 2 == 0, '{"kpi_weights":{"a":0.6},"hallucination_thresholds":{"ratio":0.7,"steps":[3]}}')
    brand = F.when(F.col("c_custkey") % 3 == 0, '{"kpi_weights":{"own":1},"hallucination_thresholds":{"ratio":0.9}}')
    return table(s, d, "customer").select("c_custkey", nested.resolved(default, industry, brand).alias("config"))


# HMAC has no SQL here; tests hold it against published vectors and Python's own
@query("f20_signatures")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.webhook_signature(F.col("html"), F.concat(F.lit("secret-"), "page_id"), F.col("page_id")).alias("signature"))


@query(
    "s3_answer_source",
    """SELECT n_name AS question, p AS platform, true AS asked, '[MOCK ' || p || '] ' || n_nationkey AS answer_text FROM nation, (SELECT unnest(['a', 'b', 'c']) AS p)""",
)
def _(s, d):
    answer_source.register(s)
    asked = table(s, d, "nation")
    n = asked.agg(F.max("n_nationkey")).first()[0] + 1
    answers = s.read.format("answers").options(platforms="a,b,c,d", questions=n, mode="success").load().where("platform <> 'd' and platform in ('a', 'b', 'c')")
    return asked.join(answers, asked["n_nationkey"] == answers["question_no"]).select(F.col("n_name").alias("question"), "platform", F.col("status").isNotNull().alias("asked"), "answer_text")
