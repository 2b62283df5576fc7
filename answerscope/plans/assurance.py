"""Queries of the operators that judge whether results may go out: sample sufficiency, report quality, gaps to rivals.

The driver's tables hold no runs or brands: customers are runs, their orders the answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.operators import benchmark as B
from answerscope.operators import report_gate as G
from answerscope.operators import rivals as V
from answerscope.operators import sufficiency as S
from answerscope.plans.registry import query, table

# --- sample sufficiency ------------------------------------------------------

NEEDS = S.Needs(total=5, platforms=2, per_platform=1, per_type=1, per_kpi=1, by_platform={"2-HIGH": 2}, by_type={"EUROPE": 2}, by_kpi={"sov": 2}, critical_platforms=("1-URGENT",), critical_types=("EUROPE",), critical_kpis=("sov", "citation"))

SUFFICIENCY = f"""WITH a AS (SELECT o_custkey AS run, o_orderpriority AS platform, o_custkey % 10 > 0 AND (o_orderstatus <> 'P' OR o_orderkey % 2 = 0) AS success,
      CASE WHEN o_orderkey % 11 = 0 THEN 'content_filtered' WHEN o_orderkey % 7 = 0 THEN 'slow' END AS code, CASE o_orderkey % 29 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'broken' ELSE '' END AS message,
      CASE o_orderkey % 17 WHEN 0 THEN '   ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'text' END AS answer,
      coalesce(CASE WHEN v.n_nationkey % 6 > 0 THEN rv.r_name END, rt.r_name, 'unknown') AS type
      FROM orders LEFT JOIN nation v ON v.n_nationkey = o_orderkey % 40 LEFT JOIN region rv ON rv.r_regionkey = v.n_regionkey LEFT JOIN nation t ON t.n_nationkey = o_orderkey % 30 LEFT JOIN region rt ON rt.r_regionkey = t.n_regionkey),
    k AS (SELECT *, success AND coalesce(code, '') NOT IN ('content_filtered') AS fit FROM a),
    n AS (SELECT run, count(*) AS n_raw, count(*) FILTER (success) AS n_success, count(*) FILTER (fit AND trim(answer) <> '') AS n_valid FROM k GROUP BY 1),
    p AS (SELECT run, platform, count(*) FILTER (fit AND answer <> '') AS given, count(*) FILTER (contains(message, '429')) > 0 AS limited, CASE platform WHEN '2-HIGH' THEN 2 ELSE 1 END AS least FROM k GROUP BY ALL),
    ps AS (SELECT run, count(*) AS n_platforms, count(*) FILTER (given >= least AND NOT limited) AS n_ok, bool_or(given < least) AS some_low, coalesce(bool_or(platform = '1-URGENT' AND given >= least), false) AS urgent,
      max(CASE WHEN platform = '1-URGENT' AND given < least THEN 'platform:1-URGENT 样本不足: 实际' || given || ', 要求' || least END) AS block,
      string_agg(platform || '=' || CASE WHEN limited THEN 'rate_limited' WHEN given >= least THEN 'ok' WHEN given = 0 THEN 'no_valid_answer' ELSE 'insufficient' END, ',' ORDER BY platform) AS platforms FROM p GROUP BY 1),
    t AS (SELECT run, type, count(*) AS valid, CASE type WHEN 'EUROPE' THEN 2 ELSE 1 END AS least FROM k WHERE fit AND trim(answer) <> '' GROUP BY ALL),
    ts AS (SELECT run, bool_or(valid < least) AS some_low, max(CASE WHEN type = 'EUROPE' AND valid < least THEN 'qtype:EUROPE 样本不足: 实际' || valid || ', 要求' || least END) AS block, string_agg(type || '=' || valid, ',' ORDER BY type) AS types FROM t GROUP BY 1),
    d AS (SELECT o_custkey AS run, count(*) FILTER (o_orderstatus = 'F') AS sov, count(*) FILTER (o_orderstatus = 'O') AS citation FROM orders GROUP BY 1),
    j AS (SELECT c_custkey AS run, coalesce(n_raw, 0) AS n_raw, coalesce(n_success, 0) AS n_success, coalesce(n_valid, 0) AS n_valid, coalesce(n_platforms, 0) AS n_platforms, coalesce(n_ok, 0) AS n_ok, coalesce(ps.some_low OR ts.some_low, ps.some_low, false) AS some_low, coalesce(urgent, false) AS urgent,
      ps.block AS pb, ts.block AS tb, coalesce(platforms, '') AS platforms, coalesce(types, '') AS types, coalesce(sov, 0) AS sov, coalesce(citation, 0) AS citation
      FROM customer LEFT JOIN n ON n.run = c_custkey LEFT JOIN ps ON ps.run = c_custkey LEFT JOIN ts ON ts.run = c_custkey LEFT JOIN d ON d.run = c_custkey),
    s AS (SELECT *, CASE WHEN n_valid = 0 THEN 'no_data' WHEN n_valid < 5 OR n_ok < 2 OR tb IS NOT NULL OR sov < 2 OR citation < 1 OR NOT urgent THEN 'insufficient' WHEN some_low THEN 'partial' ELSE 'ok' END AS data_status,
      CASE WHEN n_valid = 0 THEN ['无成功 QueryResult'] ELSE list_filter([CASE WHEN n_valid < 5 THEN 'total 样本不足: 实际' || n_valid || ', 要求5' END, pb, tb, CASE WHEN citation < 1 THEN 'kpi:citation 样本不足: 实际' || citation || ', 要求1' END, CASE WHEN sov < 2 THEN 'kpi:sov 样本不足: 实际' || sov || ', 要求2' END], lambda b: b IS NOT NULL) END AS blocks FROM j)
    SELECT run, n_raw, n_success, n_valid, n_platforms, n_ok AS n_ok_platforms, platforms, types, data_status, array_to_string(blocks, '; ') AS blocks,
      CASE WHEN data_status = 'partial' THEN 'SAMPLE_PARTIAL_PLATFORM' ELSE '' END AS warnings,
      CASE WHEN n_valid = 0 THEN '{S.ALL_FAILED}' WHEN n_valid < 5 THEN '总有效样本不足, 实际' || n_valid || ', 要求5' ELSE '' END AS actions,
      CASE data_status WHEN 'insufficient' THEN '{S.TOO_LITTLE[0]}' || array_to_string(list_transform(blocks, lambda b: string_split(b, ' ')[1]), ', ') || '{S.TOO_LITTLE[1]}' WHEN 'no_data' THEN '{S.SUMMARIES["no_data"]}' WHEN 'partial' THEN '{S.SUMMARIES["partial"]}' ELSE '{S.SUMMARIES["ok"]}' END AS summary FROM s"""


@query("q12_sufficiency_assessment", SUFFICIENCY)
def _(s, d):
    orders, key = table(s, d, "orders"), F.col("o_orderkey")
    status = F.when((F.col("o_custkey") % 10 > 0) & ((F.col("o_orderstatus") != "P") | (key % 2 == 0)), "success").otherwise("failed")
    code = F.when(key % 11 == 0, "content_filtered").when(key % 7 == 0, "slow")
    message = F.when(key % 29 == 0, "HTTP 429").when(key % 29 == 1, "broken").otherwise("")
    answer = F.when(key % 17 == 0, "   ").when(key % 17 == 1, "").when(key % 17 > 2, "text")
    answers = orders.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("platform"), status.alias("status"), code.alias("error_code"), message.alias("error_message"), answer.alias("answer"), (key % 40).alias("version_id"), (key % 30).alias("template_id"))
    nations = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = lambda c, kind: nations.select(F.col("n_nationkey").alias(c), kind.alias("question_type"))
    versions = named("version_id", F.when(F.col("n_nationkey") % 6 > 0, F.col("r_name")).otherwise("unknown"))
    answers = S.question_types(answers, versions, named("template_id", F.col("r_name")))
    kpi = F.when(F.col("o_orderstatus") == "F", "sov").when(F.col("o_orderstatus") == "O", "citation")
    denominators = orders.groupBy(F.col("o_custkey").alias("run"), kpi.alias("kpi")).agg(F.count("*").alias("denominator"))
    a = S.assess(table(s, d, "customer").select(F.col("c_custkey").alias("run")), answers, denominators, NEEDS)
    shown = lambda items, *names: F.array_join(F.transform(items, lambda i: F.concat_ws("=", *[i[n].cast("string") for n in names])), ",")
    return a.select(
        "run", "n_raw", "n_success", "n_valid", "n_platforms", "n_ok_platforms", shown("platforms", "platform", "status").alias("platforms"), shown("types", "question_type", "valid").alias("types"), "data_status",
        F.array_join(F.transform("blocks", lambda b: b.message), "; ").alias("blocks"), F.array_join("warnings", ",").alias("warnings"), F.array_join(F.transform("actions", lambda x: x.reason), ",").alias("actions"), "summary",
    )


# --- report quality ----------------------------------------------------------
# Line items are claims, their suppliers the runs; a supplier's own columns say what is known of its templates and coverage.

CLAIMS = """(SELECT l_suppkey AS run, CASE l_orderkey % 8 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'gt_insufficient' WHEN 2 THEN 'generic_statement' WHEN 3 THEN 'not_about_brand' WHEN 4 THEN 'template_invalid' WHEN 5 THEN 'supported' ELSE 'contradicted' END AS verdict,
      CASE l_linenumber WHEN 1 THEN 'P0' WHEN 2 THEN 'P1' WHEN 3 THEN 'P2' END AS severity, CASE WHEN l_returnflag = 'N' THEN 'competitor' ELSE 'target_brand' END AS subject_type,
      CASE WHEN l_partkey % 10 < l_suppkey % 10 THEN 'speculation' WHEN l_partkey % 7 < l_suppkey % 7 THEN 'opinion' WHEN l_partkey % 5 < l_suppkey % 5 THEN NULL WHEN l_partkey % 5 = 4 THEN 'rumour' ELSE 'fact' END AS claim_type,
      CASE WHEN l_quantity < l_suppkey % 50 THEN CASE WHEN l_linestatus = 'F' THEN 'weak' ELSE 'insufficient_evidence' END WHEN l_quantity < 40 THEN 'strong' WHEN l_quantity < 45 THEN 'moderate' WHEN l_quantity < 48 THEN 'disputed' END AS strength,
      CASE WHEN l_suppkey % 4 = 0 AND l_discount > 0.05 THEN 'critical_conflict' WHEN l_suppkey % 4 = 1 AND l_discount > 0.05 THEN 'strong_conflict' ELSE 'none' END AS conflict, CASE l_linenumber WHEN 4 THEN '' ELSE l_returnflag || l_linestatus END AS field FROM lineitem)"""
SUMMARY = f"""(SELECT run, count(*) FILTER (w AND severity = 'P0') AS n_p0, count(*) FILTER (w AND severity = 'P1') AS n_p1, count(*) FILTER (w AND severity = 'P2') AS n_p2, count(*) FILTER (w) AS n_confirmed,
      count(*) FILTER (verdict = 'generic_statement') AS n_generic, count(*) FILTER (verdict = 'not_about_brand') AS n_irrelevant, count(*) FILTER (verdict IN ('unsupported', 'gt_insufficient')) AS n_unsupported, count(*) FILTER (verdict = 'template_invalid') AS n_template_invalid,
      count(*) FILTER (w AND claim_type = 'fact') AS n_fact, count(*) FILTER (w AND claim_type = 'opinion') AS n_opinion, count(*) FILTER (w AND claim_type = 'speculation') AS n_speculation, count(*) FILTER (w AND coalesce(claim_type, 'rumour') = 'rumour') AS n_unknown,
      count(*) FILTER (strength = 'strong') AS n_strong, count(*) FILTER (strength = 'moderate') AS n_moderate, count(*) FILTER (strength = 'weak') AS n_weak, count(*) FILTER (strength = 'disputed') AS n_disputed, count(*) FILTER (strength = 'insufficient_evidence') AS n_insufficient_evidence,
      list_sort(coalesce(list(DISTINCT field) FILTER (field <> '' AND conflict <> 'none'), [])) AS conflicts, list_sort(coalesce(list(DISTINCT field) FILTER (field <> '' AND conflict = 'critical_conflict'), [])) AS critical
      FROM (SELECT *, verdict = 'contradicted' AND subject_type = 'target_brand' AS w FROM {CLAIMS}) GROUP BY 1)"""


def claims(s, d):
    k, p, i = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    verdicts = ("unsupported", "gt_insufficient", "generic_statement", "not_about_brand", "template_invalid", "supported", "contradicted", "contradicted")
    kind = F.when(p % 10 < i % 10, "speculation").when(p % 7 < i % 7, "opinion").when(p % 5 < i % 5, F.lit(None)).when(p % 5 == 4, "rumour").otherwise("fact")
    q, spread = F.col("l_quantity"), F.col("l_discount") > 0.05
    strength = F.when(q < i % 50, F.when(F.col("l_linestatus") == "F", "weak").otherwise("insufficient_evidence")).when(q < 40, "strong").when(q < 45, "moderate").when(q < 48, "disputed")
    conflict = F.when((i % 4 == 0) & spread, "critical_conflict").when((i % 4 == 1) & spread, "strong_conflict").otherwise("none")
    n = F.col("l_linenumber")
    return table(s, d, "lineitem").select(
        i.alias("run"), F.element_at(F.array(*[F.lit(v) for v in verdicts]), (k % 8 + 1).cast("int")).alias("verdict"), F.when(n == 1, "P0").when(n == 2, "P1").when(n == 3, "P2").alias("severity"),
        F.when(F.col("l_returnflag") == "N", "competitor").otherwise("target_brand").alias("subject_type"), kind.alias("claim_type"), strength.alias("strength"), conflict.alias("conflict"),
        F.when(n == 4, "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("field"),
    )


@query(
    "q1_claim_summary",
    f"""SELECT s_suppkey AS run, n_fact + n_opinion + n_speculation + n_unknown AS n_classified, {", ".join(f"n_{c}" for c in "p0 p1 p2 confirmed generic irrelevant unsupported template_invalid fact opinion speculation unknown strong moderate weak disputed insufficient_evidence".split())},
      array_to_string(conflicts, ',') AS conflicts, array_to_string(critical, ',') AS critical, coalesce(breakdown, '') AS breakdown FROM supplier JOIN {SUMMARY} s ON s.run = s_suppkey
      LEFT JOIN (SELECT run, string_agg(t || ':' || v || ':' || n, ',' ORDER BY t, v) AS breakdown FROM (SELECT run, CASE WHEN coalesce(claim_type, 'rumour') = 'rumour' THEN 'unknown' ELSE claim_type END AS t, coalesce(severity, 'Info') AS v, count(*) AS n FROM {CLAIMS} WHERE verdict = 'contradicted' AND subject_type = 'target_brand' GROUP BY ALL) GROUP BY 1) b ON b.run = s_suppkey""",
)
def _(s, d):
    found = G.quality_summary(table(s, d, "supplier").select(F.col("s_suppkey").alias("run")), claims(s, d))
    line = F.array_join(F.transform("breakdown", lambda b: F.concat_ws(":", b.claim_type, b.severity, b.n.cast("string"))), ",")
    return found.withColumns({"conflicts": F.array_join("conflicts", ","), "critical": F.array_join("critical", ","), "breakdown": line})


@query(
    "q2_report_gate",
    f"""WITH r AS (SELECT s_suppkey AS run, s_suppkey % 13 <> 0 AS known, s_suppkey % 11 = 0 AS bad, s_suppkey % 10 <> 0 AS can, s_suppkey % 3 = 0 AS skipped, CASE WHEN s_suppkey % 9 > 0 THEN (s_suppkey % 25) / 25.0 + 0.4 END AS coverage, s_suppkey % 8 = 0 AS low, s_suppkey % 17 = 0 AS no_metrics, s_suppkey % 19 = 0 AS zero, CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 0.3 END AS most FROM supplier),
    j AS (SELECT r.*, s.* EXCLUDE (run), n_fact + n_opinion + n_speculation + n_unknown AS n, n_speculation / nullif(n_fact + n_opinion + n_speculation + n_unknown, 0) AS spec FROM r LEFT JOIN {SUMMARY} s ON s.run = r.run AND r.run % 23 > 0),
    b AS (SELECT run, list_filter([CASE WHEN n IS NULL THEN 'QUALITY_SCHEMA_MISSING' END, CASE WHEN NOT known THEN 'TEMPLATE_HEALTH_MISSING' WHEN bad THEN 'CRITICAL_TEMPLATE_INVALID' WHEN NOT can THEN 'CANNOT_COLLECT' END, CASE WHEN coverage IS NULL THEN 'COVERAGE_DATA_MISSING' WHEN coverage < 0.6 THEN 'METRIC_COVERAGE_LOW' END,
      CASE WHEN no_metrics THEN 'METRIC_DATA_MISSING' WHEN zero THEN 'CORE_KPI_ZERO_DENOMINATOR' END, CASE WHEN spec > 0.5 THEN 'EXCESSIVE_SPECULATION' END, CASE WHEN len(critical) > 0 THEN 'CRITICAL_EVIDENCE_CONFLICT' END], lambda x: x IS NOT NULL) AS blocks,
      list_filter([CASE WHEN known AND skipped THEN 'OPTIONAL_SKIPPED' END, CASE WHEN low THEN 'PLATFORM_LOW_COVERAGE' END, CASE WHEN n_unsupported > 100 THEN 'HIGH_GT_UNSUPPORTED' END, CASE WHEN spec > most AND spec <= 0.5 THEN 'HIGH_SPECULATION_RATIO' END, CASE WHEN n_opinion / nullif(n, 0) > 0.6 THEN 'HIGH_OPINION_RATIO' END, CASE WHEN n_unknown / nullif(n, 0) > 0.2 THEN 'HIGH_UNKNOWN_RATIO' END,
      CASE WHEN len(critical) = 0 AND len(conflicts) > 0 THEN 'EVIDENCE_STRONG_CONFLICT' END, CASE WHEN (n_weak + n_insufficient_evidence) / nullif(n_strong + n_moderate + n_weak + n_insufficient_evidence, 0) > 0.6 THEN 'WEAK_EVIDENCE_DOMINANCE' END, CASE WHEN n_insufficient_evidence > 0 AND len(critical) > 2 THEN 'INSUFFICIENT_EVIDENCE_FIELDS' END], lambda x: x IS NOT NULL) AS warnings FROM j)
    SELECT run, array_to_string(blocks, ',') AS blocks, array_to_string(warnings, ',') AS warnings, len(blocks) = 0 AS publishable FROM b""",
)
def _(s, d):
    k = F.col("s_suppkey")
    templates = F.when(k % 13 != 0, F.struct(F.when(k % 11 == 0, 1).otherwise(0).alias("critical_invalid"), (k % 10 != 0).alias("can_collect"), F.when(k % 3 == 0, 2).otherwise(0).alias("optional_skipped")))
    coverage = F.when(k % 9 > 0, (k % 25) / 25.0 + 0.4)
    platforms = F.create_map(F.lit("a"), F.lit(0.9), F.lit("b"), F.when(k % 8 == 0, 0.4).otherwise(0.5))
    denominators = F.when(k % 17 != 0, F.create_map(F.lit("citation_rate"), F.when(k % 19 == 0, 0).otherwise(9).cast("bigint")))
    limits = F.when(k % 2 == 0, F.create_map(F.lit("max_speculation_ratio"), F.lit(0.4)))
    runs = table(s, d, "supplier").select(k.alias("run"), templates.alias("templates"), coverage.alias("coverage"), platforms.alias("platform_coverage"), denominators.alias("denominators"), limits.alias("limits"))
    summaries = G.quality_summary(runs.where(F.col("run") % 23 > 0), claims(s, d))
    return G.publishable(runs, summaries).select("run", F.array_join("blocks", ",").alias("blocks"), F.array_join("warnings", ",").alias("warnings"), "publishable")


# --- a brand and its rivals --------------------------------------------------
# Customers are brands, their orders the snapshots (of square roots, as no two sums of them tie at a limit); every customer has three competitor sets, some of them active.

SNAPSHOTS = """(SELECT o_custkey AS entity, o_orderdate AS ts, sqrt(o_totalprice / 500000) AS sov, sqrt(o_orderkey % 97 / 97.0::DOUBLE) AS first_rec_rate, CASE WHEN o_orderkey % 3 > 0 THEN sqrt(o_orderkey % 31 / 31.0::DOUBLE) END AS accuracy_rate, o_orderkey % 50 AS sample_size,
      CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS platform, CASE WHEN o_orderkey % 5 = 0 THEN 'city' END AS dimension FROM orders)"""
LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, sov DESC, first_rec_rate DESC, accuracy_rate DESC NULLS LAST, sample_size DESC) AS place FROM {rows}) WHERE place = 1)"
SETS = """(SELECT c_custkey AS brand, v, CASE WHEN c_custkey % 9 = 0 THEN [] ELSE list_concat(range(c_custkey + v, c_custkey + v + c_custkey % 9), [c_custkey + v, -1]) END AS competitors FROM customer, range(1, 4) r(v) WHERE c_custkey % 11 > 0 AND (c_custkey + v) % 4 > 0
      QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC) = 1)"""
THREE = ("sov", "first_rec_rate", "accuracy_rate")
NOW, OWN_DAYS, DAYS = "2001-06-01", 300, 500


def snapshots(s, d):
    key = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.sqrt(F.col("o_totalprice") / 500000).alias("sov"), F.sqrt(key % 97 / 97.0).alias("first_rec_rate"), F.when(key % 3 > 0, F.sqrt(key % 31 / 31.0)).alias("accuracy_rate"),
        (key % 50).alias("sample_size"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("platform"), F.when(key % 5 == 0, "city").alias("dimension"),
    )


def competitor_sets(s, d):
    c, v = F.col("c_custkey"), F.col("v").cast("bigint")
    sets = table(s, d, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("v"))
    competitors = F.when(c % 9 > 0, F.concat(F.sequence(c + v, c + v + F.greatest(c % 9, F.lit(1)) - 1), F.array(c + v, F.lit(-1).cast("bigint"))))
    return sets.select(c.alias("brand"), competitors.alias("competitors"), ((c % 11 > 0) & ((c + v) % 4 > 0)).alias("active"), v.alias("updated_at"))


@query(
    "kpi12_active_set_matrix",
    f"""WITH l AS {LATEST.format(rows=f"(SELECT * FROM {SNAPSHOTS} WHERE platform IS NULL AND dimension IS NULL)")}, m AS (SELECT DISTINCT brand, unnest(list_concat([brand], competitors)) AS member FROM {SETS})
    SELECT brand, member, brand = member AS is_own, ts, round(sov, 6) AS sov, round(first_rec_rate, 6) AS first_rec_rate, round(accuracy_rate, 6) AS accuracy_rate, sample_size FROM m JOIN l ON entity = member""",
)
def _(s, d):
    m = V.competitor_matrix(snapshots(s, d), competitor_sets(s, d), THREE)
    return m.withColumns({k: F.round(k, 6) for k in THREE})


FRESH = f"(SELECT * FROM {SNAPSHOTS} WHERE ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL {{days}} DAY)"
GAPS = f"""WITH own AS {LATEST.format(rows=FRESH.format(days=OWN_DAYS))}, theirs AS {LATEST.format(rows=FRESH.format(days=DAYS))}, sets AS {SETS},
    m AS (SELECT brand, count(*) AS with_data, avg(sov) AS sov, avg(first_rec_rate) AS first_rec_rate, avg(accuracy_rate) AS accuracy_rate FROM (SELECT brand, unnest(competitors) AS member FROM sets) JOIN theirs ON entity = member GROUP BY 1),
    j AS (SELECT coalesce(own.entity, sets.brand) AS brand, coalesce(len(competitors), 0) AS total_competitors, coalesce(with_data, 0) AS with_data, own.sov AS v1, own.first_rec_rate AS v2, own.accuracy_rate AS v3, m.sov AS r1, m.first_rec_rate AS r2, m.accuracy_rate AS r3
      FROM own FULL JOIN sets ON own.entity = sets.brand LEFT JOIN m ON m.brand = coalesce(own.entity, sets.brand)),
    k AS (SELECT brand, total_competitors, with_data, 'sov' AS kpi, v1 AS value, r1 AS rivals FROM j UNION ALL SELECT brand, total_competitors, with_data, 'first_rec_rate', v2, r2 FROM j UNION ALL SELECT brand, total_competitors, with_data, 'accuracy_rate', v3, r3 FROM j),
    b AS (SELECT kpi, quantile_cont(value, 0.5) AS p50 FROM k WHERE kpi <> 'accuracy_rate' GROUP BY 1),
    g AS (SELECT k.*, p50, coalesce(value - rivals, value - p50, 0) AS gap, CASE kpi WHEN 'sov' THEN '{V.LABELS["sov"]}' WHEN 'first_rec_rate' THEN '{V.LABELS["first_rec_rate"]}' ELSE '{V.LABELS["accuracy_rate"]}' END AS label FROM k LEFT JOIN b USING (kpi))
    SELECT brand, kpi, round(value, 6) AS value, round(rivals, 6) AS rivals, total_competitors, with_data, round(p50, 6) AS p50, round(gap, 6) AS gap, CASE WHEN abs(gap) >= 0.2 THEN 'large' WHEN abs(gap) >= 0.1 THEN 'moderate' WHEN abs(gap) >= 0.05 THEN 'small' ELSE 'none' END AS significance,
      CASE WHEN abs(gap) < 0.01 THEN '{V.NO_GAP}' ELSE '品牌在「' || label || '」上' || CASE WHEN gap > 0 THEN '领先' ELSE '落后' END || '于竞品均值' END AS finding,
      CASE WHEN gap <= -0.01 THEN '在「' || label || '」方面可能存在改进空间' ELSE '建议关注「' || label || '」相关指标' END AS drivers, CASE WHEN gap >= 0.01 THEN '在「' || label || '」方面品牌表现较好' ELSE '' END AS counters,
      CASE WHEN total_competitors = 0 OR with_data < 2 THEN 'low' WHEN with_data >= 5 AND kpi <> 'accuracy_rate' THEN 'high' ELSE 'medium' END AS confidence,
      CASE WHEN total_competitors = 0 THEN '无竞品数据' WHEN with_data < 2 THEN '竞品数据不足' WHEN with_data >= 5 AND kpi <> 'accuracy_rate' THEN '数据充分，基准可靠' ELSE '竞品数据有限，结论仅供参考' END AS reason,
      '该判断基于当前采集样本，' || CASE WHEN abs(gap) < 0.05 THEN '差距较小，可能属于正常波动范围，' ELSE '' END || '仍需通过后续内容发布和复测验证' AS caveat FROM g"""


@query("b6_gap_reasons", GAPS)
def _(s, d):
    compared = V.compare(snapshots(s, d), competitor_sets(s, d), THREE, F.expr(f"timestamp_ntz '{NOW}'"), OWN_DAYS, DAYS)
    values = compared.where("kpi <> 'accuracy_rate'").select(F.lit("all").alias("group"), "kpi", "value")
    found = V.gap_attribution(compared, B.industry_benchmark(values, digits=12))
    rounded = {c: F.round(c, 6) for c in ("value", "rivals", "p50", "gap")}
    return found.withColumns(rounded | {c: F.array_join(c, "; ") for c in ("drivers", "counters")})


CARDS = ", ".join(f"({i}, '{k}', '{v}', '{e}')" for i, (e, (k, v)) in enumerate(zip(("view", "click", "purchase", "signup", "error", "", "", "", "", ""), V.LABELS.items(), strict=True)))


@query(
    "kpi13_cards",
    f"""WITH r AS (SELECT user_id AS brand, event_type, avg(value) AS value, count(*) FILTER (value > 50) AS numerator, count(*) AS denominator, count(DISTINCT hour(ts)) AS sample_size, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 10 THEN 'medium' END AS confidence FROM events GROUP BY ALL)
    SELECT u.brand, place, key, name, round(coalesce(value, 0), 6) AS value, coalesce(numerator, 0) AS numerator, coalesce(denominator, 0) AS denominator, coalesce(sample_size, 0) AS sample_size, coalesce(confidence, 'low') AS confidence
    FROM (SELECT DISTINCT user_id AS brand FROM events) u CROSS JOIN (VALUES {CARDS}) c(place, key, name, event_type) LEFT JOIN r ON r.brand = u.brand AND r.event_type = c.event_type""",
)
def _(s, d):
    kpi = F.col("event_type")
    for event, key in zip(("view", "click", "purchase", "signup", "error"), V.LABELS, strict=False):
        kpi = F.when(F.col("event_type") == event, key).otherwise(kpi)
    n = F.count("*")
    results = table(s, d, "events").groupBy(F.col("user_id").alias("brand"), kpi.alias("kpi")).agg(
        F.avg("value").alias("value"), F.count_if(F.col("value") > 50).alias("numerator"), n.alias("denominator"), F.countDistinct(F.hour("ts")).alias("sample_size"), F.when(n >= 15, "high").when(n >= 10, "medium").alias("confidence")
    )
    rows = V.kpi_cards(results).select("brand", F.posexplode("cards").alias("place", "c")).select("brand", "place", "c.*")
    return rows.withColumn("value", F.round("value", 6))
