"""Fact records, reviews, templates, publications and control tables on the stand-in tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import claims as C
from answerscope.operators import evidence as E
from answerscope.operators import lexicon as X
from answerscope.plans.registry import query, table
from answerscope.sources import readers, scratch, sinks
from answerscope.streaming import flows


@query("s7_json_lines", "SELECT p_name AS claim_text, p_type AS expected_claim_nature FROM part")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_name").alias("claim_text"), F.col("p_type").alias("expected_claim_nature"))
    path = scratch.scratch_path(s, "golden")
    rows.write.json(path)
    return readers.json_lines(s, path).select("claim_text", "expected_claim_nature")


@query(
    "s3_landed_answers",
    """WITH a AS (SELECT user_id % 40 AS template, event_type AS platform, ts, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'said ' || event_id END AS said, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'odd' ELSE 'success' END AS status FROM events),
    l AS (SELECT template, platform, arg_max({'said': trim(said), 'status': status}, ts) AS r FROM a GROUP BY 1, 2)
    SELECT template::VARCHAR AS template_id, platform, r.said AS answer_text, CASE WHEN r.status = 'odd' THEN 'parse_failed' WHEN r.status = 'success' AND r.said = '' THEN 'empty_response' ELSE r.status END AS status FROM l WHERE platform <> 'signup'""",
)
def _(s, d):
    k = F.col("event_id")
    landed = table(s, d, "events").select(
        F.lit("run").alias("collection_run_id"), F.lit("b").alias("brand_id"), (F.col("user_id") % 40).cast("string").alias("template_id"), F.col("event_type").alias("platform"), F.lit("q").alias("question"),
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("said "), k.cast("string"))).alias("answer_text"), F.when(k % 4 == 0, "timeout").when(k % 4 == 1, "odd").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("collected_at"),
    )
    path = scratch.scratch_path(s, "answers")
    landed.write.partitionBy("platform").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return readers.landed_answers(s, path).where("platform <> 'signup'").select("template_id", "platform", "answer_text", "status")


@query("k1_append", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def _(s, d):
    o, path = table(s, d, "orders"), scratch.scratch_path(s, "appended")
    for status in ("F", "O"):
        sinks.append(o.where(F.col("o_orderstatus") == status), path)
    return s.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("k7_content_json", "SELECT p_partkey, '{\"theme\":\"' || p_type || '\",\"body\":\"' || p_name || '\"}' AS piece FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_type").alias("theme"), F.col("p_name").alias("body"))).alias("piece"))


@query("k12_audit_rows", "SELECT event_id, event_type AS action, '***' AS k FROM events WHERE event_type = 'error'")
def _(s, d):
    e = table(s, d, "events").where("event_type = 'error'")
    fields = F.transform_values(F.from_json("props", "map<string,string>"), lambda k, v: F.when(k == "k", "***").otherwise(v))
    return e.select("event_id", F.col("event_type").alias("action"), F.element_at(fields, "k").alias("k"))


@query("k13_publish_gate", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'paused' WHEN o_orderstatus <> 'F' THEN 'not_approved' WHEN o_totalprice > 450000 THEN 'breaker_open' ELSE 'deliver' END AS action FROM orders")
def _(s, d):
    paused = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("paused"))
    o = table(s, d, "orders").join(paused, "o_custkey", "left")
    action = F.when(F.col("paused"), "paused").when(F.col("o_orderstatus") != "F", "not_approved").when(F.col("o_totalprice") > 450000, "breaker_open").otherwise("deliver")
    return o.select("o_orderkey", action.alias("action"))


@query("k14_orphan_files", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    # files of which no row is left
    return table(s, d, "pages").select("page_id").join(table(s, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")


@query("p14_any_alias", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'licensed')")
def _(s, d):
    return table(s, d, "documents").where(T.mentions(F.col("text"), F.array(F.lit("IDIOT"), F.lit("Licensed")))).select("doc_id")


@query("p15_exact_case", "SELECT doc_id FROM documents WHERE contains(text, 'Licensed')")
def _(s, d):
    return table(s, d, "documents").where(F.contains("text", F.lit("Licensed"))).select("doc_id")


@query("j4_left_outer", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY 1")
def _(s, d):
    l = table(s, d, "lineitem").where("l_quantity > 49").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(s, d, "part")
    return p.join(l, p.p_partkey == l.l_partkey, "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("a21_child_summary", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'failed' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'partial' ELSE 'published' END AS status FROM lineitem GROUP BY 1")
def _(s, d):
    k, n = F.count_if(F.col("l_returnflag") == "R"), F.count("*")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.when(k == n, "failed").when(k > 0, "partial").otherwise("published").alias("status"))


@query("t6_best_action", "SELECT o_custkey, o_orderkey, round(o_totalprice / 1000, 3) AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(s, d):
    best = table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("r"))
    return best.select("o_custkey", (-F.col("r.k")).alias("o_orderkey"), F.round(F.col("r.o_totalprice") / 1000, 3).alias("score"))


@query("d5_include_exclude_overlap", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['ring', 'small']) AND list_has_any(string_split(p_name, ' '), ['bolt', 'ring']) AS overlaps FROM part")
def _(s, d):
    w = F.split("p_name", " ")
    both = F.arrays_overlap(w, F.array(F.lit("ring"), F.lit("small"))) & F.arrays_overlap(w, F.array(F.lit("bolt"), F.lit("ring")))
    return table(s, d, "part").select("p_partkey", both.alias("overlaps"))


@query("d6_longest_words", "SELECT p_partkey, array_to_string(list_filter(l, lambda x: NOT list_bool_or(list_transform(l, lambda y: x <> y AND contains(y, x)))), ',') AS kept FROM (SELECT p_partkey, list_filter(['rin', 'ring', 'idge', 'widget', 'bolt'], lambda w: contains(p_name, w)) AS l FROM part) WHERE len(l) > 0")
def _(s, d):
    hits = F.filter(F.array(*[F.lit(x) for x in ("rin", "ring", "idge", "widget", "bolt")]), lambda w: F.contains("p_name", w))
    p = table(s, d, "part").select("p_partkey", hits.alias("l")).where(F.size("l") > 0)
    return p.select("p_partkey", F.array_join(F.filter("l", lambda x: ~F.exists("l", lambda y: (x != y) & F.contains(y, x))), ",").alias("kept"))


@query("f26_terms_outside_code", "SELECT p_partkey, replace(p_name, 'ring', 'band') || ' `' || p_name || '`' AS text FROM part")
def _(s, d):
    # odd pieces between back quotes are left alone
    pieces = F.split(F.concat(F.col("p_name"), F.lit(" `"), F.col("p_name"), F.lit("`")), "`", -1)
    swapped = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("ring"), F.lit("band"))).otherwise(x))
    return table(s, d, "part").select("p_partkey", F.array_join(swapped, "`").alias("text"))


def records(s, d):
    """A nested fact record per customer: a name with two values, of which the second may be primary, and a segment."""
    source = lambda t: F.array(F.struct(F.lit(t).alias("tier")))
    value = lambda v, p, t: F.struct(v.alias("value"), p.alias("primary"), source(t).alias("sources"))
    names = F.array(value(F.col("c_name"), F.lit(False), "B"), value(F.upper("c_name"), F.col("c_custkey") % 2 == 0, "S"))
    segment = F.array(value(F.col("c_mktsegment"), F.lit(True), "C"))
    field = lambda v: F.struct(F.lit("ok").alias("status"), v.alias("values"))
    return table(s, d, "customer").select("c_custkey", F.create_map(F.lit("official_name"), field(names), F.lit("industry"), field(segment)).alias("fields"))


def primary(values):
    """The first primary value, or the first of all."""
    return F.coalesce(F.get(F.filter(values, lambda v: v["primary"]), 0)["value"], F.get(values, 0)["value"])


@query("f38_flat_facts", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS official_name, c_mktsegment AS industry FROM customer")
def _(s, d):
    of = lambda n: primary(F.col("fields")[n]["values"])
    return records(s, d).select("c_custkey", of("official_name").alias("official_name"), of("industry").alias("industry"))


@query("f39_nested_facts", "SELECT c_custkey, 'v2' AS schema_version, 2 AS n_fields FROM customer")
def _(s, d):
    return records(s, d).select("c_custkey", F.when(F.col("fields").isNotNull(), "v2").otherwise("v1").alias("schema_version"), F.size("fields").alias("n_fields"))


@query("f40_coverage", "SELECT c_custkey, round(2 / 3, 6) AS coverage FROM customer")
def _(s, d):
    required = F.array(F.lit("official_name"), F.lit("industry"), F.lit("category"))
    return records(s, d).select("c_custkey", F.round(F.size(F.array_intersect(F.map_keys("fields"), required)) / F.size(required), 6).alias("coverage"))


@query("f41_best_source", "SELECT c_custkey, f AS field, CASE f WHEN 'official_name' THEN 'S' ELSE 'C' END AS best FROM customer, (SELECT unnest(['official_name', 'industry']) AS f)")
def _(s, d):
    each = records(s, d).select("c_custkey", F.explode("fields").alias("field", "v")).select("c_custkey", "field", F.explode("v.values").alias("value")).select("c_custkey", "field", F.explode("value.sources").alias("source"))
    return each.groupBy("c_custkey", "field").agg(F.max_by("source.tier", E.rank(F.col("source.tier"))).alias("best"))


@query("f47_payload_hash", "SELECT o_orderkey, md5('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS digest, o_orderpriority <> '4-NOT SPECIFIED' AS complete FROM orders")
def _(s, d):
    # volatile keys are left out of the hash
    stable = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return table(s, d, "orders").select("o_orderkey", F.md5(stable.cast("binary")).alias("digest"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("complete"))


@query("f52_config_checks", "SELECT l_orderkey, sum(l_quantity) BETWEEN 99.9 AND 100.1 AS sums_up, min(l_quantity) > 0 AND max(l_quantity) <= 100 AS in_range, bool_and(l_returnflag IN ('A', 'N')) AS levels_known FROM lineitem GROUP BY 1")
def _(s, d):
    # an order is a configuration: its lines' hundredths are the weights, their flags the levels
    weight = F.col("l_quantity") / 100
    in_range, known = F.bool_and((weight > 0) & (weight <= 1)), F.bool_and(F.col("l_returnflag").isin("A", "N"))
    total = F.sum("l_quantity") / 100
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(((total >= 0.999) & (total <= 1.001)).alias("sums_up"), in_range.alias("in_range"), known.alias("levels_known"))


@query("kpi13_snapshot", "SELECT source, count(*) AS sample_size, round(count(*) FILTER (contains(text, 'the')) / count(*), 4) AS sov, round(count(*) FILTER (contains(text, 'token')) / count(*), 4) AS differentiation FROM documents GROUP BY 1")
def _(s, d):
    n = F.count("*")
    share = lambda w: F.round(F.count_if(F.contains("text", F.lit(w))) / n, 4)
    return table(s, d, "documents").groupBy("source").agg(n.alias("sample_size"), share("the").alias("sov"), share("token").alias("differentiation"))


def verdicts(s, d):
    l = table(s, d, "lineitem")
    fields = ["official_name", "core_products", "forbidden_claims", "target_competitors"]
    verdict = F.when(F.col("l_returnflag") == "A", "contradicted").when(F.col("l_returnflag") == "R", "unsupported").otherwise("supported")
    nature = F.when(F.col("l_linestatus") == "O", "speculation").otherwise("fact")
    field = F.element_at(F.array(*[F.lit(f) for f in fields]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return l.select(F.monotonically_increasing_id().alias("id"), field.alias("field"), verdict.alias("verdict"), nature.alias("nature"), F.when(F.col("l_linenumber") == 1, "P0").otherwise("P1").alias("severity"), F.lit(None).cast("string").alias("error_type"), F.lit(False).alias("needs_review"))


@query(
    "c6_speculation_severity",
    """WITH v AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN true ELSE false END AS risky, l_returnflag AS f, l_linestatus = 'O' AS spec, CASE WHEN l_linenumber = 1 THEN 'P0' ELSE 'P1' END AS sev FROM lineitem)
    SELECT CASE WHEN spec AND risky AND f IN ('A', 'R') THEN CASE WHEN sev = 'P0' THEN 'P0' ELSE 'P1' END WHEN spec AND NOT risky AND f = 'A' THEN 'P2' WHEN spec AND NOT risky AND f = 'R' AND sev = 'P0' THEN 'P1' ELSE sev END AS severity, count(*) AS n FROM v GROUP BY 1""",
)
def _(s, d):
    return C.adjust_speculation(verdicts(s, d)).groupBy("severity").agg(F.count("*").alias("n"))


FIELDS = [*X.PREDICATES, "unheard_of"]


@query("c9_predicates", f"SELECT s_suppkey, CASE s_suppkey % {len(FIELDS)} " + " ".join(f"WHEN {i} THEN '{X.PREDICATES[f]}'" for i, f in enumerate(FIELDS[:-1])) + " ELSE 'other' END AS predicate FROM supplier")
def _(s, d):
    field = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("s_suppkey") % len(FIELDS) + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", C.lookup(field, X.PREDICATES, "other").alias("predicate"))


@query("c18_search_first", "SELECT user_id, coalesce(arg_min(value, event_id) FILTER (event_type = 'view'), arg_min(value, event_id)) AS value FROM events GROUP BY 1")
def _(s, d):
    # a value found by search goes before one that an assistant gave
    found = F.min_by("value", F.when(F.col("event_type") == "view", F.col("event_id")))
    has = F.bool_or(F.col("event_type") == "view")
    return table(s, d, "events").groupBy("user_id").agg(F.when(has, found).otherwise(F.min_by("value", "event_id")).alias("value"))


@query(
    "c25_candidate_diff",
    "WITH o AS (SELECT o_custkey AS k, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS active, max(o_orderpriority) FILTER (o_orderstatus = 'O') AS candidate FROM orders GROUP BY 1) SELECT k, CASE WHEN active IS NULL AND candidate IS NULL THEN 'none' WHEN active IS NULL THEN 'added' WHEN candidate IS NULL THEN 'removed' WHEN active = candidate THEN 'unchanged' ELSE 'changed' END AS change FROM o",
)
def _(s, d):
    of = lambda x: F.max(F.when(F.col("o_orderstatus") == x, F.col("o_orderpriority")))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(of("F").alias("a"), of("O").alias("c"))
    a, c = F.col("a"), F.col("c")
    return o.select("k", F.when(a.isNull() & c.isNull(), "none").when(a.isNull(), "added").when(c.isNull(), "removed").when(a == c, "unchanged").otherwise("changed").alias("change"))


@query("c30_config_layers", "SELECT n_name, coalesce(CASE WHEN n_nationkey % 6 = 0 THEN 0.9 END, CASE WHEN n_regionkey = 1 THEN 0.7 END, 0.5)::DOUBLE AS threshold FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    brand = n.where("n_nationkey % 6 = 0").select("n_nationkey", F.lit(0.9).alias("b"))
    industry = s.createDataFrame([(1, 0.7)], "n_regionkey int, i double")
    return n.join(brand, "n_nationkey", "left").join(F.broadcast(industry), "n_regionkey", "left").select("n_name", F.coalesce("b", "i", F.lit(0.5)).alias("threshold"))


@query("c31_review_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 100")
def _(s, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(s, d, "orders").where("o_orderstatus = 'O'").orderBy(rank, "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("c32_review_claims", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 2 HOUR < TIMESTAMP '1998-01-01' THEN 'released' ELSE 'claimed' END AS state, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS in_batch FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    state = F.when(F.expr("o_orderdate + interval 2 hours < timestamp_ntz '1998-01-01'"), "released").otherwise("claimed")
    return table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", state.alias("state"), (~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("in_batch"))


@query("c33_reclassification", "SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN 'changed' ELSE 'same' END AS outcome FROM documents")
def _(s, d):
    # a dry run: old and new class side by side, by the same rule before and after a word is added
    docs = table(s, d, "documents")
    old = docs.select("doc_id", F.lit(False).alias("old"))
    new = docs.select("doc_id", T.any_contains(F.col("text"), ("idiot",)).alias("new"))
    return old.join(new, "doc_id").select("doc_id", F.when(F.col("old") != F.col("new"), "changed").otherwise("same").alias("outcome"))


@query("c36_template_versions", "SELECT o_custkey AS template, count(*) AS version, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("template")).agg(F.count("*").alias("version"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"))


@query("c37_feedback_routes", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'fact_update' WHEN l_returnflag = 'R' THEN 'calibration' ELSE 'none' END AS route FROM lineitem")
def _(s, d):
    route = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "fact_update").when(F.col("l_returnflag") == "R", "calibration").otherwise("none")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", route.alias("route"))


@query("q10_report_context", "UNPIVOT (SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS mean, count(*)::DOUBLE AS n FROM customer GROUP BY 1) ON mean, n INTO NAME kpi VALUE value")
def _(s, d):
    g = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count("*").cast("double").alias("n"))
    return g.unpivot("segment", ["mean", "n"], "kpi", "value")


@query("st15_requeue_links", "SELECT event_id, event_id + 1000000 AS retry_id FROM events WHERE event_type = 'error' AND event_id % 6 < 4")
def _(s, d):
    return table(s, d, "events").where("event_type = 'error' and event_id % 6 < 4").select("event_id", (F.col("event_id") + 1000000).alias("retry_id"))


@query("st16_st20_control", "SELECT event_id, user_id % 10 = 3 AS cancelled, user_id % 10 = 7 AS paused FROM events")
def _(s, d):
    control = s.createDataFrame([(3, "cancelled"), (7, "paused")], "k int, signal string")
    e = table(s, d, "events").withColumn("k", (F.col("user_id") % 10).cast("int"))
    joined = e.join(F.broadcast(control), "k", "left")
    on = lambda x: F.coalesce(F.col("signal") == x, F.lit(False)).alias(x)
    return joined.select("event_id", on("cancelled"), on("paused"))


@query("st14_rejected_moves", "WITH m AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f, event_type AS t FROM events) SELECT f AS from_state, t AS to_state, count(*) AS n FROM m WHERE f IS NOT NULL AND f || '>' || t NOT IN ('click>view', 'view>click') GROUP BY 1, 2")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    moves = table(s, d, "events").select(F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state")).where("from_state is not null")
    allowed = s.createDataFrame([("click", "view"), ("view", "click")], "from_state string, to_state string")
    return flows.validated(moves, allowed).where(~F.col("allowed")).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@query("st18_scoped_failures", "SELECT CASE WHEN event_id % 3 = 0 THEN 'org' ELSE 'global' END AS scope, user_id, count(*) AS failures, count(*) >= 5 AS is_open FROM events WHERE event_type = 'error' GROUP BY ALL")
def _(s, d):
    scope = F.when(F.col("event_id") % 3 == 0, "org").otherwise("global")
    return table(s, d, "events").where("event_type = 'error'").groupBy(scope.alias("scope"), "user_id").agg(F.count("*").alias("failures"), (F.count("*") >= flows.FAILURES).alias("is_open"))


@query("st21_reconcile", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 MINUTE THEN 'unknown' WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 15 MINUTE THEN 'enqueue_failed' ELSE o_orderstatus END AS status FROM orders")
def _(s, d):
    o = F.col("o_orderstatus")
    status = F.when((o == "P") & F.expr("o_orderdate < timestamp_ntz '1998-01-01' - interval 30 minutes"), "unknown").when((o == "O") & F.expr("o_orderdate < timestamp_ntz '1998-01-01' - interval 15 minutes"), "enqueue_failed").otherwise(o)
    return table(s, d, "orders").select("o_orderkey", status.alias("status"))


@query("x14_report_lists", "SELECT p_type, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 5")
def _(s, d):
    w = W.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(s, d, "part").withColumn("i", F.row_number().over(w)).where("i <= 5").select("p_type", "p_partkey", "p_name")


@query("x16_key_lookup", "SELECT s_suppkey, list_contains(CASE WHEN s_suppkey % 2 = 0 THEN ['read', 'write'] ELSE ['read'] END, 'write') AS may_write FROM supplier WHERE substring(sha256(s_name), 1, 1) < '8'")
def _(s, d):
    scopes = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read")))
    return table(s, d, "supplier").where(F.substring(F.sha2("s_name", 256), 1, 1) < "8").select("s_suppkey", F.array_contains(scopes, "write").alias("may_write"))
