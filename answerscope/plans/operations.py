"""Sources, sinks, tenant aggregates, quality gates and streams on the stand-in tables."""

from decimal import Decimal

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.plans.registry import query, table
from answerscope.sources import readers, sinks
from answerscope.streaming import flows, timed

# --- sources -----------------------------------------------------------------


@query("s1_scan_pushdown", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 100")
def _(s, d):
    return table(s, d, "events").where("event_type = 'click' and value > 100").select("event_id", "value")


@query("s2_named_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' GROUP BY 1")
def _(s, d):
    sql = "select o_orderpriority, count(*) as n from {orders} where o_totalprice > :least and o_orderstatus = :status group by 1"
    return readers.with_parameters(s, sql, {"orders": table(s, d, "orders")}, least=200000, status="F")


@query("s4_mock_answers", "SELECT n_name AS question, p AS platform, n_name || p IS NOT NULL AS asked FROM nation, (SELECT unnest(['a', 'b', 'c', 'd']) AS p)")
def _(s, d):
    mocked = readers.mock_answers(table(s, d, "nation").select(F.col("n_name").alias("question")), ["a", "b", "c", "d"])
    return mocked.select("question", "platform", F.col("status").isin(*readers.MODES).alias("asked"))


@query(
    "s5_search_results",
    "WITH l AS (SELECT page_id AS arrival, CASE page_id % 2 WHEN 0 THEN 'x' ELSE 'y' END AS provider, page_id % 7 AS query, url, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS normal_url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY provider, query ORDER BY arrival) AS rank FROM l) SELECT normal_url, arg_min(provider, arrival) AS provider, arg_min(rank, arrival) AS rank FROM r GROUP BY 1",
)
def _(s, d):
    landed = table(s, d, "pages").select(F.col("page_id").alias("arrival"), F.when(F.col("page_id") % 2 == 0, "x").otherwise("y").alias("provider"), (F.col("page_id") % 7).alias("query"), "url", F.lit("").alias("title"))
    return readers.search_results(landed).select("normal_url", "provider", F.col("rank").cast("long").alias("rank"))


@query("s6_kpi_mapping", "SELECT kpi, mode, count(*) AS n FROM documents JOIN (VALUES ('sov', 'en', 'allowed'), ('sov', 'fr', 'conditional'), ('accuracy', 'en', 'allowed'), ('accuracy', 'de', 'excluded')) v(kpi, q, mode) ON lang = q GROUP BY 1, 2")
def _(s, d):
    # documents are answers, their languages the question types: how many each KPI may use
    mapping = readers.kpi_mapping(s, {"sov": {"allowed": ["en"], "conditional": ["fr"]}, "accuracy": {"allowed": ["en"], "excluded": ["de"]}})
    met = table(s, d, "documents").join(F.broadcast(mapping), F.col("lang") == F.col("question_type"))
    return met.groupBy("kpi", "mode").agg(F.count("*").alias("n"))


@query("s8_field_levels", "SELECT o_orderpriority, coalesce(level, 'P2') AS level, count(*) AS n FROM orders LEFT JOIN (VALUES ('1-URGENT', 'P0'), ('2-HIGH', 'P1')) v(p, level) ON o_orderpriority = p GROUP BY ALL")
def _(s, d):
    levels = readers.lookup(s, {"1-URGENT": "P0", "2-HIGH": "P1"}, "o_orderpriority", "level")
    o = table(s, d, "orders").join(F.broadcast(levels), "o_orderpriority", "left")
    return o.groupBy("o_orderpriority", F.coalesce("level", F.lit("P2")).alias("level")).agg(F.count("*").alias("n"))


@query("s9_catalogue", "SELECT 'region' AS table_name, unnest(['r_regionkey', 'r_name']) AS column_name UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_name', 'n_regionkey'])")
def _(s, d):
    return readers.described(s, {n: table(s, d, n) for n in ("region", "nation")}).select("table_name", "column_name")


# --- sinks -------------------------------------------------------------------


@query("k2_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sinks.updated(o, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), {"o_orderstatus": F.lit("X")}).drop("o_totalprice")


@query("k3_retention", "SELECT event_id FROM events WHERE CASE user_id % 3 WHEN 0 THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY WHEN 1 THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY ELSE true END")
def _(s, d):
    e = table(s, d, "events").withColumn("tenant", (F.col("user_id") % 3).cast("int"))
    plans = s.createDataFrame([(0, 7), (1, 14)], "tenant int, days int")
    return sinks.retained(e, plans, F.expr("timestamp_ntz '2024-01-31'")).select("event_id")


@query(
    "k4_cascading_delete",
    "WITH c AS (SELECT * FROM customer WHERE c_nationkey = 3), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) SELECT 'customer' AS table_name, (SELECT count(*) FROM c) AS n UNION ALL SELECT 'orders', (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l)",
)
def _(s, d):
    tables = {n: table(s, d, n) for n in ("customer", "orders", "lineitem")}
    parents = {"orders": ("customer", "o_custkey", "c_custkey"), "lineitem": ("orders", "l_orderkey", "o_orderkey")}
    return sinks.cascade(tables, parents, tables["customer"].where("c_nationkey = 3").select("c_custkey"), "customer", "c_custkey")[1]


@query("k5_export_round_trip", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    r = table(s, d, "region")
    return sinks.export_csv(sinks.export_json(r, "export"), "export")


@query("k5_manifest", "SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def _(s, d):
    return sinks.manifest({n: table(s, d, n) for n in ("nation", "region")}).select("table_name", "n_rows")


@query("k6_markdown_lines", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def _(s, d):
    return sinks.markdown(table(s, d, "region"), ["r_regionkey", "r_name"])


@query("k10_idempotent_insert", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return sinks.inserted(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"), ["o_custkey"])


# --- quality gates -----------------------------------------------------------


@query(
    "q1_quality_summary",
    "SELECT l_suppkey AS run, count(*) AS n_claims, count(*) FILTER (l_returnflag = 'A') AS n_contradicted, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS n_unsupported, count(*) FILTER (l_linenumber = 1) AS n_p0, round(count(*) FILTER (l_linestatus = 'F') / count(*), 4) AS weak_share FROM lineitem GROUP BY 1",
)
def _(s, d):
    flag, status, n = F.col("l_returnflag"), F.col("l_linestatus"), F.count("*")
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        n.alias("n_claims"), F.count_if(flag == "A").alias("n_contradicted"), F.count_if((flag == "R") & (status == "O")).alias("n_unsupported"),
        F.count_if(F.col("l_linenumber") == 1).alias("n_p0"), F.round(F.count_if(status == "F") / n, 4).alias("weak_share"),
    )


def gate(runs):
    """Codes that block or warn, and whether a report may go out; ``runs`` has the shares of the quality summary."""
    c = F.col
    blocks = F.array_compact(F.array(F.when(c("coverage").isNull(), "COVERAGE_DATA_MISSING").when(c("coverage") < 0.60, "METRIC_COVERAGE_LOW"), F.when(c("speculation") > 0.50, "EXCESSIVE_SPECULATION")))
    warns = F.array_compact(F.array(F.when((c("speculation") > 0.30) & (c("speculation") <= 0.50), "HIGH_SPECULATION_RATIO"), F.when(c("opinion") > 0.60, "HIGH_OPINION_RATIO"), F.when(c("unknown") > 0.20, "HIGH_UNKNOWN_RATIO"), F.when(c("weak") > 0.60, "WEAK_EVIDENCE_DOMINANCE")))
    return runs.select("run", F.array_join(blocks, ",").alias("blocks"), F.array_join(warns, ",").alias("warnings"), (F.size(blocks) == 0).alias("publishable"))


@query(
    "q2_publishable_gate",
    """WITH r AS (SELECT user_id AS run, count(*) FILTER (event_type <> 'error') / count(*) AS coverage, count(*) FILTER (event_type = 'view') * 1.9 / count(*) AS speculation, count(*) FILTER (event_type = 'click') * 3.1 / count(*) AS opinion, count(*) FILTER (event_type = 'signup') / count(*) AS unknown, count(*) FILTER (event_type = 'purchase') * 3.3 / count(*) AS weak FROM events GROUP BY 1)
    SELECT run, concat_ws(',', CASE WHEN coverage < 0.6 THEN 'METRIC_COVERAGE_LOW' END, CASE WHEN speculation > 0.5 THEN 'EXCESSIVE_SPECULATION' END) AS blocks, concat_ws(',', CASE WHEN speculation > 0.3 AND speculation <= 0.5 THEN 'HIGH_SPECULATION_RATIO' END, CASE WHEN opinion > 0.6 THEN 'HIGH_OPINION_RATIO' END, CASE WHEN unknown > 0.2 THEN 'HIGH_UNKNOWN_RATIO' END, CASE WHEN weak > 0.6 THEN 'WEAK_EVIDENCE_DOMINANCE' END) AS warnings, coverage >= 0.6 AND speculation <= 0.5 AS publishable FROM r""",
)
def _(s, d):
    # factors are decimals, as in the SQL: 17.1 / 57 lies above the double 0.3, while 9 * 1.9 / 57 in doubles is just 0.3
    share = lambda kind, k="1.0": (F.count_if(F.col("event_type") == kind) * F.lit(Decimal(k))).cast("double") / F.count("*")
    runs = table(s, d, "events").groupBy(F.col("user_id").alias("run")).agg(
        (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("coverage"), share("view", "1.9").alias("speculation"), share("click", "3.1").alias("opinion"), share("signup").alias("unknown"), share("purchase", "3.3").alias("weak")
    )
    return gate(runs)


@query(
    "q3_sample_sufficiency",
    """WITH p AS (SELECT conv_id % 30 AS run, conv_id % 4 AS platform, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL)
    SELECT run, sum(n)::BIGINT AS total, count(*) FILTER (n >= 3) AS n_ok, CASE WHEN sum(n) = 0 THEN 'no_data' WHEN sum(n) < 10 OR count(*) < 2 THEN 'insufficient' WHEN count(*) FILTER (n >= 3) < count(*) THEN 'partial' ELSE 'ok' END AS status FROM p GROUP BY 1""",
)
def _(s, d):
    p = table(s, d, "conversations").where("role = 'assistant'").groupBy((F.col("conv_id") % 30).alias("run"), (F.col("conv_id") % 4).alias("platform")).agg(F.count("*").alias("n"))
    total, k, ok = F.sum("n"), F.count("*"), F.count_if(F.col("n") >= 3)
    status = F.when(total == 0, "no_data").when((total < 10) | (k < 2), "insufficient").when(ok < k, "partial").otherwise("ok")
    return p.groupBy("run").agg(total.alias("total"), ok.alias("n_ok"), status.alias("status"))


@query("q4_analysis_trigger", "SELECT lang, count(DISTINCT source) >= 2 AND count(*) >= 10 AS may_run FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(((F.countDistinct("source") >= 2) & (F.count("*") >= 10)).alias("may_run"))


@query("q5_insights", "SELECT o_orderpriority AS finding, CASE WHEN count(DISTINCT o_orderstatus) >= 3 THEN 'high' WHEN count(DISTINCT o_orderstatus) = 2 THEN 'medium' ELSE 'low' END AS confidence, min(o_orderstatus) AS worst FROM orders GROUP BY 1")
def _(s, d):
    n = F.countDistinct("o_orderstatus")
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("finding")).agg(T.ladder(n, [(3, "high"), (2, "medium")], "low").alias("confidence"), F.min("o_orderstatus").alias("worst"))


@query("q6_action_themes", "SELECT l_suppkey % 20 AS field, l_returnflag AS severity, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL ORDER BY n DESC, field, severity LIMIT 10")
def _(s, d):
    l = table(s, d, "lineitem").where("l_linestatus = 'O'")
    return l.groupBy((F.col("l_suppkey") % 20).alias("field"), F.col("l_returnflag").alias("severity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "severity").limit(10)


@query("q8_content_packages", "SELECT o_custkey, CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS risk, CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 'needs_review' ELSE 'draft' END AS status FROM orders GROUP BY 1")
def _(s, d):
    worst = F.min("o_orderpriority")
    return table(s, d, "orders").groupBy("o_custkey").agg(F.when(worst == "1-URGENT", "high").when(worst == "2-HIGH", "medium").otherwise("low").alias("risk"), F.when(worst == "1-URGENT", "needs_review").otherwise("draft").alias("status"))


@query("q9_platform_variants", "SELECT p_partkey, 'web' AS platform, p_name || ': ' || p_type AS body FROM part UNION ALL SELECT p_partkey, 'card', left(p_name, 6) FROM part")
def _(s, d):
    made = F.array(F.struct(F.lit("web").alias("platform"), F.concat_ws(": ", "p_name", "p_type").alias("body")), F.struct(F.lit("card").alias("platform"), F.left("p_name", F.lit(6)).alias("body")))
    return table(s, d, "part").select("p_partkey", F.inline(made))


@query("q11_summary_line", "SELECT c_mktsegment AS segment, c_mktsegment || ': ' || count(*) || ' brands, ' || count(*) FILTER (c_acctbal < 0) || ' at risk' AS line FROM customer GROUP BY 1")
def _(s, d):
    line = F.format_string("%s: %d brands, %d at risk", F.col("c_mktsegment"), F.count("*"), F.count_if(F.col("c_acctbal") < 0))
    return table(s, d, "customer").groupBy("c_mktsegment").agg(line.alias("line")).withColumnRenamed("c_mktsegment", "segment")


# Allowed transitions of a task.
TRANSITIONS = [("click", "view"), ("view", "click"), ("view", "purchase"), ("signup", "view"), ("error", "view")]


def moves(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").select("event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state")).where("from_state is not null")


@query(
    "q14_transition_check",
    "WITH m AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f, event_type AS t FROM events) SELECT event_id, f || '>' || t IN ('click>view', 'view>click', 'view>purchase', 'signup>view', 'error>view') AS allowed FROM m WHERE f IS NOT NULL",
)
def _(s, d):
    return flows.validated(moves(s, d), s.createDataFrame(TRANSITIONS, "from_state string, to_state string")).select("event_id", "allowed")


# --- tenants -----------------------------------------------------------------


@query(
    "x1_quota",
    "SELECT n_name, count(c_custkey) AS used, CASE WHEN n_nationkey % 4 = 0 THEN -1 WHEN n_nationkey % 4 = 1 THEN 70 ELSE 60 END AS quota, CASE WHEN n_nationkey % 4 = 0 THEN true ELSE count(c_custkey) < CASE WHEN n_nationkey % 4 = 1 THEN 70 ELSE 60 END END AS may_add FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey",
)
def _(s, d):
    n, c = table(s, d, "nation"), table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("used"))
    k = F.col("n_nationkey") % 4
    override = F.when(k == 1, 70)
    quota = F.when(k == 0, -1).otherwise(F.coalesce(override, F.lit(60)))
    used = F.coalesce("used", F.lit(0))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_name", used.alias("used"), quota.alias("quota"), F.when(quota == -1, True).otherwise(used < quota).alias("may_add"))


@query("x2_entitlements", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'override' WHEN s_nationkey < 5 THEN 'plan' ELSE 'default' END AS origin FROM supplier")
def _(s, d):
    sup = table(s, d, "supplier")
    override = sup.where("s_suppkey % 10 = 0").select("s_suppkey", F.lit("override").alias("o"))
    plan = table(s, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("plan").alias("p"))
    return sup.join(override, "s_suppkey", "left").join(F.broadcast(plan), "s_nationkey", "left").select("s_suppkey", F.coalesce("o", "p", F.lit("default")).alias("origin"))


@query("x3_usage_reconcile", "SELECT user_id, count(*) AS counted, max(event_id % 90) AS recorded, count(*) <> max(event_id % 90) AS differs FROM events GROUP BY 1")
def _(s, d):
    n, m = F.count("*"), F.max(F.col("event_id") % 90)
    return table(s, d, "events").groupBy("user_id").agg(n.alias("counted"), m.alias("recorded"), (n != m).alias("differs"))


@query("x5_queue_summary", "SELECT count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders")
def _(s, d):
    n = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(s, d, "orders").agg(n("P").alias("running"), n("O").alias("queued"), n("F").alias("done"), F.count("*").alias("total"))


@query(
    "x6_org_dashboard",
    "WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) SELECT c_nationkey AS org, count(*) AS n_brands, count(v) AS n_with_data, round(avg(v), 4) AS mean FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1",
)
def _(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    c = table(s, d, "customer")
    return c.join(last, c.c_custkey == last.o_custkey, "left").groupBy(F.col("c_nationkey").alias("org")).agg(F.count("*").alias("n_brands"), F.count("v").alias("n_with_data"), F.round(F.avg("v"), 4).alias("mean"))


@query("x7_latest_evidence", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 60) GROUP BY 1")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(60).groupBy("event_type").agg(F.count("*").alias("n"))


@query("x8_review_counts", "SELECT l_returnflag AS severity, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS done, round(count(*) FILTER (l_linestatus = 'F') / count(*), 4) AS rate FROM lineitem GROUP BY 1")
def _(s, d):
    n, k = F.count("*"), F.count_if(F.col("l_linestatus") == "F")
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("severity")).agg(n.alias("n"), k.alias("done"), F.round(k / n, 4).alias("rate"))


@query("x9_brand_list", "SELECT c_custkey, c_name, count(o_orderkey) AS n_runs, max(o_orderkey) AS last_run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def _(s, d):
    runs = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_runs"), F.max("o_orderkey").alias("last_run"))
    c = table(s, d, "customer")
    return c.join(runs, c.c_custkey == runs.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "last_run")


@query(
    "x10_audit_chain",
    "WITH h AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS h, CASE WHEN event_id % 97 = 0 THEN 'bad' END AS broken FROM events), p AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY event_id) AS want FROM h) SELECT user_id, count(*) FILTER (want IS NOT NULL AND coalesce(broken, want) <> want) AS n_broken FROM p GROUP BY 1",
)
def _(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    h = table(s, d, "events").select("user_id", "event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"))
    p = h.withColumn("want", F.lag("h").over(w)).withColumn("said", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.col("want")))
    return p.groupBy("user_id").agg(F.count_if(F.col("want").isNotNull() & (F.col("said") != F.col("want"))).alias("n_broken"))


@query("x11_dry_run_counts", "SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey = 3")
def _(s, d):
    c = table(s, d, "customer").where("c_nationkey = 3").agg(F.lit("customer").alias("table_name"), F.count("*").alias("n"))
    return c.unionByName(table(s, d, "supplier").where("s_nationkey = 3").agg(F.lit("supplier").alias("table_name"), F.count("*").alias("n")))


@query("x12_compliance", "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'blocked' WHEN contains(lower(text), 'license') THEN 'review' ELSE 'ok' END AS outcome FROM documents")
def _(s, d):
    low = F.lower("text")
    return table(s, d, "documents").select("doc_id", F.when(T.any_contains(low, ("idiot", "scum")), "blocked").when(T.any_contains(low, ("license",)), "review").otherwise("ok").alias("outcome"))


@query("x13_filtered_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
def _(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(25).limit(25).select("o_orderkey")


@query("x15_branding", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 9 = 0 THEN 'brand' END, CASE WHEN c_nationkey < 8 THEN 'org' END, 'default') AS theme FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 9 == 0, "brand"), F.when(F.col("c_nationkey") < 8, "org"), F.lit("default")).alias("theme"))


@query("x17_cluster_keys", "SELECT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS cluster, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber").alias("cluster")).agg(F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------


def stream(s, d):
    return flows.read(s, f"{d}/events.parquet")


@query("st1_hourly_alerts", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS hour FROM events WHERE event_type = 'error'")
def _(s, d):
    return flows.drained(flows.hourly_alerts(stream(s, d).where("event_type = 'error'")))


@query("st2_tumbling_counts", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return flows.drained(flows.tumbling(stream(s, d)), ["user_id", "bucket"])


@query("st3_sliding_counts", "SELECT event_type, start, count(*) AS requests, sum(round(value * 100)::BIGINT)::BIGINT AS tokens FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2")
def _(s, d):
    return flows.drained(flows.sliding(stream(s, d)), ["event_type", "start"])


@query("st4_circuit_breaker")
def _(s, d):
    # a fold with feedback, which SQL cannot express; tests hold it against a plain loop
    return flows.drained(flows.breaker_states(stream(s, d)))


@query("st5_consecutive_failures", "WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events), c AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) AS fails FROM r) SELECT event_id, CASE WHEN fails >= 5 THEN 'failing' WHEN fails >= 3 THEN 'degraded' ELSE 'healthy' END AS health FROM c")
def _(s, d):
    run = F.count_if(F.col("event_type") != "error").over(W.partitionBy("user_id").orderBy("event_id"))
    r = table(s, d, "events").withColumn("run", run)
    fails = F.count_if(F.col("event_type") == "error").over(W.partitionBy("user_id", "run").orderBy("event_id"))
    return r.select("event_id", T.ladder(fails, [(5, "failing"), (3, "degraded")], "healthy").alias("health"))


@query("st6_lifecycle", "SELECT event_type = 'error' AS failed, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS n_allowed FROM events GROUP BY 1")
def _(s, d):
    table_ = s.createDataFrame([("new", "view"), ("new", "click")], "from_state string, to_state string")
    asked = stream(s, d).select("event_id", F.lit("new").alias("from_state"), F.col("event_type").alias("to_state"))
    done = flows.drained(flows.validated(asked, table_))
    return done.groupBy((F.col("to_state") == "error").alias("failed")).agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("st7_sessions", "WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS cut FROM events), s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(s, d):
    # the whole table: sessions still open at its end count, and no file's rows are late; such a batch's state is too large for the heap
    events, end = flows.ending(flows.read(s, f"{d}/events.parquet", None))
    with timed.rocks(s):
        return flows.drained(flows.sessions(events), end=end)


@query("st8_retry_policy", "SELECT event_id, CASE WHEN event_id % 6 >= 4 THEN 'dead' WHEN ts < TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR THEN 'aged_out' ELSE 'retry' END AS action, CASE event_id % 6 WHEN 0 THEN 300 WHEN 1 THEN 900 ELSE 1800 END AS wait_s FROM events WHERE event_type = 'error'")
def _(s, d):
    k = F.col("event_id") % 6
    action = F.when(k >= 4, "dead").when(F.expr("ts < timestamp_ntz '2024-01-30' - interval 24 hours"), "aged_out").otherwise("retry")
    return table(s, d, "events").where("event_type = 'error'").select("event_id", action.alias("action"), F.when(k == 0, 300).when(k == 1, 900).otherwise(1800).alias("wait_s"))


@query("st9_callbacks", "SELECT DISTINCT event_id // 2 AS callback_id FROM events WHERE event_id % 10 < 7")
def _(s, d):
    late = F.when(F.col("event_id") % 10 < 7, 10).otherwise(900)
    arrived = stream(s, d).withColumn("received", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + late)).withColumn("callback_id", F.expr("event_id div 2"))
    return flows.drained(flows.callbacks(arrived))


@query("st10_expiry_sweep", "SELECT user_id, count(*) FILTER (ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-31') AS n_expired FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(F.expr("ts + interval 3 days < timestamp_ntz '2024-01-31'")).alias("n_expired"))


@query("st11_alert_upsert", "SELECT user_id, count(*) FILTER (event_type IN ('error', 'signup')) AS occurrences, max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS severity, arg_max(event_type, event_id) = 'purchase' AS resolved FROM events GROUP BY 1")
def _(s, d):
    return flows.drained(flows.alert_table(stream(s, d)), ["user_id"])


@query("st17_status_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'unknown' END AS run_status FROM orders")
def _(s, d):
    known = readers.lookup(s, {"F": "completed", "P": "running"}, "o_orderstatus", "run_status")
    return table(s, d, "orders").join(F.broadcast(known), "o_orderstatus", "left").select("o_orderkey", F.coalesce("run_status", F.lit("unknown")).alias("run_status"))


@query("st19_limiter_health", "SELECT user_id, CASE WHEN count(*) < 40 THEN 'disabled' WHEN count(*) FILTER (event_type = 'error') / count(*) > 0.3 THEN 'rate_limited' WHEN count(*) FILTER (event_type = 'error') / count(*) > 0.2 THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY 1")
def _(s, d):
    n, share = F.count("*"), F.count_if(F.col("event_type") == "error") / F.count("*")
    return table(s, d, "events").groupBy("user_id").agg(F.when(n < 40, "disabled").when(share > 0.3, "rate_limited").when(share > 0.2, "degraded").otherwise("healthy").alias("health"))
