"""Filters, joins, aggregations, windows, top-k and set operations on the stand-in tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.operators.ranking import numbered
from answerscope.plans.registry import query, table

# --- filters and projections -------------------------------------------------


@query("p1_and_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1998-01-01'")
def _(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000 and o_orderdate >= timestamp_ntz '1998-01-01'").select("o_orderkey", "o_totalprice")


@query("p2_or_null", "SELECT e.event_id, json_extract_string(props, '$.k') AS k FROM events e WHERE json_extract_string(props, '$.k') = '7' OR json_extract_string(props, '$.k') IS NULL")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("event_id", k.alias("k")).where((F.col("k") == "7") | F.col("k").isNull())


@query("p3_in_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(s, d):
    return table(s, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p4_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    c = table(s, d, "customer")
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("p5_null_checks", "SELECT count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (text IS NOT NULL AND text <> '') AS n_filled, count(*) FILTER (text = '') AS n_empty FROM documents")
def _(s, d):
    t = F.col("text")
    return table(s, d, "documents").agg(F.count_if(t.isNull()).alias("n_null"), F.count_if(t.isNotNull() & (t != "")).alias("n_filled"), F.count_if(t == "").alias("n_empty"))


@query("p6_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def _(s, d):
    return table(s, d, "part").where(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name")


@query("p7_not_in", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("p8_date_range", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def _(s, d):
    o = table(s, d, "orders").where("o_orderdate between timestamp_ntz '1997-01-01' and timestamp_ntz '1997-12-31'")
    return o.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("p9_last_hour", "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1")
def _(s, d):
    as_of = F.expr("timestamp_ntz '2024-01-30 12:00:00'")
    return table(s, d, "events").where((F.col("ts") > as_of - F.expr("interval 1 hour")) & (F.col("ts") <= as_of)).groupBy("event_type").agg(F.count("*").alias("n"))


def faceted(df, filters: dict, order: list, page: int, size: int):
    """Equality filters of those facets that are given, and one page of the ordered rows."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


@query("p10_facets_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50 OFFSET 100")
def _(s, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return faceted(table(s, d, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F", "l_suppkey": None}, order, 3, 50).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("p12_json_path", "SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def _(s, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"))


@query("p13_json_element", "SELECT user_id, max(theme) AS theme FROM (SELECT user_id, json_extract_string('[' || props || ']', '$[0].k') AS theme FROM events) GROUP BY 1")
def _(s, d):
    first = F.get_json_object(F.concat(F.lit("["), "props", F.lit("]")), "$[0].k")
    return table(s, d, "events").select("user_id", first.alias("theme")).groupBy("user_id").agg(F.max("theme").alias("theme"))


# --- joins -------------------------------------------------------------------


@query("j1_broadcast_lookup", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")  # nation is a fixed list of countries
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query("j2_inner", "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    l, o = table(s, d, "lineitem"), table(s, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(
    "j3_left_latest",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey",
)
def _(s, d):
    # the greatest struct is the latest order: one partial aggregate instead of a sort by customer
    latest = table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    c = table(s, d, "customer")
    return c.join(latest, c.c_custkey == latest.o_custkey, "left").select("c_custkey", F.col("last.o_orderkey").alias("o_orderkey"))


@query("j5_coalesce_join", "SELECT s_suppkey, coalesce(r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def _(s, d):
    sup, n, r = table(s, d, "supplier"), table(s, d, "nation"), table(s, d, "region").where("r_name <> 'ASIA'")
    joined = sup.join(F.broadcast(n), sup.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return joined.select("s_suppkey", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("j8_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("j9_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 499000) AS found, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS negative")
def _(s, d):
    o = table(s, d, "orders")
    return o.agg(F.coalesce(F.bool_or(F.col("o_totalprice") > 499000), F.lit(False)).alias("found"), F.coalesce(F.bool_or(F.col("o_totalprice") < 0), F.lit(False)).alias("negative"))


@query("j10_lookup_default", "SELECT coalesce(source, 'unknown') AS platform, count(*) AS n FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON l.doc_id = d.doc_id GROUP BY 1")
def _(s, d):
    l, docs = table(s, d, "labels"), table(s, d, "documents").where("lang <> 'en'").select("doc_id", "source")
    return l.join(docs, "doc_id", "left").groupBy(F.coalesce("source", F.lit("unknown")).alias("platform")).agg(F.count("*").alias("n"))


@query("j12_job_fanout", "SELECT r_name, n_name, i AS question FROM region, nation, (SELECT unnest([1, 2, 3]) AS i)")
def _(s, d):
    # jobs of a run: platforms x templates x their questions; both sides are short configuration lists
    platforms, templates = table(s, d, "region"), table(s, d, "nation")
    questions = templates.select("n_name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("question"))
    names = platforms.agg(F.collect_list("r_name").alias("names"))
    return questions.join(F.broadcast(names), F.lit(True)).select(F.explode("names").alias("r_name"), "n_name", "question")


@query("j13_self_pairs", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s, d):
    n = table(s, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("i < j").select("a", "b")


@query(
    "j14_version_diff",
    """WITH a AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""",
)
def _(s, d):
    def version(year, name):
        return table(s, d, "orders").where(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias(name))

    both = version(1997, "v").join(version(1998, "w"), "k", "full_outer")
    change = F.when(F.col("v").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("v") == F.col("w"), "unchanged").otherwise("changed")
    return both.select("k", change.alias("change"))


@query(
    "j16_windows_around_event",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, count(*) FILTER (e.ts < p.ts) AS n_before, count(*) FILTER (e.ts >= p.ts) AS n_after FROM p JOIN e ON p.user_id = e.user_id AND e.ts >= p.ts - INTERVAL 2 DAY AND e.ts < p.ts + INTERVAL 1 DAY GROUP BY 1""",
)
def _(s, d):
    # day buckets make the range condition an equi-join: an event meets the four days its window can touch
    e = table(s, d, "events")
    p = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("at"), F.explode(F.sequence(F.to_date(F.expr("ts - interval 2 days")), F.to_date(F.expr("ts + interval 1 day")))).alias("day"))
    v = e.where("event_type = 'view'").select("user_id", "ts", F.to_date("ts").alias("day"))
    inside = (F.col("ts") >= F.expr("at - interval 2 days")) & (F.col("ts") < F.expr("at + interval 1 day"))
    return p.join(v, ["user_id", "day"]).where(inside).groupBy("event_id").agg(F.count_if(F.col("ts") < F.col("at")).alias("n_before"), F.count_if(F.col("ts") >= F.col("at")).alias("n_after"))


@query(
    "j17_previous_run",
    "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS delta FROM orders",
)
def _(s, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    delta = F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2)
    return table(s, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), delta.alias("delta"))


@query(
    "j17_asof_join",
    "SELECT a.event_id, b.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts",
)
def _(s, d):
    # as-of by one sorted pass over the union of both sides, instead of a range join
    e = table(s, d, "events").where(F.col("event_type").isin("purchase", "click"))
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return e.withColumn("last_click", F.last(click, ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_click")


@query(
    "j18_fallback_lookup",
    "SELECT p_partkey, coalesce(n.n_name, r.r_name, 'unknown') AS label FROM part LEFT JOIN nation n ON p_size = n.n_nationkey AND p_size > 10 LEFT JOIN region r ON p_size = r.r_regionkey",
)
def _(s, d):
    p, n, r = table(s, d, "part"), table(s, d, "nation"), table(s, d, "region")
    joined = p.join(F.broadcast(n), (p.p_size == n.n_nationkey) & (p.p_size > 10), "left").join(F.broadcast(r), p.p_size == r.r_regionkey, "left")
    return joined.select("p_partkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("label"))


@query(
    "j19_array_members",
    """WITH sets AS (SELECT n_nationkey AS brand, unnest([n_nationkey * 7 % 1600, n_nationkey * 13 % 90 + 1450, 99999999]) AS member FROM nation)
    SELECT brand, member, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'negative' WHEN o.k IS NULL THEN 'no_orders' ELSE 'ok' END AS reason
    FROM sets LEFT JOIN customer ON member = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON member = o.k""",
)
def _(s, d):
    k = F.col("n_nationkey")
    sets = table(s, d, "nation").select(k.alias("brand"), F.explode(F.array(k * 7 % 1600, k * 13 % 90 + 1450, F.lit(99999999))).alias("member"))
    c, o = table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    joined = sets.join(c, sets.member == c.c_custkey, "left").join(o, sets.member == o.k, "left")
    reason = F.when(F.col("c_custkey").isNull(), "unknown").when(F.col("c_acctbal") < 0, "negative").when(F.col("k").isNull(), "no_orders").otherwise("ok")
    return joined.select("brand", "member", reason.alias("reason"))


# --- aggregations ------------------------------------------------------------


@query("a1_count_filtered", "SELECT count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_large"))


@query("a2_distinct_platforms", "SELECT lang, count(DISTINCT source) AS platforms FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("platforms"))


@query("a3_platform_health", "SELECT user_id AS platform, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("platform")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.round(F.avg("value"), 6).alias("avg_latency"))


@query("a4_three_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("a5_pivot_buckets", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == x).alias(x.lower()) for x in "FOP"])


@query("a6_matrix", "SELECT l_returnflag, coalesce(count(*) FILTER (l_linestatus = 'F'), 0) AS f, coalesce(count(*) FILTER (l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY 1")
def _(s, d):
    wide = table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("a7_month_to_date", "SELECT coalesce(sum(value), 0) AS spent FROM (SELECT round(value * 100)::BIGINT AS value FROM events WHERE event_type = 'purchase' AND ts >= date_trunc('month', TIMESTAMP '2024-01-20') AND ts < TIMESTAMP '2024-01-20')".replace("sum(value), 0)", "sum(value), 0)::BIGINT"))
def _(s, d):
    e = table(s, d, "events").where("event_type = 'purchase' and ts >= date_trunc('month', timestamp_ntz '2024-01-20') and ts < timestamp_ntz '2024-01-20'")
    return e.agg(F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)).alias("spent"))


@query(
    "a8_meter_rollup",
    "SELECT user_id AS org, strftime(ts, '%Y-%m') AS period, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 20) GROUP BY 1, 2",
)
def _(s, d):
    e = table(s, d, "events")
    done = e.where("event_id < 20").select("user_id")  # periods that are rolled up already
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    rolled = e.join(done, "user_id", "left_anti").groupBy(F.col("user_id").alias("org"), F.date_format("ts", "yyyy-MM").alias("period"))
    return rolled.agg(count("click").alias("clicks"), count("view").alias("views"), count("error").alias("errors"))


@query("a9_counters", "SELECT lang, string_agg(source || ':' || n, ',' ORDER BY source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def _(s, d):
    each = table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("source", "n")))
    return each.groupBy("lang").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["source"], F.lit(":"), x["n"].cast("string"))), ",").alias("counts"))


@query("a10_safe_ratio", "SELECT user_id, CASE WHEN count(*) FILTER (event_type <> 'view') > 0 THEN round(count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type <> 'view'), 4) ELSE 0.0 END AS rate FROM events GROUP BY 1")
def _(s, d):
    n, k = F.count_if(F.col("event_type") != "view"), F.count_if(F.col("event_type") == "error")
    return table(s, d, "events").groupBy("user_id").agg(F.when(n > 0, F.round(k / n, 4)).otherwise(0.0).alias("rate"))


@query(
    "a12_variance",
    "SELECT event_type, round(var_pop(value), 6) AS variance, round(stddev_pop(value) / avg(value), 6) AS cv, round(median(value), 6) AS median FROM events GROUP BY 1",
)
def _(s, d):
    v = F.col("value")
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.var_pop(v), 6).alias("variance"), F.round(F.stddev_pop(v) / F.avg(v), 6).alias("cv"), F.round(F.median(v), 6).alias("median"))


@query("a14_latest_value", "SELECT user_id, arg_max(value, event_id) AS latest FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("latest"))


@query(
    "a15_worst_severity",
    "SELECT o_custkey, arg_min(o_orderpriority, o_orderpriority) AS worst, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END) WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS severity FROM orders GROUP BY 1",
)
def _(s, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    worst = F.min(rank)
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderpriority").alias("worst"), F.when(worst == 0, "P0").when(worst == 1, "P1").otherwise("P2").alias("severity"))


@query(
    "a16_index_p95",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(CASE WHEN i = CASE WHEN n >= 20 THEN floor(n * 0.95) + 1 ELSE n END THEN value END) AS p95, round(avg(value), 4) AS mean FROM s GROUP BY 1""",
)
def _(s, d):
    # places come from one range sort, which splits large groups; the value at the wanted place is one row
    e = table(s, d, "events").select("user_id", "value")
    placed = numbered(e, ["user_id"], [F.col("value").asc_nulls_last()])
    index = F.when(F.col("size") >= 20, F.floor(F.col("size") * F.expr("0.95BD")) + 1).otherwise(F.col("size"))
    return placed.groupBy("user_id").agg(F.max(F.when(F.col("place") == index, F.col("value"))).alias("p95"), F.round(F.avg("value"), 4).alias("mean"))


@query("a17_set_sizes", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.countDistinct("o_orderpriority").alias("n_priorities"))


@query("a18_joined_text", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE role = 'assistant' GROUP BY 1")
def _(s, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(s, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n")).alias("digest"))


@query(
    "a19_confusion",
    """WITH p AS (SELECT l.toxic AS expected, CASE WHEN regexp_matches(lower(text), 'idiot|moron|stupid|scum') THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    c AS (SELECT count(*) FILTER (expected = 1 AND predicted = 1) AS tp, count(*) FILTER (expected = 0 AND predicted = 1) AS fp, count(*) FILTER (expected = 1 AND predicted = 0) AS fn, count(*) FILTER (expected = predicted) AS hits, count(*) AS n FROM p)
    SELECT tp, fp, fn, round(hits / n, 6) AS accuracy, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c""",
)
def _(s, d):
    predicted = F.lower("text").rlike("idiot|moron|stupid|scum").cast("int")
    p = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", predicted.alias("predicted")), "doc_id")
    e, g = F.col("toxic") == 1, F.col("predicted") == 1
    c = p.agg(F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn"), F.count_if(F.col("toxic") == F.col("predicted")).alias("hits"), F.count("*").alias("n"))
    tp, fp, fn, one = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(1)
    return c.select("tp", "fp", "fn", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), F.round(tp / F.greatest(tp + fp, one), 6).alias("precision"), F.round(tp / F.greatest(tp + fn, one), 6).alias("recall"), F.round(2 * tp / F.greatest(2 * tp + fp + fn, one), 6).alias("f1"))


@query(
    "a20_parent_status",
    "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'completed' WHEN count(*) FILTER (o_orderstatus = 'O') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1",
)
def _(s, d):
    n = lambda x: F.count_if(F.col("o_orderstatus") == x)
    status = F.when(n("P") > 0, "running").when(n("F") == F.count("*"), "completed").when(n("O") == F.count("*"), "failed").otherwise("partial")
    return table(s, d, "orders").groupBy("o_custkey").agg(status.alias("status"))


@query("a22_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# --- windows -----------------------------------------------------------------


@query("w1_latest_per_brand", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def _(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("r"))
    return last.select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("w2_latest_per_theme", "SELECT json_extract_string(props, '$.k') AS theme, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.get_json_object("props", "$.k").alias("theme")).agg(F.max("event_id").alias("event_id"))


@query("w4_latest_within_days", "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type = 'view' GROUP BY 1")
def _(s, d):
    recent = table(s, d, "events").where("ts >= timestamp_ntz '2024-01-31' - interval 7 days and event_type = 'view'")
    return recent.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@query("w5_step_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("w6_zscore", "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type, user_id % 10)")
def _(s, d):
    w = W.partitionBy("event_type", F.col("user_id") % 10)
    return table(s, d, "events").select("event_id", F.round((F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w), 6).alias("z"))


@query("w7_slope", "SELECT user_id, CASE WHEN count(*) > 1 THEN round((arg_max(value, event_id) - arg_min(value, event_id)) / (count(*) - 1), 6) ELSE 0.0 END AS slope FROM events GROUP BY 1")
def _(s, d):
    n = F.count("*")
    slope = F.when(n > 1, F.round((F.max_by("value", "event_id") - F.min_by("value", "event_id")) / (n - 1), 6)).otherwise(0.0)
    return table(s, d, "events").groupBy("user_id").agg(slope.alias("slope"))


@query("w8_changes", "SELECT event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(s, d, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where("not (before <=> event_type)").select("event_id", "event_type")


@query(
    "w9_hash_chain",
    "WITH h AS (SELECT event_id, user_id, md5(event_id || ':' || event_type) AS h FROM events) SELECT event_id, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY event_id), 'genesis') AS previous_hash FROM h",
)
def _(s, d):
    h = table(s, d, "events").select("event_id", "user_id", F.md5(F.concat_ws(":", "event_id", "event_type")).alias("h"))
    w = W.partitionBy("user_id").orderBy("event_id")
    return h.select("event_id", F.coalesce(F.lag("h").over(w), F.lit("genesis")).alias("previous_hash"))


@query(
    "w10_two_before",
    "SELECT user_id, event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2",
)
def _(s, d):
    # the two greatest ids of a user: a bounded aggregate instead of a sort of all rows
    e = table(s, d, "events").where("ts < timestamp_ntz '2024-01-15'")
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return e.withColumn("i", F.row_number().over(w)).where("i <= 2").select("user_id", "event_id")


@query("w11_rank_in_provider", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def _(s, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(s, d, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("rank"))


@query("w12_first_per_url", "SELECT min(page_id) AS page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS u FROM pages GROUP BY 2")
def _(s, d):
    u = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "")
    return table(s, d, "pages").groupBy(u.alias("u")).agg(F.min("page_id").alias("page_id"))


@query(
    "w13_trailing_sums",
    "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"),
)
def _(s, d):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    w = W.partitionBy(F.col("user_id") % 20).orderBy(seconds).rangeBetween(-3600, 0)
    return table(s, d, "events").select("event_id", F.count("*").over(w).alias("requests"), F.round(F.sum("value").over(w), 4).alias("tokens"))


@query("w14_fixed_window", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("bucket"), "n")


# --- order, top-k, sets ------------------------------------------------------


@query("t1_latest_one", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "event_type")


@query("t2_page_with_total", "SELECT o_orderkey, total FROM (SELECT *, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40)")
def _(s, d):
    o = table(s, d, "orders")
    page = o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(o.agg(F.count("*").alias("total"))), F.lit(True)).select("o_orderkey", "total")


@query("t3_case_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def _(s, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).cast("long").alias("place"))


@query("t4_top_clusters", "SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_partkey, l_returnflag LIMIT 10")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey", "l_returnflag").limit(10)


@query("t5_top_risks", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount * (1 + l_tax), 6) AS score FROM lineitem ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey LIMIT 3")
def _(s, d):
    score = F.round(F.col("l_quantity") * F.col("l_discount") * (1 + F.col("l_tax")), 6)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score")).orderBy(F.desc("score"), "l_orderkey", "l_linenumber", "l_partkey").limit(3)


@query("t7_first_three", "SELECT user_id, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 3), ',') AS firsts FROM events GROUP BY 1")
def _(s, d):
    # ranks are cut off at three before the shuffle, so that no group is collected
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    first = table(s, d, "events").select("user_id", "event_id").withColumn("place", place).where("place <= 3")
    return first.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("firsts"))


@query("t8_capped_sample", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 50")
def _(s, d):
    return table(s, d, "orders").where("o_totalprice > 300000").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@query("d1_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(s, d):
    return table(s, d, "part").select("p_brand", "p_type").distinct()


@query("d2_union_sources", "SELECT 'document' AS kind, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages")
def _(s, d):
    docs = table(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    pages = table(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@query(
    "d3_token_sets",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_name || ' ' || p_type), ' ') AS b FROM part)
    SELECT p_partkey, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either FROM t""",
)
def _(s, d):
    t = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("b"))
    return t.select("p_partkey", F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


@query(
    "d4_missing_required",
    "SELECT o_custkey, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(list(DISTINCT o_orderstatus), x))), ',') AS missing FROM orders GROUP BY 1",
)
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_except(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.collect_set("o_orderstatus")), ",").alias("missing"))


@query("d7_set_operations", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    of = lambda x: table(s, d, "orders").where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).exceptAll(of("P").distinct()).distinct()
