"""Benchmark and trend queries: customers and events stand in for brands and metric series."""

from pyspark.sql import functions as F

from answerscope.operators import benchmark as B
from answerscope.operators import trends as R
from answerscope.plans.registry import query, table

AS_OF = "timestamp_ntz '2024-01-31'"


def series(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("kpi"), "ts", (F.col("value") / 397).alias("value"), F.col("event_id").alias("seq"))


SERIES = "(SELECT user_id AS entity, event_type AS kpi, ts, value / 397 AS value, event_id AS seq FROM events)"
STEPS = f"(SELECT *, row_number() OVER o AS i, lag(value) OVER o AS previous, count(*) OVER w AS n, avg(value) OVER w AS mean, CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 0.01 END AS std FROM {SERIES} WINDOW o AS (PARTITION BY entity, kpi ORDER BY seq), w AS (PARTITION BY entity, kpi))"
QUALITY = "CASE WHEN {n} < {k} THEN 'insufficient' WHEN {n} < 1.5 * {k} THEN 'low' WHEN {n} >= 3 * {k} THEN 'high' ELSE 'medium' END"


def values(s, d):
    return table(s, d, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("entity"), F.lit("acctbal").alias("kpi"), (F.col("c_acctbal") / 10000).alias("value"))


@query(
    "b1_industry_benchmark",
    f"""WITH v AS (SELECT c_mktsegment AS "group", 'acctbal' AS kpi, c_acctbal / 10000 AS value FROM customer)
    SELECT "group", kpi, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(avg(value), 6) AS mean,
      round(greatest(0.0, avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*))), 6) AS ci_lower, round(least(1.0, avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*))), 6) AS ci_upper, {QUALITY.format(n='count(*)', k=5)} AS quality FROM v GROUP BY ALL""",
)
def _(s, d):
    return B.industry_benchmark(values(s, d))


@query(
    "b2_latest_percentiles",
    """WITH l AS (SELECT event_type, user_id, arg_max(value, (ts, value)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-31' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY ALL)
    SELECT event_type AS kpi, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50 FROM l GROUP BY 1""",
)
def _(s, d):
    snapshots = table(s, d, "events").select(F.lit("all").alias("group"), F.col("user_id").alias("entity"), F.col("event_type").alias("kpi"), "value", "ts")
    return B.industry_benchmark(B.latest_values(snapshots, F.expr(AS_OF), 14)).select("kpi", "n", "p50")


@query("b3_quality_level", f"SELECT n_name, count(c_custkey) AS n, {QUALITY.format(n='count(c_custkey)', k=30)} AS quality FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    n, c = table(s, d, "nation"), table(s, d, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"), B.quality_level(F.count("c_custkey"), 30).alias("quality"))


@query("b4_exclusions", "SELECT coalesce(CASE WHEN c_acctbal < 0 THEN 'demo' WHEN c_nationkey < 3 THEN 'test' WHEN c_mktsegment = 'BUILDING' THEN 'unconfirmed' END, 'eligible') AS reason, count(*) AS n FROM customer GROUP BY 1")
def _(s, d):
    reasons = {"demo": F.col("c_acctbal") < 0, "test": F.col("c_nationkey") < 3, "unconfirmed": F.col("c_mktsegment") == "BUILDING"}
    return B.exclusions(table(s, d, "customer"), reasons).groupBy(F.coalesce("excluded", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "b5_gap_table",
    """WITH v AS (SELECT c_mktsegment AS g, c_custkey AS e, c_nationkey AS nk, c_acctbal / 10000 AS value FROM customer), r AS (SELECT nk, avg(value) AS rivals FROM v GROUP BY 1), p AS (SELECT g, quantile_cont(value, 0.5) AS p50 FROM v GROUP BY 1)
    SELECT e AS entity, round(rivals, 6) AS rivals, round(p50, 6) AS p50, round(value - rivals, 6) AS gap, CASE WHEN abs(value - rivals) >= 0.2 THEN 'large' WHEN abs(value - rivals) >= 0.1 THEN 'moderate' WHEN abs(value - rivals) >= 0.05 THEN 'small' ELSE 'none' END AS significance FROM v JOIN r ON v.nk = r.nk JOIN p ON v.g = p.g""",
)
def _(s, d):
    own = values(s, d)
    c = table(s, d, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    # rivals share a nation: their average comes from sums per nation, not from pairs
    nation = own.join(c, "entity").groupBy("c_nationkey", "kpi").agg(F.avg("value").alias("value"))
    rivals = c.join(nation, "c_nationkey").select("entity", "kpi", "value")
    gaps = B.gap_table(own, rivals, B.industry_benchmark(own))
    return gaps.select("entity", F.round("rivals", 6).alias("rivals"), F.round("p50", 6).alias("p50"), F.round("gap", 6).alias("gap"), "significance")


@query("b6_gap_attribution", "SELECT event_type AS kpi, round(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1), 4) AS gap, round(avg(value) FILTER (user_id % 2 = 0 AND hour(ts) < 12) - avg(value) FILTER (user_id % 2 = 1 AND hour(ts) < 12), 4) AS gap_morning FROM events GROUP BY 1")
def _(s, d):
    own, early, v = F.col("user_id") % 2 == 0, F.hour("ts") < 12, F.col("value")
    mean = lambda c: F.avg(F.when(c, v))
    return table(s, d, "events").groupBy(F.col("event_type").alias("kpi")).agg(F.round(mean(own) - mean(~own), 4).alias("gap"), F.round(mean(own & early) - mean(~own & early), 4).alias("gap_morning"))


@query("b7_display", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '5-LOW' THEN 'hidden' WHEN o_orderpriority = '3-MEDIUM' OR o_orderstatus = 'P' THEN 'reference' ELSE 'full' END AS mode FROM orders")
def _(s, d):
    quality = F.when(F.col("o_orderpriority") == "5-LOW", "insufficient").when(F.col("o_orderpriority") == "3-MEDIUM", "low").otherwise("high")
    fresh = F.when(F.col("o_orderstatus") == "O", "expired").when(F.col("o_orderstatus") == "P", "stale").otherwise("fresh")
    return table(s, d, "orders").select("o_orderkey", B.display_mode(F.lit(9), quality, fresh).alias("mode"))


@query("b8_freshness", "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'fresh' WHEN ts >= TIMESTAMP '2024-01-13' THEN 'stale' ELSE 'expired' END AS freshness FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", B.freshness(F.col("ts"), F.expr("timestamp_ntz '2024-01-20'")).alias("freshness"))


@query("b9_fan_out", "SELECT c_mktsegment AS industry, n_regionkey AS org, count(*) AS n, round(median(c_acctbal), 6) AS p50 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_regionkey), (c_mktsegment))")
def _(s, d):
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    i, o = F.col("c_mktsegment"), F.col("n_regionkey")
    return c.groupingSets([[i, o], [i]], i, o).agg(F.count("*").alias("n"), F.round(F.median("c_acctbal"), 6).alias("p50")).select(i.alias("industry"), o.alias("org"), "n", "p50")


for _how, _sql in (("median", "median(value)"), ("latest", "arg_max(value, seq)"), ("mean", "avg(value)")):

    def _resampled(s, d, how=_how):
        return R.resample(series(s, d), "weekly", how).withColumn("value", F.round("value", 6))

    query(f"r1_resample_{_how}", f"SELECT entity, kpi, year(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS period, round({_sql}, 6) AS value, count(*) AS point_count FROM {SERIES} GROUP BY ALL")(_resampled)


CLIFFS = f"(SELECT * FROM {STEPS} WHERE n >= 4 AND previous > value AND (previous - value) / previous >= 0.2 AND previous - value >= 0.1 AND (value - mean) / std <= -2)"


@query(
    "r2_stability",
    f"""WITH c AS (SELECT entity, kpi, count(*) AS cliffs FROM {CLIFFS} GROUP BY ALL), b AS (SELECT entity, kpi, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM {SERIES} GROUP BY ALL),
    j AS (SELECT b.*, coalesce(cliffs, 0) AS cliffs, least(CASE WHEN mean > 0 THEN std / mean ELSE 1.0 END * 100, 40) AS vp FROM b LEFT JOIN c USING (entity, kpi)), k AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, 100 - vp - least(cliffs * 15, 30) - 2.0 - 5.0) END AS s FROM j)
    SELECT entity, kpi, round(s, 4) AS score, CASE WHEN n < 2 THEN 'insufficient' WHEN s >= 80 THEN 'stable' WHEN s >= 60 THEN 'slight' WHEN s >= 40 THEN 'marked' ELSE 'unstable' END AS grade, round(vp, 1) AS volatility_penalty, round(least(cliffs * 15, 30)::DOUBLE, 1) AS cliff_penalty, CASE WHEN n >= 12 THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM k""",
)
def _(s, d):
    return R.stability(series(s, d), R.cliff_drops(series(s, d)), F.any_value(F.lit(0.1)), F.any_value(F.lit(0.25)))


@query(
    "r3_cliff_drops",
    f"SELECT entity, kpi, seq, round(previous - value, 4) AS drop_abs, round((previous - value) / previous * 100, 1) AS drop_pct, round((value - mean) / std, 2) AS z_score, CASE WHEN previous - value >= 0.2 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT * FROM (SELECT *, row_number() OVER o AS i, lag(value) OVER o AS previous, count(*) OVER w AS n, avg(value) OVER w AS mean, CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 0.01 END AS std FROM (SELECT event_id // 100 AS entity, 'all' AS kpi, event_id AS seq, greatest(0.0, 1.0 - value / 197) AS value FROM events) WINDOW o AS (PARTITION BY entity, kpi ORDER BY seq), w AS (PARTITION BY entity, kpi)) WHERE n >= 4 AND previous > value AND (previous - value) / previous >= 0.2 AND previous - value >= 0.1 AND (value - mean) / std <= -2)",
)
def _(s, d):
    e = table(s, d, "events").select(F.expr("event_id div 100").alias("entity"), F.lit("all").alias("kpi"), F.col("event_id").alias("seq"), F.greatest(F.lit(0.0), 1.0 - F.col("value") / 197).alias("value"))
    return R.cliff_drops(e)


@query(
    "r4_sustained",
    """WITH e AS (SELECT event_id // 6 AS entity, event_id AS seq, CASE WHEN event_id // 6 % 3 = 0 THEN (event_id % 6) * 0.03 + value / 1e9 ELSE value / 397 END AS value FROM events), p AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY seq) AS previous FROM e),
    g AS (SELECT entity, count(*) AS periods, count(*) FILTER (value > previous) AS ups, count(*) FILTER (value < previous) AS downs, arg_max(value, seq) - arg_min(value, seq) AS change FROM p GROUP BY 1)
    SELECT entity, 'k' AS kpi, periods, CASE WHEN change > 0 THEN 'improvement' ELSE 'decline' END AS direction, round(change, 4) AS overall_change, abs(change / (periods - 1)) >= 0.02 AND abs(change) >= 0.08 AS business_significant FROM g WHERE periods >= 6 AND ((ups = 0) <> (downs = 0)) AND ups + downs >= 5""",
)
def _(s, d):
    rising = (F.col("event_id") % 6) * 0.03 + F.col("value") / 1e9
    e = table(s, d, "events").withColumn("entity", F.expr("event_id div 6")).select("entity", F.lit("k").alias("kpi"), F.col("event_id").alias("seq"), F.when(F.col("entity") % 3 == 0, rising).otherwise(F.col("value") / 397).alias("value"))
    return R.sustained(e)


@query(
    "r5_volatility",
    "SELECT user_id AS platform, event_type AS kpi, CASE WHEN count(*) >= 5 THEN round(avg(value), 4) ELSE 0.0 END AS mean, CASE WHEN count(*) >= 5 THEN round(CASE WHEN avg(value) > 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END, 4) END AS cv, count(*) >= 5 AND stddev_pop(value) / avg(value) > 0.3 AS is_volatile, count(*) < 5 AS insufficient_data FROM (SELECT user_id, event_type, value / 397 AS value FROM events) GROUP BY ALL",
)
def _(s, d):
    return R.volatility(table(s, d, "events").select(F.col("user_id").alias("platform"), F.col("event_type").alias("kpi"), (F.col("value") / 397).alias("value")))


@query(
    "r6_change_scope",
    "SELECT user_id, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 AND NOT c THEN 'platform_specific' WHEN c AND i THEN 'industry_wide' WHEN NOT c THEN 'brand_specific' ELSE 'competitor_shared' END AS scope FROM (SELECT user_id, count(DISTINCT event_type) FILTER (value > 150) AS n, bool_or(value > 250) AS c, bool_or(value > 300) AS i FROM events GROUP BY 1)",
)
def _(s, d):
    v = F.col("value")
    g = table(s, d, "events").groupBy("user_id").agg(F.countDistinct(F.when(v > 150, F.col("event_type"))).alias("n"), F.bool_or(v > 250).alias("c"), F.bool_or(v > 300).alias("i"))
    return g.select("user_id", R.change_scope(F.col("n"), F.col("c"), F.col("i")).alias("scope"))


@query(
    "r7_attribution",
    """WITH p AS (SELECT event_id AS id, user_id AS entity, ts AS at_, event_id % 5 = 0 AS confounded, 0.05 AS threshold FROM events WHERE event_type = 'signup'), e AS (SELECT user_id AS entity, ts, value / 397 AS value FROM events WHERE event_type <> 'signup'),
    b AS (SELECT id, value FROM p JOIN e USING (entity) WHERE ts >= at_ - INTERVAL 14 DAY AND ts < at_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, value DESC) <= 2), a AS (SELECT id, value FROM p JOIN e USING (entity) WHERE ts >= at_ + INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, value) <= 2),
    g AS (SELECT p.*, pre, post FROM p JOIN (SELECT id, avg(value) AS pre FROM b GROUP BY 1 HAVING count(*) >= 2) USING (id) JOIN (SELECT id, avg(value) AS post FROM a GROUP BY 1 HAVING count(*) >= 2) USING (id))
    SELECT id, round(pre, 4) AS pre_avg, round(post, 4) AS post_avg, round(post - pre, 4) AS change, abs(post - pre) >= threshold AS is_meaningful, CASE WHEN confounded THEN 'confounded' WHEN abs(post - pre) < threshold THEN 'no_obvious_effect' WHEN post - pre > threshold THEN 'possible_action_effect' ELSE 'negative_effect_possible' END AS label FROM g""",
)
def _(s, d):
    e = table(s, d, "events")
    p = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("ts").alias("at"), (F.col("event_id") % 5 == 0).alias("confounded"), F.lit(0.05).alias("threshold"))
    return R.attribution(p, e.where("event_type <> 'signup'").select(F.col("user_id").alias("entity"), "ts", (F.col("value") / 397).alias("value")))


@query("r8_timeline", "SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'shipment', l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'event', event_id, ts FROM events WHERE event_type = 'error'")
def _(s, d):
    o = table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    l = table(s, d, "lineitem").where("l_linenumber = 1").select(F.lit("shipment").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"))
    e = table(s, d, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return o.unionByName(l).unionByName(e)


@query("r9_last_runs_unpivot", "UNPIVOT (SELECT o_orderkey, o_totalprice AS price, year(o_orderdate)::DOUBLE AS year FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12) ON price, year INTO NAME kpi VALUE value")
def _(s, d):
    last = table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(12)
    wide = last.select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"))
    return wide.unpivot("o_orderkey", ["price", "year"], "kpi", "value")


@query(
    "r10_run_delta",
    "WITH w AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events) SELECT event_id, CASE WHEN delta > 0.001 THEN 'up' WHEN delta < -0.001 THEN 'down' ELSE 'flat' END AS direction FROM w WHERE delta IS NOT NULL",
)
def _(s, d):
    from pyspark.sql import Window as W

    delta = F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    e = table(s, d, "events").select("event_id", delta.alias("delta")).where("delta is not null")
    return e.select("event_id", F.when(F.col("delta") > 0.001, "up").when(F.col("delta") < -0.001, "down").otherwise("flat").alias("direction"))


@query("r11_kpi_thresholds", "SELECT event_type AS kpi, CASE WHEN event_type IN ('view', 'error') THEN 0.03 ELSE 0.05 END AS threshold, count(*) AS n FROM events GROUP BY 1".replace("0.03 ELSE 0.05", "0.03::DOUBLE ELSE 0.05::DOUBLE"))
def _(s, d):
    known = s.createDataFrame([("view", 0.03), ("error", 0.03)], "kpi string, threshold double")
    e = table(s, d, "events").groupBy(F.col("event_type").alias("kpi")).agg(F.count("*").alias("n"))
    return e.join(F.broadcast(known), "kpi", "left").select("kpi", F.coalesce("threshold", F.lit(0.05)).alias("threshold"), "n")


@query(
    "r12_confounders",
    "SELECT o.o_orderkey, count(DISTINCT e.event_type) > 1 AS prompt_changed FROM (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (o_orderkey % 25)::INT AS lo FROM orders) o JOIN events e ON e.user_id = o.u AND e.ts >= lo AND e.ts < lo + INTERVAL 2 DAY GROUP BY 1",
)
def _(s, d):
    lo = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(o_orderkey % 25 as int))")
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), lo.alias("lo"))
    # each distinct window is judged once, however many orders share it
    windows = o.select("user_id", "lo").distinct().withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.date_add(F.to_date("lo"), 2))))
    e = table(s, d, "events").select("user_id", "ts", "event_type", F.to_date("ts").alias("day"))
    met = windows.join(e, ["user_id", "day"]).where((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.expr("lo + interval 2 days")))
    judged = met.groupBy("user_id", "lo").agg((F.countDistinct("event_type") > 1).alias("prompt_changed"))
    return o.join(judged, ["user_id", "lo"]).groupBy("o_orderkey").agg(F.bool_or("prompt_changed").alias("prompt_changed"))
