"""Queries over state: timers on streams of the events table, crash-safe rewrites, versioned records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.operators import versions
from answerscope.plans.registry import query, table
from answerscope.sources import sinks, tables
from answerscope.sources.scratch import scratch_path
from answerscope.streaming import flows, outbox, timed


def events(s, d, per_trigger=100):
    stream = flows.read(s, f"{d}/events.parquet", per_trigger)
    return stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), "event_type", "value")


# rejected moves feed back into the state, which SQL cannot express; tests hold both against plain loops
@query("st7_request_timeouts")
def _(s, d):
    to = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "sending").when(F.col("event_type") == "view", "delivered").when(F.col("event_type") == "purchase", "published").otherwise("failed")
    return timed.drained(timed.run(events(s, d).withColumn("to", to), timed.REQUESTS))


@query("st6_lock_timeouts")
def _(s, d):
    action = F.when(F.col("event_type") == "signup", "lock").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "move").otherwise("release")
    arg = F.when(F.col("event_type") == "purchase", "running").otherwise(F.concat(F.lit("w"), F.col("id") % 3))
    asked = events(s, d).select("key", "id", "time", action.alias("action"), arg.alias("arg"), (F.col("value") % 1).alias("pct"))
    return timed.drained(timed.run(asked, timed.LOCKS))


@query(
    "st10_expired_items",
    """WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN ts + INTERVAL 1 DAY END AS ends, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) AS until FROM events WHERE event_type IN ('signup', 'purchase'))
    SELECT user_id AS key, epoch_us(ends) AS at, 'expired' AS outcome FROM e WHERE ends < until""",
)
def _(s, d):
    # a signup opens or renews an item for a day, a purchase ends it; the last watermark lies one hour before the last event,
    # up to which all else moves it without making an item of its user run out; all files come in one batch, so that none is late
    ends = F.when(F.col("event_type") == "signup", F.unix_micros("time") + 24 * 3600 * timed.MICROS).when(~F.col("event_type").eqNullSafe("purchase"), -1)
    return timed.drained(timed.run(events(s, d, None).where("time is not null").withColumn("expires", ends), timed.EXPIRIES))


CALLBACKS = """WITH c AS (SELECT event_id AS id, event_id // 2 AS event, user_id AS token, ts, event_id % 10 >= 8 AS late, ts - INTERVAL 1 HOUR * (CASE WHEN event_id % 7 = 0 THEN 80 ELSE 1 END) AS issued FROM events),
    f AS (SELECT *, NOT late AND row_number() OVER (PARTITION BY event, late ORDER BY ts, id) > 1 AS replay FROM c),
    good AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts, id) AS k FROM f WHERE NOT late AND NOT replay AND ts <= issued + INTERVAL 72 HOUR)"""


@query(
    "st9_callback_outcomes",
    f"""WITH RECURSIVE {CALLBACKS[5:]}, used AS (
      SELECT token, ts, k FROM good WHERE k = 1
      UNION ALL
      SELECT g.token, g.ts, g.k FROM used u, LATERAL (SELECT token, ts, k FROM good n WHERE n.token = u.token AND n.ts > u.ts + INTERVAL 72 HOUR ORDER BY k LIMIT 1) g)
    SELECT f.id, CASE WHEN late THEN 'late' WHEN replay THEN 'replay' WHEN f.ts > issued + INTERVAL 72 HOUR THEN 'expired_token' WHEN u.token IS NULL THEN 'spent_token' ELSE 'accepted' END AS reason
    FROM f LEFT JOIN (SELECT id, good.token FROM good JOIN used USING (token, k)) u ON u.id = f.id""",
)
def _(s, d):
    # all files in one batch, so that callbacks come in the order of their arrival, whatever the order of the files
    own = F.when(F.col("id") % 10 >= 8, F.col("time") - F.expr("interval 900 seconds")).otherwise(F.col("time"))
    issued = F.col("time") - F.when(F.col("id") % 7 == 0, F.expr("interval 80 hours")).otherwise(F.expr("interval 1 hours"))
    arrived = events(s, d, None).select("id", F.expr("id div 2").alias("event"), F.col("key").cast("string").alias("token"), issued.alias("issued"), own.alias("sent"), "time")
    accepted, rejected = timed.callbacks(arrived)
    return accepted.union(rejected)


# --- rewrites and versioned records ------------------------------------------


def held(s, d, name, by, columns, segments=4):
    """A table of the driver as a versioned one."""
    return tables.VersionedTable(s, scratch_path(s, name)).create(table(s, d, name).select(*columns), segments=segments, by=by)


@query("k2_update_rewrite", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < DATE '1997-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    orders = held(s, d, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    tables.rewrite(orders, "expire", F.expr("o_orderstatus = 'O' and o_orderdate < date '1997-01-01'"), keep=F.struct(F.lit("X").alias("o_orderstatus")))
    return orders.read().select("o_orderkey", "o_orderstatus")


@query("k3_retention_rewrite", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR event_type = 'click' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY)")
def _(s, d):
    events_ = held(s, d, "events", "event_id", ["event_id", "event_type", "ts"])
    tables.rewrite(events_, "retention", tables.retained({"view": 10, "click": 20}, "event_type", "ts", F.expr("timestamp_ntz '2024-01-31'")))
    return events_.read().select("event_id")


@query(
    "k4_cascade_rewrite",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'customer' AS name, (SELECT count(*) FROM c) AS deleted, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS rest
    UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)
    UNION ALL SELECT 'lineitem', count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM o)), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM o)) FROM lineitem""",
)
def _(s, d):
    own = {"customer": ("c_custkey", ["c_custkey", "c_nationkey"]), "orders": ("o_orderkey", ["o_orderkey", "o_custkey"]), "lineitem": ("l_orderkey", ["l_orderkey", "l_linenumber"])}
    all_ = {n: held(s, d, n, by, columns) for n, (by, columns) in own.items()}
    parents = {"orders": ("customer", "o_custkey", "c_custkey"), "lineitem": ("orders", "l_orderkey", "o_orderkey")}
    receipt = tables.cascade(all_, parents, all_["customer"].read().where("c_nationkey = 3"), "customer", "c_custkey", "request")
    out = [all_[n].read().agg(F.lit(n).alias("name"), F.lit(k).cast("long").alias("deleted"), F.count("*").alias("rest")) for n, k in receipt["deleted_counts"].items()]
    return out[0].union(out[1]).union(out[2])


@query("k10_insert_once", "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_brand || '+' FROM part WHERE p_partkey % 2 = 1")
def _(s, d):
    part = table(s, d, "part").select("p_partkey", "p_brand")
    half = tables.VersionedTable(s, scratch_path(s, "part")).create(part.where("p_partkey % 2 = 0"))
    new = part.withColumn("p_brand", F.concat("p_brand", F.lit("+")))
    for _ in range(2):  # the repeated job adds nothing
        tables.insert_once(half, new, ["p_partkey"], "job")
    return half.read()


@query(
    "c36_record_history",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, lag(l_linestatus) OVER w AS before, lag(l_returnflag) OVER w AS flag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus)),
    v AS (SELECT *, before IS NULL OR before <> l_linestatus OR flag <> l_returnflag AS made FROM l)
    SELECT l_orderkey::VARCHAR AS record, count(*) FILTER (made) AS versions, count(*) FILTER (NOT made) AS unchanged, max_by(l_linestatus, {'a': l_linenumber, 'b': l_returnflag, 'c': l_linestatus}) AS mode FROM v GROUP BY 1""",
)
def _(s, d):
    # each line of an order asks for the order's ship mode and flag
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_linestatus"))
    first = place == 1
    asked = table(s, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record"), place.cast("long").alias("seq"), F.when(first, "create").otherwise("update").alias("kind"), F.lit(None).cast("int").alias("expected"),
        F.create_map(F.lit("mode"), "l_linestatus", F.lit("flag"), "l_returnflag").alias("fields"), F.lit(None).cast("int").alias("target"), F.lit("x").alias("by"),
    )
    done = versions.apply(s.createDataFrame([], versions.HISTORY), asked, ["mode", "flag"])
    last = F.max_by(F.col("fields")["mode"], F.col("version"))
    return done.groupBy("record").agg(F.count_if(F.col("outcome") == "done").alias("versions"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"), last.alias("mode"))


@query("k5_zipped_export", "SELECT o_orderstatus AS tenant, count(*) AS n_rows, ceil(count(*) / 5000.0)::BIGINT AS n_archives FROM orders GROUP BY 1")
def _(s, d):
    out = sinks.zipped(table(s, d, "orders"), "o_orderstatus", [F.col("o_orderkey")], 5000)
    return out.groupBy("tenant").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_archives"))


@query("k9_delivery_log", "SELECT 'delivered' AS status, count(*) FILTER (c_custkey % 7 <> 0 AND c_nationkey <> 3) AS n FROM customer UNION ALL SELECT 'held', count(*) FILTER (c_nationkey = 3) FROM customer UNION ALL SELECT 'failed', count(*) FILTER (c_custkey % 7 = 0 AND c_nationkey <> 3) FROM customer")
def _(s, d):
    # every customer is a request to its nation; one nation is paused, every seventh request is refused
    c = F.col("c_custkey")
    stream = flows.read(s, f"{d}/customer.parquet").select(
        c.cast("string").alias("request"), F.col("c_nationkey").cast("string").alias("target"), F.concat(F.lit("https://x.example.com/"), c % 7).alias("url"), F.col("c_name").alias("payload"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at")
    )
    paused = s.createDataFrame([("3",)], "target string")
    send = lambda url, payload, key: 400 if url.endswith("/0") else 200
    log = outbox.deliver(stream, scratch_path(s, "outbox"), scratch_path(s, "outbox-state"), send, paused)
    return outbox.latest(log).groupBy("status").agg(F.count("*").alias("n"))
