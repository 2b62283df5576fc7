"""Timed state against plain loops, in one batch and in many, with keys that fall silent."""

import random

import pytest
from answerscope.plans import operations  # noqa: F401
from answerscope.streaming import timed
from pyspark.sql import functions as F

MICROS = timed.MICROS


def source(spark, tmp_path, rows, schema, batches, name):
    """Rows (in order of time) as a stream of so many files, one a batch."""
    path, size = f"{tmp_path}/{name}-{batches}", -(-len(rows) // batches)
    for i in range(batches):
        df = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).withColumn("time", F.timestamp_micros("us")).drop("us")
        df.coalesce(1).write.mode("append").parquet(path)
    columns = spark.read.parquet(path).schema
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(path)


def loop(machine, rows, names, watermark):
    """One pass over each key, then what the watermark makes due."""
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    for key, own in by.items():
        made, state = machine.over([r | {"at": r["us"]} for r in sorted(own, key=lambda r: (r["us"], r["id"]))], machine.start)
        lapsed, _ = machine.due(state, watermark)
        out += [(key, *r) for r in made + lapsed]
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cases():
    rng = random.Random(4)
    minutes = sorted(rng.sample(range(4000), 300))
    times = [m * 60 * MICROS + rng.randrange(60) * MICROS for m in minutes]
    statuses = [*timed.REQUEST_MOVES, "nonsense"]
    likely = ["sending", "delivered", "published", "failed", "queued"]
    requests = [(f"r{rng.randrange(25)}", i, t, rng.choice(likely * 3 + statuses)) for i, t in enumerate(times)]
    actions = ["lock", "lock", "heartbeat", "move", "release", "progress"]
    locks = [(f"t{rng.randrange(15)}", i, t, rng.choice(actions), rng.choice(["w1", "w2", "running", "completed"]), rng.random()) for i, t in enumerate(times)]
    items = [(f"i{rng.randrange(30)}", i, t, rng.choice([t + rng.randrange(1, 9) * 3600 * MICROS, None])) for i, t in enumerate(times)]
    return {
        "requests": (timed.REQUESTS, requests, ["key", "id", "us", "to"], "key string, id long, us long, to string"),
        "locks": (timed.LOCKS, locks, ["key", "id", "us", "action", "arg", "pct"], "key string, id long, us long, action string, arg string, pct double"),
        "expiries": (timed.EXPIRIES, items, ["key", "id", "us", "expires"], "key string, id long, us long, expires long"),
    }


@pytest.mark.parametrize("name", ["requests", "locks", "expiries"])
def test_machine_equals_loop_in_any_batches(spark, tmp_path, name):
    machine, rows, names, schema = cases()[name]
    want = loop(machine, rows, names, max(r[2] for r in rows) - 3600 * MICROS)
    assert any("timed_out" in r or "lapsed" in r or "expired" in r for r in want)
    for batches in (1, 4):
        assert plain(timed.drained(timed.run(source(spark, tmp_path, rows, schema, batches, name), machine))) == want


def test_a_silent_request_times_out_and_a_restart_repeats_nothing(spark, tmp_path):
    hour, minute = 3600 * MICROS, 60 * MICROS
    first = [("silent", 1, hour, "queued"), ("sent", 2, hour, "queued"), ("sent", 3, hour + 1, "sending"), ("other", 4, 3 * hour, "queued")]
    schema = "key string, id long, us long, to string"
    stream = source(spark, tmp_path, first, schema, 1, "restart")
    at = {"checkpoint": f"{tmp_path}/state", "path": f"{tmp_path}/out"}
    got = plain(timed.drained(timed.run(stream, timed.REQUESTS), **at))
    assert ("silent", None, hour + 15 * minute, "queued", "enqueue_failed", "timed_out") in got
    assert ("sent", None, hour + 30 * minute + 1, "sending", "unknown", "timed_out") in got
    assert not any(r[0] == "other" and r[5] == "timed_out" for r in got)
    more = source(spark, tmp_path, [("silent", 5, 4 * hour, "queued"), ("silent", 6, 4 * hour + 1, "published"), ("last", 7, 9 * hour, "queued")], schema, 1, "restart")
    got = plain(timed.drained(timed.run(more, timed.REQUESTS), **at))
    assert len(got) == len(set(got)) and sum(r[5] == "created" for r in got) == 4
    assert ("silent", 5, 4 * hour, "enqueue_failed", "queued", "moved") in got and ("silent", 6, 4 * hour + 1, "queued", "published", "rejected") in got
    assert ("silent", None, 4 * hour + 15 * minute, "queued", "enqueue_failed", "timed_out") in got


def callback_rows():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        at = (i + 200) * 1800 * MICROS
        sent = at + rng.choice([0, 0, 0, -200, 300, -301, 5000]) * MICROS
        rows.append((i, f"e{rng.randrange(250)}", f"t{rng.randrange(120)}", at - rng.choice([1, 1, 1, 80]) * 3600 * MICROS, sent, at))
    return rows


def expected_callbacks(rows):
    seen, used, out = {}, {}, {}
    for i, event, token, issued, sent, at in rows:
        if abs(at // MICROS - sent // MICROS) > 300:
            out[i] = "late"
        elif event in seen and at - seen[event] <= timed.TOKEN_S * MICROS:
            out[i] = "replay"
        else:
            seen[event] = at
            if at > issued + timed.TOKEN_S * MICROS:
                out[i] = "expired_token"
            elif token in used and at - used[token] <= timed.TOKEN_S * MICROS:
                out[i] = "spent_token"
            else:
                out[i], used[token] = "accepted", at
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_callbacks_are_parted(spark, tmp_path, batches):
    rows = callback_rows()
    df = source(spark, tmp_path, [(*r[:3], r[3], r[4], r[5]) for r in rows], "id long, event string, token string, issued_us long, sent_us long, us long", batches, "callbacks")
    stream = df.withColumn("issued", F.timestamp_micros("issued_us")).withColumn("sent", F.timestamp_micros("sent_us"))
    accepted, rejected = timed.callbacks(stream)
    got = [tuple(r) for r in accepted.union(rejected).collect()]
    assert len(got) == len(rows) and dict(got) == expected_callbacks(rows)
    assert {r.reason for r in accepted.collect()} == {"accepted"}
    assert set(dict(got).values()) == {"accepted", "late", "replay", "spent_token", "expired_token"}


def test_callbacks_out_of_order_all_come_out(spark, tmp_path):
    """Batches that come the newest first, and keys whose rows lie in many Arrow batches."""
    rows = callback_rows()
    stream = source(spark, tmp_path, rows[::-1], "id long, event string, token string, issued_us long, sent_us long, us long", 3, "backwards")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        accepted, rejected = timed.callbacks(stream.withColumn("issued", F.timestamp_micros("issued_us")).withColumn("sent", F.timestamp_micros("sent_us")))
        got = [tuple(r) for r in accepted.union(rejected).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = expected_callbacks(rows)
    assert len(got) == len(rows) and set(dict(got)) == set(want)
    assert {i for i, r in got if r == "late"} == {i for i, r in want.items() if r == "late"}


@pytest.mark.parametrize("size", ["3", "10000"])
def test_sorted_rows_fold_as_each_key_alone(spark, size):
    """Rows of keys, one of them null, however many an Arrow batch holds, with the state of an earlier batch."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), i, 3600 * MICROS * rng.randrange(1, 400), f"t{i % 3}", 0) for i in range(120)]
    schema, cut = "key string, id long, at long, token string, issued long", 200 * 3600 * MICROS
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((dict(zip(["id", "at", "token", "issued"], r[1:], strict=True)) for r in rows if r[0] == key), key=lambda r: (r["at"], r["id"]))
        want += [(key, *r) for r in timed.SEEN.over(own, timed.SEEN.start)[0]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        parts, kept = [], None
        for part in ([r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]):
            done = timed.folded(spark.createDataFrame(part, schema), kept, timed.SEEN, None).persist()
            parts += [(r.key, r.id, r.at, r.token, r.issued, r.replay) for r in done.where("not is_state").collect()]
            kept = done.where("is_state")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(parts, key=str) == sorted(want, key=str) and 4 < sum(not r[5] for r in parts) < 40


def test_updated_windows_keep_the_last_count(spark, tmp_path):
    """Windows that several batches change count whole, each once; sessions come when the watermark has closed them."""
    from answerscope.streaming import flows

    hour = 3600 * MICROS
    rows = [(1, (10 + i // 4) * hour + i % 4, "error") for i in range(24)] + [(1, 60 * hour, "view")]
    df = source(spark, tmp_path, rows, "user_id long, us long, event_type string", 5, "windows").withColumn("ts", F.col("time").cast("timestamp_ntz"))
    got = flows.drained(flows.tumbling(df.drop("time")), ["user_id", "bucket"]).collect()
    assert sorted(r.n for r in got) == [1, 4, 4, 4, 4, 4, 4] and len({r.bucket for r in got}) == 7
    done = flows.drained(flows.sessions(df.drop("time"))).collect()
    assert [r.n for r in done] == [24]


def test_sessions_count_those_still_open_and_files_in_any_order(spark, tmp_path):
    """A table of more files than a batch takes, the newest first, whose last sessions no later event closes."""
    import os

    import duckdb
    import pandas as pd
    from answerscope.plans import registry
    from oracle import rows

    hour = 3600
    times = [[100 * hour + i, 107 * hour + i] for i in range(101)] + [[i * hour for i in (1, 2, 9, 15, 95)]]
    os.makedirs(f"{tmp_path}/events.parquet")
    for i, part in enumerate(times):
        path = f"{tmp_path}/events.parquet/{i:03d}.parquet"
        own = pd.DataFrame({"event_id": [100 * i + k for k in range(len(part))], "user_id": [i % 3] * len(part), "ts": pd.to_datetime(part, unit="s").astype("datetime64[us]")})
        own.to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = registry.QUERIES["st7_sessions"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(registry.ORACLE_SQL["st7_sessions"])
    assert rows(["user_id", "start", "n"], got) == rows(want.columns, want.fetchall())
    assert sum(r.n for r in got) == sum(map(len, times))
