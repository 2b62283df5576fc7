"""Delivery: replays, retries, gates and breakers; progress by batch; zipped exports read back."""

import datetime as dt
import hashlib
import io
import time
import zipfile

from answerscope.sources import sinks
from answerscope.streaming import outbox
from pyspark.sql import functions as F

REQUEST = "request string, target string, url string, payload string, at timestamp"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def batch(spark, rows, now):
    return spark.createDataFrame([(*r, at(now)) for r in rows], REQUEST)


def sender(folder):
    """Notes each sending in a file of its own; answers by the last part of the URL."""

    def send(url, payload, key):
        with open(f"{folder}/{key}-{time.time_ns()}", "w") as f:
            f.write(payload)
        code = url.rsplit("/", 1)[1]
        return None if code == "down" else int(code)

    return send


def sendings(folder):
    return sorted(p.name.split("-")[0] for p in folder.iterdir())


def key(request, attempt):
    return hashlib.sha256(f"{request}:{attempt}".encode()).hexdigest()


def test_replay_sends_nothing_and_retries_back_off(spark, tmp_path):
    sent, log = tmp_path / "sent", f"file://{tmp_path}/log"
    sent.mkdir()
    send, none = sender(sent), spark.createDataFrame([], "target string")
    u = "https://hooks.example.com/"
    rows = [("a", "t", u + "200", "p"), ("b", "t", u + "503", "p"), ("c", "t", u + "400", "p"), ("d", "t", u + "down", "p"), ("e", "t", "http://127.0.0.1/200", "p"), ("a", "t", u + "200", "p")]
    for _ in range(2):  # the second run is a replay
        outbox.send_batch(batch(spark, rows, 0), 0, log, send, none)
    first = {r.request: (r.status, r.attempt, r.category, r.next_at) for r in outbox.attempts(spark, log).collect()}
    assert first == {"a": ("delivered", 1, None, None), "b": ("retry", 1, "server_error", at(300)), "c": ("failed", 1, "invalid_payload", None), "d": ("retry", 1, "target_unreachable", at(300)), "e": ("failed", 1, "ssrf_blocked", None)}
    assert sendings(sent) == sorted(key(r, 1) for r in "abcd")
    outbox.send_batch(batch(spark, [("a", "t", u + "200", "p")], 299), 1, log, send, none)  # nothing is due, a is done
    assert len(sendings(sent)) == 4
    for number, now in ((2, 300), (3, 1300), (4, 3200), (5, 9000)):
        outbox.send_batch(batch(spark, [("new%d" % number, "u", u + "200", "p")], now), number, log, send, none)
    b = [(r.attempt, r.status) for r in outbox.attempts(spark, log).where("request = 'b'").orderBy("batch").collect()]
    assert b == [(1, "retry"), (2, "retry"), (3, "retry"), (4, "dead")]
    assert sendings(sent).count(key("b", 4)) == 1 and len(sendings(sent)) == len(set(sendings(sent)))


def test_paused_targets_and_open_breakers_hold(spark, tmp_path):
    sent, log = tmp_path / "sent", f"file://{tmp_path}/log"
    sent.mkdir()
    send, u = sender(sent), "https://hooks.example.com/"
    paused, none = spark.createDataFrame([("p",)], "target string"), spark.createDataFrame([], "target string")
    outbox.send_batch(batch(spark, [(f"x{i}", "bad", u + "500", "p") for i in range(5)] + [("held", "p", u + "200", "p")], 0), 0, log, send, paused)
    outbox.send_batch(batch(spark, [("y", "bad", u + "200", "p"), ("z", "good", u + "200", "p")], 60), 1, log, send, none)
    got = {r.request: (r.status, r.category, r.attempt) for r in outbox.latest(outbox.attempts(spark, log)).collect()}
    assert got["held"] == ("delivered", None, 1) and got["z"][0] == "delivered" and got["y"] == ("held", "breaker_open", 0)
    outbox.send_batch(batch(spark, [("w", "good", u + "200", "p")], 1900), 2, log, send, none)  # the breaker has closed again
    assert {r.request: r.status for r in outbox.latest(outbox.attempts(spark, log)).collect()}["y"] == "delivered"


def test_progress_adds_up(spark, tmp_path):
    for i in range(3):
        spark.range(8 * (i + 1)).write.mode("append").parquet(f"{tmp_path}/in")
    progress = outbox.Progress()
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if sum(r[2] for r in progress.rows) == 48:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    rows = progress.table(spark).orderBy("batch").collect()
    assert sum(r.n for r in rows) == rows[-1].total == 48 and len(rows) > 1


def test_zipped_exports_read_back(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 2}", f"é,\"{i}\"\n" if i % 2 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "id long, tenant string, note string")
    got = sinks.zipped(df, "tenant", [F.col("id")], 40).orderBy("tenant", "part").collect()
    again = sinks.zipped(df.repartition(5), "tenant", [F.col("id")], 40).orderBy("tenant", "part").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in again] and max(r.n_rows for r in got) == 40
    import pandas as pd

    back = []
    for r in got:
        with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
            assert z.namelist() == [r.name]
            text = z.read(r.name)
            assert hashlib.sha256(text).hexdigest() == r.sha256
            part = pd.read_csv(io.BytesIO(text), dtype=str, keep_default_na=False)
            assert len(part) == r.n_rows and set(part.tenant) == {r.tenant}
            back += part.itertuples(index=False, name=None)
    assert sorted((int(i), t, n or None) for i, t, n in back) == sorted(rows)
