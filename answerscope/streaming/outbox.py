"""Delivery of publish requests as a stream: each batch sends what is new or due and appends its attempts to a log.

The log (one folder a batch, committed as a whole) is all the state there is: it
says what was sent, which batch did it, what waits for a retry and which targets
fail. A batch whose folder is committed sends nothing when it is repeated; the
key that goes with each sending (a hash of request and attempt) lets a receiver
drop what a batch sent before it died.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from answerscope.functions import text as T

# Seconds until the second, third and fourth attempt; failures in a row that open a target's breaker, and for how long.
WAITS_S = (300, 900, 1800)
FAILURES, OPEN_S = 5, 1800
LOG = "request string, target string, url string, payload string, attempt int, at timestamp, status string, code int, category string, next_at timestamp, key string"

#: (url, payload, key) -> HTTP status, or None if the target could not be reached.
Send = Callable[[str, str, str], int | None]


def category(code: Column) -> Column:
    known = F.when(code.isNull(), "target_unreachable").when(code.isin(401, 403), "auth_failed").when(code == 429, "rate_limited").when(code.isin(400, 422), "invalid_payload")
    return F.when(code.between(200, 299), None).otherwise(known.when(code.between(500, 599), "server_error").when(code == 408, "timeout").otherwise("unknown_error"))


def retryable(kind: Column) -> Column:
    return kind.isin("target_unreachable", "rate_limited", "server_error", "timeout")


def committed(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far, with their batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], LOG + ", batch long")
    return spark.read.schema(LOG + ", batch long").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """The last row of each request."""
    return log.groupBy("request").agg(F.max_by(F.struct(*[c for c in log.columns if c != "request"]), "batch").alias("r")).select("request", "r.*")


def open_targets(log: DataFrame, clock: DataFrame) -> DataFrame:
    """Targets whose last FAILURES attempts or more failed, the last one not OPEN_S before the clock's one row, ``now``."""
    tried = log.where("status in ('delivered', 'retry', 'failed', 'dead') and code is not null or category = 'target_unreachable'")
    at = F.struct("at", "batch")
    good = tried.groupBy("target").agg(F.max(F.when(F.col("status") == "delivered", at)).alias("good"))
    since = tried.join(good, "target").where((F.col("status") != "delivered") & (F.col("good").isNull() | (at > F.col("good"))))
    failing = since.groupBy("target").agg(F.count("*").alias("n"), F.max("at").alias("last")).where(F.col("n") >= FAILURES)
    return failing.crossJoin(clock).where(F.col("last") > F.col("now") - F.make_interval(secs=F.lit(OPEN_S))).select("target")


def send_batch(batch: DataFrame, number: int, path: str, send: Send, paused: DataFrame) -> None:
    """Requests (request, target, url, payload, at) of a batch, and retries that are due, sent once; what became of them is appended."""
    spark = batch.sparkSession
    if committed(spark, f"{path}/batch={number}"):
        return
    log = attempts(spark, path).where(F.col("batch") < number)
    last = latest(log)
    now = batch.agg(F.max("at").alias("now"))
    new = batch.groupBy("request").agg(F.min(F.struct("target", "url", "payload")).alias("r")).select("request", "r.*", F.lit(0).alias("attempt"))
    new = new.join(last.select("request"), "request", "left_anti")
    clock = F.broadcast(now)  # one row
    again = last.where("status in ('retry', 'held')").crossJoin(clock).where("next_at <= now").select("request", "target", "url", "payload", "attempt")
    due = new.unionByName(again).crossJoin(clock)
    gates = paused.select("target", F.lit("paused").alias("gate")).unionByName(open_targets(log, clock).select("target", F.lit("breaker_open").alias("gate")))
    held = due.join(gates.groupBy("target").agg(F.max("gate").alias("gate")), "target", "left")
    key = F.sha2(F.concat_ws(":", "request", F.col("attempt") + 1), 256)
    ready = held.withColumn("key", key).withColumn("go", F.col("gate").isNull() & F.coalesce(T.safe_url(F.col("url")), F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            codes = [send(u, p, k) if go else None for u, p, k, go in zip(part["url"], part["payload"], part["key"], part["go"], strict=True)]
            yield part.assign(code=pd.array(codes, dtype="Int32"))

    columns = ["request", "target", "url", "payload", "attempt", "now", "gate", "key", "go"]
    sent = ready.select(*columns).mapInPandas(run, "request string, target string, url string, payload string, attempt int, now timestamp, gate string, key string, go boolean, code int")
    kind = F.when(F.col("gate").isNotNull(), F.col("gate")).when(~F.col("go"), "ssrf_blocked").otherwise(category(F.col("code")))
    tried = F.col("attempt") + F.when(F.col("gate").isNull(), 1).otherwise(0)
    wait = F.get(F.array(*[F.lit(s) for s in WAITS_S]), tried - 1)
    judged = sent.withColumn("category", kind).withColumn("tried", tried)
    status = F.when(F.col("gate").isNotNull(), "held").when(F.col("category").isNull(), "delivered").when(~retryable(F.col("category")), "failed").when(F.col("tried") > len(WAITS_S), "dead").otherwise("retry")
    next_at = F.when(status == "held", F.col("now")).when(status == "retry", F.timestamp_seconds(F.unix_seconds("now") + wait))
    out = judged.select("request", "target", "url", F.when(status.isin("retry", "held"), F.col("payload")).alias("payload"), F.col("tried").cast("int").alias("attempt"), F.col("now").alias("at"), status.alias("status"), "code", "category", next_at.alias("next_at"), "key")
    out.write.mode("overwrite").parquet(f"{path}/batch={number}")


def deliver(requests: DataFrame, path: str, checkpoint: str, send: Send, paused: DataFrame) -> DataFrame:
    """Runs the stream of requests to its end and returns the log."""
    put = lambda batch, number: send_batch(batch, number, path, send, paused)
    requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return attempts(requests.sparkSession, path)


class Progress(StreamingQueryListener):
    """Rows of each batch of the queries that run while it is added, and their sum so far."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            before = max((total for run, _, _, total in self.rows if run == str(p.runId)), default=0)
            self.rows.append((str(p.runId), p.batchId, p.numInputRows, before + p.numInputRows))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run string, batch long, n long, total long")
