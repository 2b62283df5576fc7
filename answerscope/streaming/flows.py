"""Structured Streaming forms of the windows, deduplications and state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.sources.scratch import scratch_path

# Failures that open a breaker and seconds until it is tried again.
FAILURES, RESET_S = 5, 300
#: Microseconds of a time past every event.
END_US = 1 << 62


def read(spark: SparkSession, path: str, per_trigger: int | None = 100) -> DataFrame:
    """A stream over a Parquet table with its own schema; a table that is one file is picked from its folder.

    Without ``per_trigger`` all files that are there come in one batch, so that no row is late, whatever the order of the files."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()[:1]):
        return stream.option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    return stream.parquet(path)


def ending(events: DataFrame, time: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """``events``, and a call that ends them: a row of nulls past every event, from a source of its own, whose time closes all that is open."""
    spark = events.sparkSession
    path, past = scratch_path(spark, "stream-end"), F.timestamp_micros(F.lit(END_US))
    row = spark.range(1).select(*[(past if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    row.limit(0).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path)), lambda: row.write.mode("append").parquet(path)


def drained(stream: DataFrame, keys: list[str] | None = None, end: Callable[[], None] | None = None) -> DataFrame:
    """Everything that is there now, run through the stream; each batch replaces its own files, so a retry repeats nothing.

    Without ``keys`` the stream appends finished rows. With them it writes only the rows that a batch changed, and the last
    row of each key counts: neither state nor output is rewritten as a whole. With ``end`` of ``ending``, the stream goes on
    after its end, so that rows which the watermark still held back come as well."""
    spark = stream.sparkSession
    path, at = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def run() -> None:
        stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()

    run()
    if end is not None:
        end()
        run()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(path)
    if keys is None:
        return rows.select(*stream.columns)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row")).select("row.*")


def hourly_alerts(events: DataFrame) -> DataFrame:
    """One alert per key, kind and hour; repeats within the hour are dropped."""
    alerts = events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("at", F.col("ts").cast("timestamp"))
    return alerts.withWatermark("at", "2 hours").dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", "1 hour").groupBy("user_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", "1 hour").groupBy("event_type", F.window("at", width, slide).alias("w")).agg(F.count("*").alias("requests"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("tokens")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "requests", "tokens")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Activity of a key until it is silent for the gap; Spark joins events that are just the gap apart, so its own is a microsecond less."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.withWatermark("at", "1 hour").groupBy("user_id", F.session_window("at", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def callbacks(events: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """Callbacks whose time stamp is within the tolerance of their arrival, each id once."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    fresh = at.where(F.abs(F.unix_timestamp("received") - F.unix_timestamp("at")) <= tolerance_s)
    return fresh.withWatermark("at", f"{tolerance_s} seconds").dropDuplicatesWithinWatermark(["callback_id"]).select("callback_id")


def alert_table(events: DataFrame) -> DataFrame:
    """Alerts by key: created, raised, counted, and resolved by a later success."""
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return events.groupBy("user_id").agg(F.count_if(rank > 0).alias("occurrences"), F.max(rank).alias("severity"), (F.max_by("event_type", "event_id") == "purchase").alias("resolved"))


def validated(requests: DataFrame, transitions: DataFrame) -> DataFrame:
    """Requests (from_state, to_state) with whether the transition table allows them; a stream may be joined to the table."""
    allowed = transitions.select("from_state", "to_state", F.lit(True).alias("allowed"))
    return requests.join(F.broadcast(allowed), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def breaker(rows: pd.DataFrame, state: tuple[str, int, float]) -> tuple[list[tuple], tuple[str, int, float]]:
    """Fold of (event_id, seconds, failed) in order; state is (name, failures, opened)."""
    name, failures, opened = state
    out = []
    for event_id, second, failed in rows.itertuples(index=False):
        if name == "open" and second - opened >= RESET_S:
            name = "half_open"
        blocked = name == "open"
        if not blocked:
            if failed:
                failures += 1
                if name == "half_open" or failures >= FAILURES:
                    name, opened = "open", second
            else:
                name, failures = "closed", 0
        out.append((event_id, name, blocked))
    return out, (name, failures, opened)


def breaker_states(events: DataFrame) -> DataFrame:
    """State of each key's circuit breaker after every event, as a stream; late batches continue from the stored state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        now = state.get if state.exists else ("closed", 0, 0.0)
        out, now = breaker(rows[["event_id", "second", "failed"]], now)
        state.update(now)
        yield pd.DataFrame(out, columns=["event_id", "state", "blocked"])

    timed = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), (F.col("event_type") == "error").alias("failed"))
    timed = timed.select("user_id", "event_id", (F.col("micros") / 1e6).alias("second"), "failed")
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id long, state string, blocked boolean", "name string, failures int, opened double", "append", "NoTimeout")
