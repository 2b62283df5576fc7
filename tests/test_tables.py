"""Crash-safe rewrites: stop and go on, two writers; versioned records against a plain loop."""

import hashlib
import json
import random

import pytest
from answerscope.operators import versions
from answerscope.sources import tables
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_two_writers(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0
    t.create(spark.range(10).toDF("id"))
    new = t.stage(spark.range(10, 12).toDF("id"))
    assert t.commit(1, [new]) == 2
    other = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(tables.VersionConflictError):
        other.commit(1, [other.stage(spark.range(5).toDF("id"))])
    assert other.read().count() == 12 and other.read(1).count() == 10
    assert other.append(spark.range(1).toDF("id")) == 3
    assert t.read().count() == 13 and t.vacuum() == 1 and t.read().count() == 13


def test_update_and_retention_go_on_after_a_stop(spark, tmp_path):
    made = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("tenant"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), F.lit("old").alias("status"))
    results = []
    for stop in (None, 2):
        t = tables.VersionedTable(spark, f"file://{tmp_path}/u{stop}").create(made, segments=5, by="id")
        change = F.struct(F.lit("new").alias("status"))
        if stop:
            with pytest.raises(InterruptedError):
                tables.rewrite(t, "update", F.col("id") % 2 == 0, keep=change, stop_after=stop)
            assert 0 < t.read().where("status = 'new'").count() < 50
        assert tables.rewrite(t, "update", F.col("id") % 2 == 0, keep=change) == 50
        assert tables.rewrite(t, "update", F.col("id") % 2 == 0, keep=change) == 50  # done: no further version
        late = tables.retained({"0": 30, "1": 60}, "tenant", "ts", F.expr("timestamp_ntz '2024-04-01'"))
        gone = tables.rewrite(t, "retention", late)
        results.append((gone, rows(t.read())))
    assert results[0] == results[1]
    want = [r for r in rows(made.select("id", "tenant", "ts", F.when(F.col("id") % 2 == 0, "new").otherwise("old").alias("status"))) if not (r[1] == "0" and r[0] < 91 - 30 or r[1] == "1" and r[0] < 91 - 60)]
    assert results[0] == (100 - len(want), want)


def test_insert_once(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/i").create(spark.createDataFrame([(1, "a")], "k int, v string"))
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (3, None)], "k int, v string")
    assert tables.insert_once(t, new, ["k"], "job1") == 2
    assert tables.insert_once(t, new, ["k"], "job1") == 2 and tables.insert_once(t, new, ["k"], "job2") == 0
    assert rows(t.read().na.fill("-")) == [(1, "a"), (2, "b"), (3, "-")]


def test_cascade_resumes_to_the_same_receipt(spark, tmp_path):
    brands = spark.range(20).select(F.col("id").alias("brand"))
    runs = spark.range(60).select(F.col("id").alias("run"), (F.col("id") % 20).alias("brand"))
    answers = spark.range(300).select(F.col("id").alias("answer"), (F.col("id") % 60).alias("run"))
    parents = {"runs": ("brands", "brand", "brand"), "answers": ("runs", "run", "run")}
    doomed = brands.where("brand < 5")
    results = []
    for name, stop in (("whole", None), ("stopped", 2)):
        held = {n: tables.VersionedTable(spark, f"file://{tmp_path}/{name}/{n}").create(df, segments=4, by=df.columns[0]) for n, df in (("brands", brands), ("runs", runs), ("answers", answers))}
        while True:
            try:
                receipt = tables.cascade(held, parents, doomed, "brands", "brand", "request-1", stop_after=stop)
                break
            except InterruptedError:
                assert rows(held["brands"].read()) == rows(brands) or stop
        results.append((receipt, *[rows(t.read()) for t in held.values()]))
    assert results[0] == results[1]
    receipt = results[0][0]
    assert receipt["deleted_counts"] == {"answers": 75, "runs": 15, "brands": 5}
    canonical = json.dumps({k: receipt[k] for k in ("request_id", "deleted_counts")}, sort_keys=True, ensure_ascii=False)
    assert receipt["receipt_hash"] == hashlib.sha256(canonical.encode()).hexdigest()
    assert len(results[0][1]) == 15 and len(results[0][2]) == 45 and len(results[0][3]) == 225


VERSIONED = ["text", "level", "scope"]


def history_loop(requests):
    """Every record as a list of versions."""
    held, out = {}, {}
    for r in sorted(requests, key=lambda r: r[1]):
        record, seq, kind, expected, fields, target, _ = r
        own = held.setdefault(record, [])
        fields = fields or {}
        if kind == "create":
            if own:
                out[seq] = ("already_exists", len(own))
                continue
            own.append({k: fields.get(k) for k in VERSIONED})
        elif not own:
            out[seq] = ("not_found", 0)
            continue
        elif (expected is None and kind == "rollback") or (expected is not None and expected != len(own)):
            out[seq] = ("version_conflict", len(own))
            continue
        elif kind == "rollback":
            if not (target and 1 <= target <= len(own)):
                out[seq] = ("no_such_version", len(own))
                continue
            own.append(dict(own[target - 1]))
        else:
            new = own[-1] | {k: v for k, v in fields.items() if k in VERSIONED}
            if new == own[-1]:
                out[seq] = ("unchanged", len(own))
                continue
            own.append(new)
        out[seq] = ("done", len(own))
    return held, out


def test_versioned_records_equal_a_loop(spark):
    rng = random.Random(11)
    requests = [(f"r{rng.randrange(12)}", seq, rng.choice(["create", "update", "update", "update", "rollback"]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, {"text": rng.choice("ab")}, {"level": rng.choice("xyz"), "other": "o"}, {"scope": None}]), rng.choice([None, 1, 2, 9]), "me") for seq in range(400)]
    want, outcomes = history_loop(requests)
    for cuts in ([0, 400], [0, 90, 91, 400]):
        history = spark.createDataFrame([], versions.HISTORY)
        seen = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            done = versions.apply(history, spark.createDataFrame(requests[a:b], versions.REQUESTS), VERSIONED).collect()
            seen += done
            made = spark.createDataFrame([tuple(r)[:8] for r in done if r.outcome == "done"], versions.HISTORY)
            history = spark.createDataFrame([tuple(r) for r in history.union(made).collect()], versions.HISTORY)
        assert {r.seq: (r.outcome, r.current) for r in seen} == outcomes
        got = {}
        for r in sorted(history.collect(), key=lambda r: (r.record, r.version)):
            got.setdefault(r.record, []).append(r.fields)
        assert got == {k: v for k, v in want.items() if v}
    one = next(r for r, v in want.items() if len(v) > 2)
    pairs = spark.createDataFrame([(one, 1, 3), (one, 1, 1), (one, 2, 99)], "record string, a int, b int")
    found = {(r.a, r.b, r.field): (r.old, r.new) for r in versions.diff(history, pairs).collect()}
    a, b = want[one][0], want[one][2]
    assert {k[2]: v for k, v in found.items() if k[:2] == (1, 3)} == {k: (a[k], b[k]) for k in VERSIONED if a[k] != b[k]}
    assert not [k for k in found if k[:2] == (1, 1)]
    assert {r.record: r.fields for r in versions.at_version(history).collect()} == {k: v[-1] for k, v in want.items() if v}


def test_two_writers_of_one_version(spark):
    history = spark.createDataFrame([("t", 1, {"text": "a", "level": None, "scope": None}, "create", ["text"], None, "x", 0)], versions.HISTORY)
    both = [("t", 1, "update", 1, {"text": "b"}, None, "first"), ("t", 2, "update", 1, {"text": "c"}, None, "second")]
    got = {r.by: (r.outcome, r.current) for r in versions.apply(history, spark.createDataFrame(both, versions.REQUESTS), VERSIONED).collect()}
    assert got == {"first": ("done", 2), "second": ("version_conflict", 2)}
