"""Queries on made-up events against their SQL, where the driver's small tables hold no such rows."""

import os

import duckdb
import pandas as pd
import pytest
from answerscope.plans import operations, registry, states  # noqa: F401
from oracle import same

HOUR = 3600


def write(path, rows, name="events.parquet"):
    """Events (id, seconds, user, type)."""
    table = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"])
    table["ts"] = (pd.to_datetime(0, unit="s") + pd.to_timedelta((table["ts"] * 1_000_000).round(), unit="us")).astype("datetime64[us]")
    table.assign(event_id=table["event_id"].astype("int64"), value=1.0, props="{}").to_parquet(f"{path}/{name}")


def check(spark, path, name, files="events.parquet"):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/{files}'")
    same(registry.QUERIES[name](spark, str(path)), registry.ORACLE_SQL[name], c)


def test_gate_at_its_thresholds(spark, tmp_path):
    """Shares on and beside each threshold: every count of every type in runs of up to 80 events."""
    rows, run = [], 0
    for n in (19, 31, 38, 57, 62, 66, 77):
        for k in range(n + 1):
            for kind in ("view", "click", "purchase", "signup", "error"):
                rows += [(len(rows) + i, 0, run, kind if i < k else "other") for i in range(n)]
                run += 1
    write(tmp_path, rows)
    check(spark, tmp_path, "q2_publishable_gate")


def test_only_the_watermark_runs_items_out_after_the_last_signup(spark, tmp_path):
    """Items that end in the hour before the last event stay open, whatever else their user does; rows without type or time change nothing."""
    day, end = 24 * HOUR, 100 * HOUR
    rows = [(1, end - day - 1800, 1, "signup"), (2, end - 600, 1, "click"), (3, end - day - 2 * HOUR, 2, "signup"), (4, end - 600, 2, "view"), (5, end, 9, "error")]
    rows += [(6, end - day - 1800, 3, "signup"), (7, end - 600, 3, "purchase"), (8, end - day - 1800, 4, "signup"), (9, end - 600, 4, "signup"), (10, end - day - HOUR, 5, "signup")]
    rows += [(11, 10 * HOUR, 6, "signup"), (12, 11 * HOUR, 6, None), (13, 10 * HOUR, 7, "signup"), (14, None, 7, "purchase"), (15, None, 7, "signup"), (16, 10 * HOUR, 8, "signup"), (17, 10 * HOUR + day, 8, "purchase")]
    write(tmp_path, rows)
    got = {r.key for r in registry.QUERIES["st10_expired_items"](spark, str(tmp_path)).collect()}
    assert got == {2, 3, 4, 6, 7}
    check(spark, tmp_path, "st10_expired_items")


def many_files(path):
    """More files than a batch of the streams takes by default, the newest events first."""
    path = path / "events.parquet"
    path.mkdir()
    kinds = ("signup", "click", "view", "purchase", "error")
    for i in range(102):
        at = (400 - 3 * i) * HOUR
        write(path, [(10 * i + k, at + 600 * k, i % 4, kinds[(i + k * k) % 5]) for k in range(10)], f"{i:03d}.parquet")
        os.utime(path / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.mark.parametrize("name", ["st10_expired_items", "st9_callback_outcomes"])
def test_files_in_any_order(spark, tmp_path, name):
    many_files(tmp_path)
    check(spark, tmp_path, name, "events.parquet/*.parquet")
