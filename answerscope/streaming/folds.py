"""State machines with feedback as streams: task lifecycle, queue alerts, limiter cooldown.

Each is a plain fold of one key's rows in order, which ``folded`` runs over a
stream with the fold's state kept between batches. Only a key's rows of one
batch are in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Allowed moves of a task, seconds of its lock, least step and seconds between progress writes.
MOVES = {
    "queued": ("running", "cancelled", "blocked", "expired"), "scheduled": ("queued", "cancelled"), "running": ("completed", "failed", "retrying", "cancelled"),
    "retrying": ("running", "failed", "cancelled"), "completed": (), "failed": ("dead_lettered",), "cancelled": (), "dead_lettered": ("requeued",), "requeued": ("queued",),
    "blocked": ("queued", "cancelled"), "expired": (), "duplicate": (), "enqueue_failed": ("queued",),
}
LOCK_S, LEAST_STEP, LEAST_WAIT_S = 600, 0.05, 5
# Severities of the alert types.
ALERTS = {
    "queue_backlog_high": "warning", "dlq_backlog_high": "warning", "worker_offline": "critical", "retry_spike": "warning", "task_failure_rate_high": "critical",
    "platform_circuit_open": "critical", "task_timeout_spike": "warning",
}


def folded(stream: DataFrame, keys: list[str], order: str, fold: Callable, start: tuple, output: str, state: str) -> DataFrame:
    """``fold(rows, state) -> (rows, state)`` over each key's rows, sorted by ``order`` within a batch."""

    def step(key, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        out, now = fold(rows.to_dict("records"), kept.get if kept.exists else start)
        kept.update(now)
        names = [c.strip().split(" ")[0] for c in output.split(",")]
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(step, output, state, "append", "NoTimeout")


TASK_START = ("queued", 1, "", -1.0, 0.0, -1.0)


def task_fold(rows: list[dict], state: tuple) -> tuple[list[tuple], tuple]:
    """Requests (id, second, action, arg, pct) of one task; state: status, version, lock owner, lock end, progress, last progress write.

    A move happens if the table allows it; a lock is granted to a queued, unlocked task or when it has run out; a heartbeat
    prolongs it; progress is written if it changed by LEAST_STEP or LEAST_WAIT_S seconds passed.
    """
    status, version, owner, until, progress, wrote = state
    out = []
    for r in rows:
        second, action, done = float(r["second"]), r["action"], False
        if action == "move" and r["arg"] in MOVES.get(status, ()):
            status, version, done = r["arg"], version + 1, True
            progress = 1.0 if status == "completed" else progress
        elif action == "lock" and ((status == "queued" and not owner) or (owner and until < second)):
            owner, until, done = r["arg"], second + LOCK_S, True
        elif action == "release":
            owner, until, done = "", -1.0, True
        elif action == "heartbeat" and owner:
            until, done = second + LOCK_S, True
        elif action == "progress" and not (abs(r["pct"] - progress) < LEAST_STEP and wrote >= 0 and second - wrote < LEAST_WAIT_S):
            progress, wrote, done = max(0.0, min(1.0, r["pct"])), second, True
        out.append((r["id"], done, status, version, owner, progress))
    return out, (status, version, owner, until, progress, wrote)


def task_states(requests: DataFrame) -> DataFrame:
    """What each request did to its task (task, id, second, action, arg, pct), and the state after it."""
    return folded(requests, ["task"], "id", task_fold, TASK_START, "id long, done boolean, status string, version int, owner string, progress double", "status string, version int, owner string, until double, progress double, wrote double")


ALERT_START = ("none", "", -1, 0.0)


def alert_fold(rows: list[dict], state: tuple) -> tuple[list[tuple], tuple]:
    """Readings (id, hour, severity, value) of one alert scope; severity null: the metric has recovered.

    A reading of the same severity and hour updates the alert, critical after an open warning of the hour upgrades it,
    anything else makes a new one; recovery resolves an open one. State: status, severity, hour, value.
    """
    status, severity, hour, value = state
    out = []
    for r in rows:
        if r["severity"] is None:
            action = "resolved" if status == "open" else "none"
            status = "resolved" if status == "open" else status
        elif status != "none" and r["hour"] == hour and r["severity"] == severity:
            action, value = "updated", r["value"]
        elif status == "open" and r["hour"] == hour and severity == "warning" and r["severity"] == "critical":
            action, severity, value = "upgraded", "critical", r["value"]
        else:
            action, status, severity, hour, value = "created", "open", r["severity"], r["hour"], r["value"]
        out.append((r["id"], action, status, severity, value))
    return out, (status, severity, hour, value)


def alert_states(readings: DataFrame) -> DataFrame:
    """What each reading (scope, id, hour, severity, value) did to the alert of its scope."""
    return folded(readings, ["scope"], "id", alert_fold, ALERT_START, "id long, action string, status string, severity string, value double", "status string, severity string, hour long, value double")


LIMITER_START = ([], 0, -1.0)


def limiter(most_per_minute: int = 60, in_a_row: int = 3, cooldown_s: float = 60.0) -> Callable:
    """A fold of requests (id, second, limited, retry_after): refused while cooling down or over the budget of the last
    60 seconds; ``in_a_row`` 429 answers without a success between start a cooldown, as long as the answer asks at least."""

    def fold(rows: list[dict], state: tuple) -> tuple[list[tuple], tuple]:
        sent, hits, until = deque(state[0]), state[1], state[2]
        out = []
        for r in rows:
            second = float(r["second"])
            while sent and sent[0] <= second - 60.0:
                sent.popleft()
            verdict = "cooldown" if second < until else "over_budget" if len(sent) >= most_per_minute else "sent"
            if verdict == "sent":
                sent.append(second)
                hits = hits + 1 if r["limited"] else 0
                if r["limited"] and hits >= in_a_row:
                    until = second + max(cooldown_s, float(r["retry_after"]))
            out.append((r["id"], verdict, len(sent), hits))
        return out, (list(sent), hits, until)

    return fold


def limiter_states(requests: DataFrame, **limits) -> DataFrame:
    """What the limiter of each platform does with its requests (platform, id, second, limited, retry_after)."""
    return folded(requests, ["platform"], "id", limiter(**limits), LIMITER_START, "id long, verdict string, last_minute int, hits int", "sent array<double>, hits int, until double")
