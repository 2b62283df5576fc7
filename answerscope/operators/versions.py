"""Versioned records: create, update and rollback with an expected version, their history, and what was refused.

Requests of one record are folded in their order: an update that expects another
version than the current one is refused, so that of two writers who saw the
same version one wins; an update that changes no versioned field makes no
version; a rollback is a new version with an old one's fields. The history is
append-only: ``apply`` continues from it and returns what to append. A record's
requests are one group; its size is a record's edits, not the table's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests: record, seq, kind (create, update, rollback), expected (null: any), fields (JSON object text), target, by.
REQUESTS = "record string, seq long, kind string, expected int, fields map<string,string>, target int, by string"
HISTORY = "record string, version int, fields map<string,string>, change_type string, changed array<string>, rollback_from int, by string, seq long"
OUT = HISTORY + ", outcome string, current int"
CONFLICT, UNCHANGED, MISSING, NO_TARGET, EXISTS = "version_conflict", "unchanged", "not_found", "no_such_version", "already_exists"


def given(value) -> int | None:
    return None if value is None or value != value else int(value)


def fold(record: str, past: list[dict], requests: list[dict], versioned: Sequence[str]) -> list[tuple]:
    """What each request did: a row of history, or a refusal with its reason and the version it met."""
    held = {p["version"]: dict(p["fields"]) for p in past}
    now = max(held, default=0)
    fields, out = dict(held.get(now, {})), []
    for r in sorted(requests, key=lambda r: r["seq"]):
        kind, expected, asked, target = r["kind"], given(r["expected"]), dict(r["fields"] or {}), given(r["target"])
        changed, made, refused = [], None, None
        if kind == "create":
            refused = EXISTS if now else None
            made, changed = {k: asked.get(k) for k in versioned}, [k for k in versioned if asked.get(k) is not None]
        elif not now:
            refused = MISSING
        elif expected is not None and expected != now or kind == "rollback" and expected is None:
            refused = CONFLICT
        elif kind == "rollback":
            refused = None if target in held else NO_TARGET
            made = dict(held.get(target, {}))
            changed = [k for k in versioned if made.get(k) != fields.get(k)]
        else:
            changed = [k for k in versioned if k in asked and asked[k] != fields.get(k)]
            refused = None if changed else UNCHANGED
            made = fields | {k: asked[k] for k in changed}
        if refused:
            out.append((record, None, None, kind, [], target, r["by"], r["seq"], refused, now))
            continue
        now += 1
        fields = held[now] = made
        out.append((record, now, made, kind, changed, target if kind == "rollback" else None, r["by"], r["seq"], "done", now))
    return out


def apply(history: DataFrame, requests: DataFrame, versioned: Sequence[str]) -> DataFrame:
    """One row per request: a new row of history (``outcome`` done), or a refusal; ``current`` is the version after it."""
    names = [c.strip().split(" ")[0] for c in OUT.split(", ")]
    entries = F.map_entries("fields").alias("fields")  # pairs read alike in every frame
    asked = requests.groupBy("record").agg(F.collect_list(F.struct("seq", "kind", "expected", entries, "target", "by")).alias("asked"))
    # of the past only records that are asked about are needed
    held = history.join(requests.select("record").distinct(), "record", "left_semi")
    past = held.groupBy("record").agg(F.collect_list(F.struct("version", entries)).alias("past"))

    def pairs(rows) -> list[dict]:
        """Structs of an array as plain dictionaries, their fields as one."""
        out = []
        for row in rows if rows is not None else ():
            row = row.asDict() if hasattr(row, "asDict") else dict(row)
            row["fields"] = {e["key"]: e["value"] for e in row["fields"]} if row["fields"] is not None else {}
            out.append(row)
        return out

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [r for record, a, p in zip(part["record"], part["asked"], part["past"], strict=True) for r in fold(record, pairs(p), pairs(a), versioned)]
            yield pd.DataFrame(rows, columns=names).astype({"version": "Int32", "rollback_from": "Int32", "current": "Int32", "seq": "Int64"})

    return asked.join(past, "record", "left").select("record", "asked", "past").mapInPandas(step, OUT)


def appended(outcome: DataFrame) -> DataFrame:
    return outcome.where("outcome = 'done'").drop("outcome", "current")


def diff(history: DataFrame, of: DataFrame) -> DataFrame:
    """Field by field what differs between two versions; ``of``: record, a, b. A version that does not exist has no fields."""
    side = lambda n: history.select("record", F.col("version").alias(n), F.col("fields").alias(f"fields_{n}"))
    both = of.join(side("a"), ["record", "a"], "left").join(side("b"), ["record", "b"], "left")
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("fields_a", none), F.coalesce("fields_b", none)
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    rows = both.select("record", "a", "b", F.explode(F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(a, k).alias("old"), F.try_element_at(b, k).alias("new")))).alias("d"))
    return rows.select("record", "a", "b", "d.*").where(~F.col("old").eqNullSafe(F.col("new")))


def at_version(history: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """The latest fields of each record, or those of the version that ``as_of`` (record, version) names."""
    if as_of is not None:
        return history.join(as_of, ["record", "version"])
    return history.groupBy("record").agg(F.max_by(F.struct(*[c for c in history.columns if c != "record"]), "version").alias("r")).select("record", "r.*")
