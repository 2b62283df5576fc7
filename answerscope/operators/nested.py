"""Rules over JSON of any depth: masking by key, deep merge of layers, redaction of payloads.

A document's depth is unknown, so the walk is a small recursion inside an
Arrow-batched function; everything around it stays in columns. Nulls and texts
that are no JSON object come back as they are (masking) or count as empty
(merging).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Key names (patterns) masked in reports, and how deep; key names masked in tasks, and how deep; what a secret looks like.
REPORT_KEYS, REPORT_DEPTH = r"(?i)api[_-]?key|secret|token|password|authorization", 5
TASK_KEYS = ("api_key", "api_secret", "token", "secret", "password", "authorization", "access_token", "refresh_token", "private_key", "key", "secret_key", "apikey")
TASK_DEPTH, KEY_START, KEY_WHOLE = 3, r"(sk-|ghp_|ak-|pk\.)", r"[A-Za-z0-9_\-\.]{32,}$"
MASK = "***REDACTED***"
# Letters of a body that are kept in a log, and the sections of an industry's configuration; the first is replaced as a whole.
BODY_LETTERS = 500
SECTIONS = ("kpi_weights", "hallucination_thresholds", "template_strategy", "competitor_rules")


def masked_value(value: Any, depth: int = 0) -> Any:
    """A report's context: secret keys at every depth down to REPORT_DEPTH, in lists too; deeper parts stay."""
    if depth > REPORT_DEPTH:
        return value
    if isinstance(value, dict):
        return {k: MASK if re.search(REPORT_KEYS, k) else masked_value(v, depth + 1) for k, v in value.items()}
    return [masked_value(v, depth + 1) for v in value] if isinstance(value, list) else value


def secret_looking(value: Any) -> bool:
    text = str(value)
    return len(text) >= 8 and bool(re.match(KEY_START, text) or len(text) >= 32 and re.match(KEY_WHOLE, text))


def masked_task_value(value: Any, left: int = TASK_DEPTH) -> Any:
    """A task's payload: exact key names, and values that look like keys; objects in lists, but no lists in lists."""
    if left <= 0 or not isinstance(value, dict):
        return value
    inner = lambda v: masked_task_value(v, left - 1) if isinstance(v, dict) else v
    return {k: MASK if k.lower() in TASK_KEYS or secret_looking(v) else [inner(x) for x in v] if isinstance(v, list) else inner(v) for k, v in value.items()}


def merged_value(base: dict, over: dict) -> dict:
    """Objects merge key by key; anything else, arrays too, replaces; null clears a value."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_value(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolved_value(default: dict, industry: dict, brand: dict) -> dict:
    """The sections of three layers: an industry's merge into the default, a brand's into these, its weights as a whole."""
    out = dict(default)
    for section in SECTIONS:
        if industry.get(section):
            out[section] = merged_value(out.get(section) or {}, industry[section])
        if section in brand:
            out[section] = brand[section] if section == SECTIONS[0] else merged_value(out.get(section) or {}, brand[section] or {})
    return out


def parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def walked(f: Callable[..., Any], *documents: Column) -> Column:
    """``f`` of parsed documents as JSON with sorted keys; null where ``f`` gives null."""

    @F.pandas_udf("string")
    def walk(texts: pd.DataFrame) -> pd.Series:
        out = [f(*map(parsed, row)) for row in texts.itertuples(index=False)]
        return pd.Series([None if v is None else canonical(v) for v in out], dtype=object)

    return walk(F.struct(*documents))


def objects(f: Callable[..., Any]) -> Callable[..., Any]:
    """``f`` over objects; whatever else a layer is counts as an empty one."""
    return lambda *values: f(*[v if isinstance(v, dict) else {} for v in values])


def masked(document: Column, task: bool = False) -> Column:
    """JSON text of a report's context, or of a task's payload, without its secrets; what is no JSON stays as it is."""
    return F.coalesce(walked(masked_task_value if task else masked_value, document), document)


def merged(*layers: Column) -> Column:
    """One JSON object of several layers, later ones over earlier ones."""
    return walked(objects(lambda *values: reduce(merged_value, values, {})), *layers)


def resolved(default: Column, industry: Column, brand: Column) -> Column:
    """The configuration of a brand from its three layers."""
    return walked(objects(resolved_value), default, industry, brand)


def redacted_payload(payload: Column) -> Column:
    """A publish payload for the log: no callback token, bodies cut."""

    def redact(value: Any) -> Any:
        if not isinstance(value, dict):
            return None
        callback, content = value.get("callback"), value.get("content")
        if isinstance(callback, dict) and "callback_token" in callback:
            value["callback"] = callback | {"callback_token": MASK}
        if isinstance(content, dict) and len(content.get("body_html") or "") > BODY_LETTERS:
            value["content"] = content | {"body_html": content["body_html"][:BODY_LETTERS] + "...[truncated]"}
        return value

    return F.coalesce(walked(redact, payload), payload)
