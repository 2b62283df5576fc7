"""Sample sufficiency, report quality and the gate, against plain loops; every branch is reached."""

import random
from collections import Counter, defaultdict

import pytest
from answerscope.operators import report_gate as G
from answerscope.operators import sufficiency as S
from answerscope.plans import assurance, registry  # noqa: F401  (registers the queries)
from pyspark.sql import functions as F

ANSWERS = "run string, platform string, question_type string, status string, error_code string, error_message string, answer string"
DENOMINATORS = "run string, kpi string, denominator bigint"
NEEDS = S.Needs(total=6, per_platform=2, per_type=2, per_kpi=3, by_platform={"c": 1}, by_type={"t3": 3}, by_kpi={"citation": 2}, critical_platforms=("a", "d"), critical_types=("t1",), critical_kpis=("sov", "citation"))


def made(seed, size):
    r = random.Random(seed)
    rows = []
    for _ in range(size):
        run = r.choice(["r0", "r0", "r0", "r0", "r1", "r1", "r2", "r3", "r4", "stray", None])
        bad = {"r3": 0.9, "r1": 0.3}.get(run, 0.05)
        status = "failed" if r.random() < bad else "success"
        code = r.choice(["content_filtered", "slow", "E429"]) if r.random() < 0.08 else r.choice([None, ""])
        rows.append((run, r.choice("abcd") if r.random() < 0.97 else None, r.choice(["t1", "t2", "t3", None]), status, code, r.choice(["HTTP 429", "broken"]) if r.random() < 0.04 else r.choice([None, ""]), r.choice(["text", "text", "text", "text", "  ", "", None])))
    runs = ["r0", "r1", "r2", "r3", "r4", "silent"]
    denominators = [(run, k, r.choice([0, 2, 3, 9, None])) for run in runs[:5] for k in S.KPIS if r.random() < 0.9]
    return runs, rows, denominators


def judged(run, rows, denominators, needs):
    """One run's assessment by a loop over its answers."""
    rows = [x for x in rows if x[0] == run]
    valid, types, platforms = 0, Counter(), defaultdict(lambda: [0, False])
    for _, platform, kind, status, code, message, answer in rows:
        p = platforms[platform or "unknown"]
        fit = status == "success" and code not in S.NOT_VALID
        p[0] += bool(fit and answer)
        if message:
            p[1] |= "429" in message or "429" in (code or "")
        if fit and answer and answer.strip():
            valid += 1
            types[kind or "unknown"] += 1
    least = lambda own, name, otherwise: own.get(name, otherwise)
    low_p = {n: (g, least(needs.by_platform, n, needs.per_platform)) for n, (g, _) in platforms.items() if g < least(needs.by_platform, n, needs.per_platform)}
    low_t = {n: (c, least(needs.by_type, n, needs.per_type)) for n, c in types.items() if c < least(needs.by_type, n, needs.per_type)}
    given = {k: max((n or 0 for r, kk, n in denominators if r == run and kk == k), default=0) for k in S.KPIS}
    low_k = {k: (n, least(needs.by_kpi, k, needs.per_kpi)) for k, n in given.items() if n < least(needs.by_kpi, k, needs.per_kpi)}
    ok = sum(n not in low_p and not limited for n, (_, limited) in platforms.items())
    blocks = [("SAMPLE_TOTAL_TOO_LOW", "total", valid, needs.total)] if valid < needs.total else []
    for code, prefix, low, critical in (("SAMPLE_CRITICAL_PLATFORM_MISSING", "platform", low_p, needs.critical_platforms), ("SAMPLE_QTYPE_TOO_LOW", "qtype", low_t, needs.critical_types), ("SAMPLE_KPI_TOO_LOW", "kpi", low_k, needs.critical_kpis)):
        blocks += [(code, f"{prefix}:{n}", *low[n]) for n in sorted(low) if n in critical]
    short = blocks or ok < needs.platforms or needs.all_platforms and ok < len(platforms) or any(n not in platforms for n in needs.critical_platforms)
    status = "no_data" if not valid else "insufficient" if short else "partial" if low_p or low_t else "ok"
    return (len(rows), valid, len(platforms), ok, status, [("NO_DATA", "all", None, None)] if not valid else blocks)


@pytest.mark.parametrize(("seed", "size", "every"), [(1, 60, False), (2, 150, False), (3, 400, True), (4, 900, False), (5, 0, False)])
def test_sufficiency_equals_loop(spark, seed, size, every):
    runs, rows, denominators = made(seed, size)
    needs = S.Needs(**(NEEDS.__dict__ | {"all_platforms": every}))
    got = S.assess(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame(rows, ANSWERS), spark.createDataFrame(denominators, DENOMINATORS), needs).collect()
    assert {g.run: (g.n_raw, g.n_valid, g.n_platforms, g.n_ok_platforms, g.data_status, [tuple(b)[:4] for b in g.blocks]) for g in got} == {r: judged(r, rows, denominators, needs) for r in runs}
    assert all(len(g.kpis) == len(S.KPIS) and g.n_eligible == g.n_valid for g in got)


def test_sufficiency_ok_and_partial(spark):
    rows = [(run, p, t, "success", None, None, "x") for run in ("good", "part") for p in "ab" for t in ("t1", "t2") for _ in range(3)] + [("part", "z", "t1", "success", None, None, " ")]
    a = spark.createDataFrame(rows, ANSWERS)
    got = {g.run: g for g in S.assess(a.select("run"), a, spark.createDataFrame([], DENOMINATORS)).collect()}
    assert (got["good"].data_status, got["good"].summary, got["good"].warnings) == ("ok", S.SUMMARIES["ok"], [])
    assert (got["part"].data_status, got["part"].warnings, got["part"].summary) == ("partial", ["SAMPLE_PARTIAL_PLATFORM"], S.SUMMARIES["partial"])
    assert [(p.platform, p.status, p.given) for p in got["part"].platforms] == [("a", "ok", 6), ("b", "ok", 6), ("z", "insufficient", 1)]


def test_question_types_fall_back(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (9, 2), (9, 9), (None, None)], "version_id int, template_id int")
    v = spark.createDataFrame([(1, "new"), (2, "unknown")], "version_id int, question_type string")
    t = spark.createDataFrame([(1, "old"), (2, "older")], "template_id int, question_type string")
    assert sorted(r.question_type for r in S.question_types(a, v, t).collect()) == ["new", "old", "older", "unknown", "unknown"]


@pytest.mark.parametrize("wrong", [{"total": -1}, {"platforms": 0}, {"by_kpi": {"sov": -1}}])
def test_needs_are_checked(wrong):
    with pytest.raises(ValueError, match="must"):
        S.Needs(**wrong)


def test_queries_reach_every_branch(spark, data):
    statuses = registry.QUERIES["q12_sufficiency_assessment"](spark, data).select("data_status", F.split("platforms", ",").alias("p")).collect()
    assert {s.data_status for s in statuses} >= {"no_data", "insufficient", "partial", "ok"}
    assert {x.split("=")[1] for s in statuses for x in s.p if x} == {"ok", "rate_limited", "no_valid_answer", "insufficient"}


CLAIMS = "run string, verdict string, severity string, subject_type string, claim_type string, strength string, conflict string, field string"
RUNS = "run string, templates struct<critical_invalid:int,can_collect:boolean,optional_skipped:int>, coverage double, platform_coverage map<string,double>, denominators map<string,bigint>, limits map<string,double>"
FINE = ((0, True, 0), 0.9, {"p": 0.5}, {"citation_rate": 4}, None)


def wrong(run, claim_type, n=1, **more):
    row = {"run": run, "verdict": "contradicted", "severity": "P0", "subject_type": "target_brand", "claim_type": claim_type, "strength": None, "conflict": None, "field": None} | more
    return [tuple(row[c.split()[0]] for c in CLAIMS.split(", "))] * n


CASES = {
    "fine": (FINE, wrong("fine", "fact", 5), [], []),
    "silent": (FINE, [], [], []),
    "no templates": ((None, *FINE[1:]), [], ["TEMPLATE_HEALTH_MISSING"], []),
    "critical": (((1, False, 1), *FINE[1:]), [], ["CRITICAL_TEMPLATE_INVALID"], ["OPTIONAL_SKIPPED"]),
    "closed": (((0, False, None), *FINE[1:]), [], ["CANNOT_COLLECT"], []),
    "unsure": (((None, None, None), *FINE[1:]), [], [], []),
    "uncovered": ((FINE[0], None, None, None, None), [], ["COVERAGE_DATA_MISSING", "METRIC_DATA_MISSING"], []),
    "thin": ((FINE[0], 0.59, {"p": 0.49, "q": None}, {}, None), [], ["METRIC_COVERAGE_LOW", "METRIC_DATA_MISSING"], ["PLATFORM_LOW_COVERAGE"]),
    "zero": ((FINE[0], 0.6, {}, {"completeness_rate": 0, "other": 0}, None), [], ["CORE_KPI_ZERO_DENOMINATOR"], []),
    "guess": (FINE, wrong("guess", "speculation", 6) + wrong("guess", "fact", 5), ["EXCESSIVE_SPECULATION"], []),
    "half": (FINE, wrong("half", "speculation", 5) + wrong("half", "fact", 5), [], ["HIGH_SPECULATION_RATIO"]),
    "own limit": ((*FINE[:4], {"max_speculation_ratio": 0.5}), wrong("own limit", "speculation", 5) + wrong("own limit", "fact", 5), [], []),
    "opinion": (FINE, wrong("opinion", "opinion", 7) + wrong("opinion", "fact", 3), [], ["HIGH_OPINION_RATIO"]),
    "unknown": (FINE, wrong("unknown", None, 1) + wrong("unknown", "rumour", 2) + wrong("unknown", "fact", 7), [], ["HIGH_UNKNOWN_RATIO"]),
    "unsupported": (FINE, wrong("unsupported", "fact", 60, verdict="unsupported") + wrong("unsupported", "fact", 41, verdict="gt_insufficient"), [], ["HIGH_GT_UNSUPPORTED"]),
    "conflict": (FINE, wrong("conflict", "fact", conflict="strong_conflict", field="f"), [], ["EVIDENCE_STRONG_CONFLICT"]),
    "clash": (FINE, wrong("clash", "fact", conflict="critical_conflict", field="f") + wrong("clash", "fact", conflict="strong_conflict", field="g"), ["CRITICAL_EVIDENCE_CONFLICT"], []),
    "weak": (FINE, wrong("weak", "fact", 5, strength="weak") + wrong("weak", "fact", 2, strength="insufficient_evidence") + wrong("weak", "fact", 4, strength="strong") + wrong("weak", "fact", 9, strength="disputed"), [], ["WEAK_EVIDENCE_DOMINANCE"]),
    "fields": (FINE, [c for f in "xyz" for c in wrong("fields", "fact", conflict="critical_conflict", field=f)] + wrong("fields", "fact", 1, strength="insufficient_evidence") + wrong("fields", "fact", 9, strength="moderate"), ["CRITICAL_EVIDENCE_CONFLICT"], ["INSUFFICIENT_EVIDENCE_FIELDS"]),
}


def test_gate_cases(spark):
    runs = spark.createDataFrame([(name, *case[0]) for name, case in CASES.items()] + [("lost", *FINE)], RUNS)
    rows = [c for case in CASES.values() for c in case[1]]
    summaries = G.quality_summary(runs.where("run <> 'lost'"), spark.createDataFrame(rows, CLAIMS))
    got = {r.run: (r.blocks, r.warnings, r.publishable) for r in G.publishable(runs, summaries).collect()}
    assert got == {name: (blocks, warnings, not blocks) for name, (_, _, blocks, warnings) in CASES.items()} | {"lost": (["QUALITY_SCHEMA_MISSING"], [], False)}


def test_summary_counts(spark):
    rows = wrong("r", "fact", 2) + wrong("r", "rumour", 1, severity=None) + wrong("r", None, 1, severity="P2", field="", conflict="critical_conflict") + wrong("r", "fact", 3, subject_type="competitor") + wrong("r", "fact", 4, verdict="generic_statement") + wrong("r", None, 1, verdict=None, severity=None, field="f", conflict="critical_conflict") + wrong(None, "fact")
    got = G.quality_summary(spark.createDataFrame([("r",), ("r",)], "run string"), spark.createDataFrame(rows, CLAIMS)).collect()
    assert len(got) == 1
    g = got[0]
    assert (g.n_p0, g.n_p1, g.n_p2, g.n_confirmed, g.n_generic, g.n_fact, g.n_unknown, g.n_classified) == (2, 0, 1, 4, 4, 2, 2, 4)
    assert [tuple(b) for b in g.breakdown] == [("fact", "P0", 2), ("unknown", "Info", 1), ("unknown", "P2", 1)]
    assert (g.conflicts, g.critical) == (["f"], ["f"])
