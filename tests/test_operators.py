"""Rule operators on small fixtures that reach every branch, and the stream folds against plain loops."""

import pytest
from answerscope.operators import claims, evidence, industry, quality
from answerscope.plans import registry, rules
from answerscope.streaming import flows, folds
from pyspark.sql import functions as F

SIGNALS = {"food": {"brand_name": ("茶",), "product": ("咖啡", "饮品", "烘焙", "甜品", "小吃", "酒"), "gt_field": ("menu",)}, "cars": {"product": ("汽车", "电池"), "scenario": ("通勤",), "competitor": ("对手",)}}


@pytest.mark.parametrize(
    ("brand", "want"),
    [
        (("茶铺", "咖啡 饮品 烘焙 甜品 小吃 酒", "", "", ["menu"], "retail b2b"), ("food", "high", 0.38, False, ["retail", "b2b"])),
        (("茶铺", "咖啡", "", "", [], ""), ("food", "medium", 0.15, True, [])),
        (("无名", "汽车 电池", "", "", [], ""), ("cars", "low", 0.1, True, [])),
        (("茶铺", "汽车", "通勤", "对手", [], ""), ("cars", "low", 0.14, True, [])),
        ((None, None, None, None, None, None), ("unknown", "low", 0.0, True, [])),
    ],
)
def test_industry(spark, brand, want):
    df = spark.createDataFrame([brand], "brand_name string, products string, scenarios string, competitors string, gt_fields array<string>, official_site string")
    r = industry.classify(df, SIGNALS, {"food": "餐饮"}).first()
    assert (r.primary, r.confidence, r.score, r.needs_confirmation, r.tags) == want
    if want[0] == "food":
        assert r.primary_name == "餐饮" and "餐饮" in r.reason and f"{want[2]:.2f}" in r.reason
    if want == ("cars", "low", 0.14, True, []):
        assert r.secondary == ["food"] and r.alternatives == ["food"]


def checked(spark, text, edition):
    r = quality.check_reports(spark.createDataFrame([(text, edition)], "text string, edition string")).first()
    return r.report_score, r.report_status, r.violations


def test_reports(spark):
    good = " ".join(quality.SECTIONS["executive"])
    assert checked(spark, good, "executive") == (100, "passed", [])
    assert checked(spark, good + " 绝对 100%", "executive") == (90, "passed", ["forbidden_absolute_terms:绝对", "forbidden_absolute_terms:100%"])
    assert checked(spark, good + " {{x}}", "executive")[0] == 90
    assert checked(spark, "```SOV``` https://a.b/LLM " + good, "executive")[0] == 100
    assert checked(spark, "SOV ```SOV``` " + good, "executive") == (95, "passed", ["technical_term_in_executive:SOV"])
    assert checked(spark, None, "executive") == (60, "warning", [f"missing_section:{s}" for s in quality.SECTIONS["executive"]])
    assert checked(spark, "", "implementation")[:2] == (45, "failed")
    assert checked(spark, " ".join(quality.SECTIONS["implementation"]) + " | 内容资产", "implementation")[0] == 100
    full = " ".join(quality.SECTIONS["customer"])
    assert checked(spark, full + " 得分: 得分:", "customer") == (90, "passed", ["few_kpi_explanations"])
    assert checked(spark, full + " 得分: 得分: 得分:", "customer")[0] == 100
    assert checked(spark, "anything", "odd")[0] == 100


def test_templates(spark):
    columns = "template_text string, question_type string, template_level string, question_scope string, brand_directed double, metric_eligibility array<string>, applicable array<string>, excluded array<string>"
    rows = [
        ("  ", "x", "y", None, 3.0, None, None, None),
        ("{品牌} {odd} {行业}", "brand_trust", "critical", "brand_directed", 0.25, ["sov", "citation_rate", "strange"], ["a"], ["a"]),
        ("x" * 2001, "odd", "odd", "odd", 0.3, [], [], ["a"]),
        ("plain", "generic_advice", "critical", "generic", 1.0, None, ["a"], ["b"]),
    ]
    a, b, c, d = quality.check_templates(spark.createDataFrame(rows, columns)).collect()
    assert (a.errors, a.warnings, a.valid, a.variables) == (["EMPTY_TEMPLATE"], [], False, [])
    assert b.errors == ["UNKNOWN_VARIABLE", "KPI_QTYPE_MISMATCH", "INDUSTRY_CONFLICT"] and b.warnings == ["SCOPE_DIRECTED_MISMATCH", "KPI_NOT_RECOMMENDED"]
    assert b.required_fields == ["industry", "official_name"]
    assert c.errors == ["TEMPLATE_TOO_LONG", "INVALID_QTYPE", "INVALID_LEVEL", "INVALID_BRAND_DIRECTED"] and c.warnings == ["INVALID_SCOPE"]
    assert d.valid and d.warnings == ["CRITICAL_NO_BRAND_VAR"]


def test_platform_health(spark):
    def rows(platform, n_ok, n_bad, code="x", minute="30"):
        ok = [(platform, "success", 100.0, None, f"2024-01-01 10:{minute}:{i:02d}") for i in range(n_ok)]
        return ok + [(platform, "error", 300.0, code, f"2024-01-01 10:{minute}:{30 + i:02d}") for i in range(n_bad)]

    data = rows("fine", 9, 1) + rows("poor", 5, 5) + rows("limited", 20, 6, "platform_rate_limited") + rows("off", 1, 0) + [("old", "error", 1.0, "late", "2024-01-01 01:00:00")]
    results = spark.createDataFrame(data, "platform string, status string, latency_ms double, error_code string, at string").withColumn("collected_at", F.to_timestamp("at"))
    platforms = spark.createDataFrame([(p, p != "off", "paused" if p == "off" else None) for p in ("fine", "poor", "limited", "off", "old", "never")], "platform string, enabled boolean, disabled_reason string")
    got = {r.platform: r for r in quality.platform_health(results, platforms, F.to_timestamp(F.lit("2024-01-01 11:00:00"))).collect()}
    assert {k: v.status for k, v in got.items()} == {"fine": "healthy", "poor": "degraded", "limited": "rate_limited", "off": "disabled", "old": "healthy", "never": "healthy"}
    assert (got["fine"].success_rate_1h, got["fine"].avg_latency_ms, got["old"].success_rate_1h, got["old"].last_error_code) == (90.0, 120, 100.0, "late")
    assert got["off"].disabled_reason == "paused" and got["never"].last_success_at is None and got["limited"].limited_1h == 6


@pytest.mark.parametrize(
    ("field", "value", "found", "want"),
    [
        ("founded_year", "1971", [("S", "founded in 1985")], ("D", "contradicted", 0.0)),
        ("founded_year", "1971", [("A", "founded in 1985"), ("B", "established 1986")], ("D", "contradicted", 0.0)),
        ("founded_year", "1971", [("A", "founded in 1985"), ("S", "founded in 1971")], ("A", "confirmed_strong", 1.0)),
        ("founded_year", "1971", [("S", "listed on the market 1992")], ("C", "unconfirmed", 0.0)),
        ("official_name", "Acme", [("A", "the acme group"), ("B", "acme")], ("B", "confirmed_multi", 0.9)),
        ("official_name", "Acme", [("A", "acme")], ("B", "confirmed_strong", 0.9)),
        ("official_name", "Acme", [("B", "acme"), ("B", "acme")], ("B", "confirmed_multi", 0.9)),
        ("official_name", "Acme", [("B", "acme"), ("C", "acme")], ("B", "confirmed_single", 0.9)),
        ("official_name", "Acme", [("C", "acme"), ("D", "acme")], ("C", "weak_support", 0.0)),
        ("official_name", "Acme", [("D", "acme")], ("C", "unconfirmed", 0.0)),
        ("official_domains", "www.x.com", [("S", "any words")], ("A", "confirmed_strong", 0.95)),
        ("core_products", "a b c d e", [("S", "a b z")], ("A", "confirmed_strong", 0.4)),
        ("headquarters", "Shanghai", [("S", "in London")], ("C", "unconfirmed", 0.0)),
        ("slogan", "good coffee", [("S", "so good coffee"), ("S", None)], ("A", "confirmed_strong", 0.7)),
        ("slogan", None, [("S", "text")], ("C", "unconfirmed", 0.0)),
    ],
)
def test_field_verification(spark, field, value, found, want):
    values = spark.createDataFrame([("b", field, value)], "brand string, field string, value string")
    results = spark.createDataFrame([("b", field, 1 + i // 5, 1 + i % 5, "https://x.com/a", text, tier) for i, (tier, text) in enumerate(found)], "brand string, field string, n int, rank int, url string, snippet string, tier string")
    r = evidence.verify_fields(values, results).first()
    assert (r.validated_tier, r.validation_status, r.match_score) == want


def test_late_results_do_not_count(spark):
    values = spark.createDataFrame([("b", "official_name", "Acme")], "brand string, field string, value string")
    results = spark.createDataFrame([("b", "official_name", 4, 1, "u", "acme", "S"), ("b", "official_name", 1, 6, "u", "acme", "S")], "brand string, field string, n int, rank int, url string, snippet string, tier string")
    assert evidence.verify_fields(values, results).first().validation_status == "unconfirmed"
    assert [r.query for r in evidence.search_queries(values).orderBy("n").collect()] == ["b 官方名称", "b 公司简介", "b official name"]  # a query names the brand, not the value


def test_detection_chain(spark):
    answers = spark.createDataFrame(
        [(1, "b", "星巴克是一家咖啡行业的公司，成立于1971年。星巴克可能将推出新产品。", ["星巴克"], ["瑞幸"], "fnb"), (2, "b", "今天天气很好，适合出门散步。", ["星巴克"], ["瑞幸"], "fnb"), (3, "c", None, ["x"], [], None)],
        "answer_id long, brand string, answer_text string, names array<string>, competitors array<string>, industry string",
    )
    facts = spark.createDataFrame([("b", "industry", "咖啡行业")], "brand string, field string, fact string")
    rows = claims.detect(answers, facts).collect()
    assert {r.answer_id for r in rows} == {1} and {r.relevance for r in rows} == {"brand_centric"}
    by_field = {r.field: r for r in rows}
    assert by_field["industry"].verdict == "supported" and by_field["official_name"].verdict in ("gt_insufficient", "not_checkable")
    assert any(r.nature == "speculation" for r in rows)


# --- folds -------------------------------------------------------------------


def by_key(rows, key):
    out = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        out.setdefault(r[key], []).append(r)
    return out


def batch_rows(make, spark, data, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(flows, "read", lambda s, path, **k: s.read.parquet(path))
        return [r.asDict() for r in make(spark, data).collect()]


def test_task_lifecycle_equals_loop(spark, data, monkeypatch):
    want = {}
    for rows in by_key(batch_rows(rules.requests, spark, data, monkeypatch), "task").values():
        status, version, lock, shown = "queued", 1, None, (0.0, None)
        for r in rows:
            done, t = False, r["second"]
            match r["action"]:
                case "move":
                    done = r["arg"] in folds.MOVES[status]
                    if done:
                        status, version = r["arg"], version + 1
                        if status == "completed":
                            shown = (1.0, shown[1])
                case "lock":
                    done = (lock is None and status == "queued") or (lock is not None and lock[1] < t)
                    lock = (r["arg"], t + 600) if done else lock
                case "release":
                    done, lock = True, None
                case "heartbeat":
                    done = lock is not None
                    lock = (lock[0], t + 600) if done else None
                case "progress":
                    done = abs(r["pct"] - shown[0]) >= 0.05 or shown[1] is None or t - shown[1] >= 5
                    shown = (r["pct"], t) if done else shown
            want[r["id"]] = (done, status, version, lock[0] if lock else "", shown[0])
    got = {r.id: (r.done, r.status, r.version, r.owner, r.progress) for r in registry.QUERIES["st6_task_lifecycle"](spark, data).collect()}
    assert got == want and len({v[1] for v in want.values()}) > 5


def test_alert_lifecycle_equals_loop(spark, data, monkeypatch):
    want = {}
    for rows in by_key(batch_rows(rules.readings, spark, data, monkeypatch), "scope").values():
        alerts = []
        for r in rows:
            last = alerts[-1] if alerts else None
            if r["severity"] is None:
                action = "resolved" if last and last["open"] else "none"
                if last:
                    last["open"] = False
            elif last and (last["hour"], last["severity"]) == (r["hour"], r["severity"]):
                action, last["value"] = "updated", r["value"]
            elif last and last["open"] and last["hour"] == r["hour"] and (last["severity"], r["severity"]) == ("warning", "critical"):
                action = "upgraded"
                last.update(severity="critical", value=r["value"])
            else:
                action = "created"
                alerts.append({"open": True, "hour": r["hour"], "severity": r["severity"], "value": r["value"]})
            want[r["id"]] = action
    got = {r.id: r.action for r in registry.QUERIES["st11_alert_lifecycle"](spark, data).collect()}
    assert got == want and set(want.values()) == {"created", "updated", "upgraded", "resolved", "none"}


def test_limiter_equals_loop(spark, data, monkeypatch):
    want = {}
    for rows in by_key(batch_rows(rules.platform_requests, spark, data, monkeypatch), "platform").values():
        sent, until, hits = [], -1.0, 0
        for r in rows:
            recent = [t for t in sent if t > r["second"] - 60]
            if r["second"] < until:
                want[r["id"]] = "cooldown"
            elif len(recent) >= 20:
                want[r["id"]] = "over_budget"
            else:
                want[r["id"]] = "sent"
                sent.append(r["second"])
                hits = hits + 1 if r["limited"] else 0
                if hits >= 3:
                    until = r["second"] + max(60, r["retry_after"])
    got = {r.id: r.verdict for r in registry.QUERIES["st3_limiter_cooldown"](spark, data).collect()}
    assert got == want and len(set(want.values())) >= 2


def test_folds_continue_over_batches():
    rows = [{"id": i, "second": 10.0 * i, "action": "move", "arg": a, "pct": 0.0} for i, a in enumerate(("running", "failed", "running", "dead_lettered", "requeued", "queued"))]
    whole, _ = folds.task_fold(rows, folds.TASK_START)
    first, state = folds.task_fold(rows[:3], folds.TASK_START)
    second, _ = folds.task_fold(rows[3:], state)
    assert whole == first + second and [r[1] for r in whole] == [True, True, False, True, True, True]
