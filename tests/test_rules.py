"""Rules that SQL does not express, on small fixtures with known outcomes."""

import pandas as pd
import pytest
from answerscope.operators import claims, kpi, trends
from answerscope.plans import operations  # noqa: F401  (registers the stream queries)
from answerscope.streaming import flows
from pyspark.sql import functions as F

NATURES = [
    ("星巴克成立于1971年，总部位于西雅图", "fact"),
    ("这是最好的咖啡品牌", "opinion"),
    ("它不是最好的", "unknown"),
    ("据传将裁员吗？", "speculation"),
    ("可能成为最好的品牌", "speculation"),
    ("预计营收增长50%", "speculation"),
    ("hi", "unknown"),
    ("Founded in 1999 and headquartered in Oslo", "fact"),
]


def test_claim_nature(spark):
    df = spark.createDataFrame(NATURES, "claim_text string, expected string")
    got = {r.claim_text: r.nature for r in claims.with_nature(df).collect()}
    assert got == dict(NATURES)


VERDICTS = [
    ("official_name", "星巴克公司是一家企业", "target_brand", "fact", "星巴克", "literal_substring_match", "supported", "P0"),
    ("industry", "公司属于互联网行业", "target_brand", "fact", "餐饮连锁", "contradicted:extra_tokens", "contradicted", "P0"),
    ("category", "最好的咖啡", "target_brand", "opinion", "咖啡", "opinion:subjective", "not_checkable", "Info"),
    ("positioning", "行业唯一领先", "target_brand", "opinion", "x", "opinion:absolute_claim", "not_checkable", "P2"),
    ("core_products", "全球第一", "target_brand", "fact", "咖啡与茶", "forbidden_claim", "contradicted", "P0"),
    ("core_products", "x", "generic", "fact", "咖啡", "not_checkable:generic", "generic_statement", "Info"),
    ("core_products", "x", "competitor", "fact", "咖啡", "not_checkable:competitor", "not_checkable", "Info"),
    ("core_products", "拿铁与茶", "target_brand", "fact", None, "gt_insufficient:field_missing", "gt_insufficient", "Info"),
    ("official_name", "新星巴克的大集团店", "target_brand", "fact", "星巴克集团", "near_miss_identity", "contradicted", "P0"),
    ("industry", "公司属于互联网行业", "target_brand", "speculation", "餐饮连锁", "contradicted:extra_tokens", "contradicted", "P2"),
    ("official_name", "完全另一家", "target_brand", "speculation", "星巴克集团", "contradicted:extra_tokens", "contradicted", "P0"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([r[:5] for r in VERDICTS], "field string, claim_text string, subject_type string, nature string, fact string").withColumn("i", F.monotonically_increasing_id())
    got = {(r.field, r.claim_text, r.subject_type, r.nature): (r.path, r.verdict, r.severity) for r in claims.verify(df).collect()}
    assert got == {r[:4]: r[5:] for r in VERDICTS}


def test_relevance(spark):
    said = [("Acme sells tea。Acme is old。", "brand_centric"), ("of all that we know today about tea, Acme", "brand_mentioned"), ("哪个平台好", "category_general"), ("hello", "irrelevant")]
    df = spark.createDataFrame(said, "t string, want string")
    got = df.select("want", claims.relevance(F.col("t"), F.array(F.lit("Acme"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_empty_answers_give_zeros(spark):
    df = spark.createDataFrame([("p", "q", "failed", None), ("p", "q", "success", "")], "platform string, question string, status string, answer_text string")
    r = kpi.counting(df, kpi.Brand("Acme"), ["platform"]).first()
    assert (r.n_valid, r.sov, r.sov_confidence, r.failure_rate) == (0, 0.0, "low", 1.0)


def test_kpis_stay_in_range_and_ignore_order(spark):
    rows = [("p", "q", "success", f"Acme {i}" if i % 3 else "none") for i in range(30)]
    df = spark.createDataFrame(rows, "platform string, question string, status string, answer_text string")
    one = kpi.counting(df.repartition(7), kpi.Brand("Acme"), ["platform"]).first()
    two = kpi.counting(df.orderBy(F.desc("answer_text")).coalesce(1), kpi.Brand("Acme"), ["platform"]).first()
    assert one == two and one.sov == round(20 / 30, 4) and one.sov_confidence == "high"


@pytest.mark.parametrize(("values", "n"), [([0.8, 0.8, 0.8, 0.8, 0.8, 0.1], 1), ([0.5] * 6, 0), ([0.8, 0.1], 0)])
def test_cliff_drops(spark, values, n):
    df = spark.createDataFrame([("e", "k", float(v), i) for i, v in enumerate(values)], "entity string, kpi string, value double, seq int")
    assert trends.cliff_drops(df).count() == n


def test_breaker_opens_probes_and_closes():
    rows = pd.DataFrame({"event_id": range(9), "second": [0, 1, 2, 3, 4, 5, 310, 311, 312], "failed": [True] * 6 + [False, True, False]})
    out, state = flows.breaker(rows, ("closed", 0, 0.0))
    assert [s for _, s, _ in out] == ["closed"] * 4 + ["open"] * 2 + ["closed"] * 3
    assert [b for *_, b in out] == [False] * 5 + [True] + [False] * 3
    assert state == ("closed", 0, 4.0)


def test_breaker_stream_equals_loop(spark, data):
    from answerscope.plans.registry import QUERIES

    events = spark.read.parquet(f"{data}/events.parquet").toPandas()
    want = {}
    for _, g in events.sort_values("event_id").groupby("user_id"):
        rows = pd.DataFrame({"event_id": g.event_id, "second": g.ts.astype("int64") / 1e9 if str(g.ts.dtype) == "datetime64[ns]" else g.ts.astype("datetime64[us]").astype("int64") / 1e6, "failed": g.event_type == "error"})
        want |= {i: (s, b) for i, s, b in flows.breaker(rows, ("closed", 0, 0.0))[0]}
    got = {r.event_id: (r.state, r.blocked) for r in QUERIES["st4_circuit_breaker"](spark, data).collect()}
    assert got == want


def test_confounders_judge_every_order(spark, tmp_path):
    import datetime

    from answerscope.plans import registry, series  # noqa: F401

    start = datetime.datetime(2024, 1, 1)
    orders = [(k, k % 170) for k in (1, 2, 2999, 3000, 3001, 50_000, 600_001, 600_002)]
    events = [(u, start + datetime.timedelta(hours=u % 7 + h), "abc"[(u + h // 62) % 3]) for u in range(150) for h in range(0, 700, 31)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for k, c in orders:
        lo = start + datetime.timedelta(days=k % 25)
        if seen := {t for u, ts, t in events if u == c % 150 and lo <= ts < lo + datetime.timedelta(days=2)}:
            want[k] = len(seen) > 1
    got = registry.QUERIES["r12_confounders"](spark, str(tmp_path)).collect()
    assert {r.o_orderkey: r.prompt_changed for r in got} == want and len(got) == len(want) and max(want) > 3000


def test_cross_validation_meets_every_source(spark, tmp_path):
    from answerscope.plans import facts, registry  # noqa: F401

    parts = [(1, "b1", "red ring", 1), (2, "b1", "red bolt", 2), (3, "b1", "red bolt", 3), (4, "b1", "old gear", 3), (5, "b2", "hot plate", 0), (7, "b3", "hot plate", 2), (8, "b3", "cold plate", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for i, brand, name, _ in parts:
        hit = ["SABC"[size % 4] for _, b, found, size in parts if b == brand and len(set(name.split()) & set(found.split())) >= 1]
        s, a, b = ("S" in hit), hit.count("A"), hit.count("B")
        status = "confirmed_strong" if s else ("confirmed_multi" if a + b >= 2 else "confirmed_strong") if a else "confirmed_multi" if b >= 2 else "confirmed_single" if b else "weak_support"
        want[i] = (len(hit), "A" if s else "B" if a + b else "C", status)
    got = {r.id: (r.n_matches, r.tier, r.status) for r in registry.QUERIES["j15_m9_cross_validation"](spark, str(tmp_path)).collect()}
    assert got == want and want[1][0] == 3


def test_contradicting_sources_are_counted_by_tier(spark):
    from answerscope.operators import evidence

    claims = [(1, "k", "founded_year", "1971"), (2, "k", "founded_year", "1985"), (3, "none", "founded_year", "1971"), (4, None, "founded_year", "1971"), (5, "k", "founded_year", None)]
    sources = [("k", "founded_year", "founded in 1971", "A"), ("k", "founded_year", "founded in 1971", "B"), ("k", "founded_year", "founded in 1985", "C"), ("k", "founded_year", None, "S")]
    got = evidence.cross_validate(spark.createDataFrame(claims, "id long, key string, field string, value string"), spark.createDataFrame(sources, "key string, field string, value string, tier string")).collect()
    assert {r.id: (r.n_matches, r.n_contradictions, r.tier, r.status) for r in got} == {
        1: (2, 1, "B", "confirmed_multi"), 2: (1, 2, "D", "contradicted"), 3: (0, 0, "C", "unverified"), 4: (0, 0, "C", "unverified"), 5: (0, 0, "C", "unverified"),
    }


def test_json_lines_fanout_and_queries_take_whole_tables(spark, data):
    from answerscope.plans import facts, lifecycle, registry, relational  # noqa: F401

    n = {t: spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("part", "nation", "region")}
    got = {q: registry.QUERIES[q](spark, data).count() for q in ("s7_json_lines", "j12_job_fanout", "c21_queries")}
    assert got == {"s7_json_lines": n["part"], "j12_job_fanout": 3 * n["nation"] * n["region"], "c21_queries": 3 * n["nation"]}


def test_attribution_waits_for_late_values(spark):
    """The first values after the lag count however late they come; those long before don't; ties and other entities."""
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    published = spark.createDataFrame([(1, "a", day(20), False, 0.1), (2, "a", day(5), True, 0.1), (3, "b", day(20), False, 0.1), (4, "c", day(20), False, 0.1)], "id long, entity string, at timestamp_ntz, confounded boolean, threshold double")
    values = [("a", 1, 0.9), ("a", 2, 0.1), ("a", 10, 0.2), ("a", 12, 0.4), ("a", 20, 9.0), ("a", 26, 9.0), ("a", 110, 0.8), ("a", 110, 0.6), ("a", 200, 5.0), ("b", 1, 0.1), ("b", 2, 0.1), ("b", 30, 0.1), ("b", 31, 0.1), ("c", 15, 0.5)]
    series = spark.createDataFrame([(e, day(n), v) for e, n, v in values], "entity string, ts timestamp_ntz, value double")
    got = {r.id: (r.pre_avg, r.post_avg, r.change, r.label) for r in trends.attribution(published, series).collect()}
    assert got == {1: (0.3, 0.7, 0.4, "possible_action_effect"), 2: (0.5, 4.7, 4.2, "confounded")}


def test_numbered_equals_row_number(spark):
    import random

    from answerscope.operators.ranking import numbered

    random.seed(3)
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), random.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = numbered(df, ["k"], [F.col("v").desc_nulls_last(), F.col("i")]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: (j + 1, len(own)) for j, r in enumerate(own)}
    assert {r.i: (r.place, r.size) for r in got} == want
    assert numbered(df.limit(0), ["k"], [F.col("i")]).count() == 0
