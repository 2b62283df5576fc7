"""Competitor matrix, gaps to rivals and KPI cards on small tables with known outcomes."""

import datetime

import pytest
from answerscope.operators import rivals as V
from pyspark.sql import functions as F

SNAPSHOTS = "entity string, ts timestamp_ntz, sov double, citation_rate double, sample_size int, platform string, dimension string"
SETS = "brand string, competitors array<string>, active boolean, updated_at int"
AS_OF = "timestamp_ntz '2024-03-31'"


def day(text):
    return datetime.datetime.fromisoformat(text)


def snapshot(entity, ts, sov, citation=None, platform=None, dimension=None):
    return (entity, day(ts), sov, citation, 9, platform, dimension)


def test_matrix(spark):
    rows = [
        snapshot("a", "2024-03-01", 0.1), snapshot("a", "2024-03-08", 0.2, 0.5), snapshot("a", "2024-03-15", 0.9, platform="p"), snapshot("a", "2024-03-15", 0.9, dimension="city"),
        snapshot("b", "2024-03-02", 0.4), snapshot("b", "2024-03-02", 0.3), snapshot("c", "2024-03-02", 0.6, platform="p"), snapshot(None, "2024-03-02", 0.6),
    ]
    sets = [("a", ["c"], True, 1), ("a", ["b", "b", "a", "c", None], True, 2), ("a", ["d"], False, 3), ("b", ["a"], False, 1), (None, ["a"], True, 1), ("c", None, True, 1)]
    got = V.competitor_matrix(spark.createDataFrame(rows, SNAPSHOTS), spark.createDataFrame(sets, SETS), ["sov", "citation_rate"]).collect()
    assert sorted((g.brand, g.member, g.is_own, g.sov, g.citation_rate) for g in got) == [("a", "a", True, 0.2, 0.5), ("a", "b", False, 0.4, None)]


def attributed(spark, rows, sets, bench):
    compared = V.compare(spark.createDataFrame(rows, SNAPSHOTS), spark.createDataFrame(sets, SETS), ["sov", "citation_rate"], F.expr(AS_OF))
    return {(g.brand, g.kpi): g for g in V.gap_attribution(compared, spark.createDataFrame(bench, "kpi string, p50 double, quality string")).collect()}


def test_gaps(spark):
    others = [snapshot(f"r{i}", "2024-03-25", 0.5, 0.2) for i in range(5)]
    own = {"behind": 0.2, "ahead": 0.53, "even": 0.505, "few": 0.5, "alone": 0.9, "old": 0.1}
    rows = others + [snapshot("late", "2024-03-16", 0.0)] + [snapshot(b, "2024-03-02" if b != "old" else "2024-02-29", v) for b, v in own.items()] + [snapshot("even", "2024-04-01", 0.9)]
    five = [f"r{i}" for i in range(5)]
    sets = [("behind", five, True, 1), ("ahead", five[:2], True, 1), ("even", five, True, 1), ("few", ["r0", "late", "nobody"], True, 1), ("old", five, True, 1), ("blank", [], True, 1)]
    got = attributed(spark, rows, sets, [("sov", 0.4, "medium")])
    view = {b: (round(g.gap, 6), g.significance, g.confidence, g.total_competitors, g.with_data, bool(g.counters)) for (b, k), g in got.items() if k == "sov" and b in {*own, "blank"}}
    assert view == {
        "behind": (-0.3, "large", "high", 5, 5, False), "ahead": (0.03, "none", "medium", 2, 2, True), "even": (0.005, "none", "high", 5, 5, False),
        "few": (0.0, "none", "low", 3, 1, False), "alone": (0.5, "large", "low", 0, 0, True), "old": (0.0, "none", "high", 5, 5, False), "blank": (0.0, "none", "low", 0, 0, False),
    }
    assert got["even", "sov"].finding == V.NO_GAP and len(got["even", "sov"].caveat.split("，")) == 4
    label = V.LABELS["sov"]
    assert got["behind", "sov"].drivers == [f"在「{label}」方面可能存在改进空间"] and "落后" in got["behind", "sov"].finding and got["behind", "sov"].caveat == "，".join((V.CAVEATS[0], V.CAVEATS[2]))
    assert got["ahead", "sov"].drivers == [f"建议关注「{label}」相关指标"] and got["ahead", "sov"].counters == [f"在「{label}」方面品牌表现较好"]
    # a KPI without an own value has no gap, one without a benchmark is not of high confidence
    assert (got["behind", "citation_rate"].gap, got["behind", "citation_rate"].confidence, got["alone", "citation_rate"].reason) == (0.0, "medium", "无竞品数据")


def test_gaps_of_empty_tables(spark):
    assert attributed(spark, [], [], []) == {}


def test_status_of_a_log(spark):
    log = [("a", "sov", 1, "2024-01-01"), ("a", "sov", 2, "2024-01-02"), ("a", "sov", 3, "2024-01-02"), ("a", "x", 4, "2024-01-01"), (None, "sov", 5, "2024-01-01"), (None, "sov", 6, "2023-01-01")]
    df = spark.createDataFrame([(*r[:3], day(r[3]), "active") for r in log], "brand string, kpi string, id int, generated_at timestamp_ntz, status string")
    got = {r.id: (r.status, r.stale_reason) for r in V.with_status(df).collect()}
    assert got == {i: ("active", None) if i in (3, 4, 5) else ("stale", "newer result available") for i in range(1, 7)}


@pytest.mark.parametrize("rows", [[("a", "sov", 0.5, 2, 4, 4, "high"), ("a", "sov", 0.4, 9, 9, 9, "high"), ("a", "odd", 1.0, 1, 1, 1, "high"), ("a", "differentiation", None, None, 3, 3, None), ("b", "odd", 1.0, 1, 1, 1, "high")], []])
def test_cards(spark, rows):
    df = spark.createDataFrame(rows, "brand string, kpi string, value double, numerator int, denominator int, sample_size int, confidence string")
    got = {r.brand: [tuple(c) for c in r.cards] for r in V.kpi_cards(df).collect()}
    zero = {b: [(k, n, 0.0, 0, 0, 0, "low") for k, n in V.LABELS.items()] for b in ({"a", "b"} if rows else ())}
    if rows:
        zero["a"][0] = ("sov", V.LABELS["sov"], 0.5, 2, 4, 4, "high")
        zero["a"][7] = ("differentiation", V.LABELS["differentiation"], 0.0, 0, 3, 3, "low")
    assert got == zero
