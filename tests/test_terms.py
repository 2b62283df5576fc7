"""The term engine and the rules on it against nested loops."""

import random
import re

import pytest
from answerscope.operators import claims, terms
from pyspark.sql import functions as F


def random_terms(rng, letters, n, most):
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)))


def finds(text, term):
    out, at = [], text.find(term)
    while at >= 0:
        out.append(at)
        at = text.find(term, at + len(term))
    return out


@pytest.mark.parametrize("most_bytes", [1 << 22, 4000])
def test_thousands_of_terms_equal_loops(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(terms, "MOST_BYTES", most_bytes)
    rng = random.Random(1)
    words = random_terms(rng, "abc汉 é", 3000, 6)
    texts = ["".join(rng.choice("abc汉 éx") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [None, "", "aaaa"]
    table = spark.createDataFrame([(f"g{len(w) % 3}", w) for w in words] + [("again", words[0]), ("none", "")], "group string, term string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("term", F.lit("mine"))
    got = {r.id: [(h["group"], h.term, h.at) for h in r.hits] for r in terms.with_hits(df, "text", table).collect()}
    for i, text in enumerate(texts):
        want = [(g, w, at) for w in words for at in finds(text or "", w) for g in [f"g{len(w) % 3}"] + ["again"] * (w == words[0])]
        assert sorted(got[i]) == sorted(want)
        assert [h[2] for h in got[i]] == sorted(h[2] for h in got[i])


def swap_loop(text, swaps, mode):
    """Term by term over a list of letters, outside of the skipped regions."""
    regions = [m.span() for p in terms.SKIPPED for m in re.finditer(p, text)]
    letters = list(text)
    for term, new in swaps.items():
        first = True
        for at in finds(text, term):
            if any(a <= at < b for a, b in regions):
                continue
            letters[at : at + len(term)] = [f"{new}（原称 {term}）" if mode == "explain_first" and first else new] + [""] * (len(term) - 1)
            first = False
    return "".join(letters)


def test_replacement_skips_code_and_urls(spark):
    rng = random.Random(2)
    pieces = [*terms.CUSTOMER_TERMS, "https://x.com/KPI?a=GT", "`LLM code`", "```\nKPI\n```", '"quoted SOV"', "/path/GT.py", " KPI ", "KPIs", "GTLLM", "。", "\n", "plain"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for mode in ("strict", "explain_first"):
        got = {r.id: r.replaced for r in terms.replaced(df, "text", mode=mode).collect()}
        assert got == {i: t if t is None else swap_loop(t, terms.CUSTOMER_TERMS, mode) for i, t in enumerate(texts)}


def test_forbidden_and_longest(spark):
    df = spark.createDataFrame([(1, "我们保证100%有效，绝对保证"), (2, "一般"), (3, None)], "id long, text string")
    assert {r.id: r.forbidden for r in terms.forbidden(df, "text").collect()} == {1: ["保证", "绝对", "100%"], 2: [], 3: []}
    table = terms.table_of(spark, {"x": ("受欢迎", "最受欢迎", "欢")})
    both = spark.createDataFrame([("最受欢迎，欢",)], "text string")
    assert [(h.term, h.at) for h in terms.with_hits(both, "text", table).select(terms.longest(F.col("hits")).alias("h")).first().h] == [("最受欢迎", 0), ("欢", 5)]


def test_compliance_reaches_every_branch(spark):
    schema = "id long, target_type string, body_markdown string, markdown string, infobox map<string,string>, sections array<struct<title: string, content: string>>, n_references int"
    rows = [
        (1, "web", "普通内容", None, None, None, 0),
        (2, "web", "", "限时优惠，折扣", None, None, None),
        (3, "web", None, None, {"a": "行业第一", "b": None}, None, 0),
        (4, "web", "内容", None, None, [("标题", "治愈"), (None, "稳赚")], 0),
        (5, "baike", "内容", None, None, None, 0),
        (6, "baike", "内容", None, None, None, 2),
        (7, "web", "100%有效", None, None, None, 0),
    ]
    got = {r.id: ([(f.type, f.text, f.severity) for f in r.flags], r.status, r.passed, r.high_count) for r in terms.compliance(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ([], "passed", True, 0),
        2: ([("ad_tone", "限时优惠", "medium"), ("ad_tone", "折扣", "medium")], "needs_review", False, 0),
        3: ([("absolute_claim", "第一", "high")], "blocked", False, 1),
        4: ([("sensitive_medical", "治愈", "high"), ("sensitive_financial", "稳赚", "high")], "blocked", False, 2),
        5: ([("reference_required", "百科类内容缺少参考资料", "high")], "blocked", False, 1),
        6: ([], "passed", True, 0),
        7: ([("sensitive_efficacy", "100%有效", "high")], "blocked", False, 1),
    }


def test_signals_equal_the_expression_form(spark):
    """The same words and places as the array expressions of the claim classifier."""
    rng = random.Random(3)
    words = ["最受欢迎", "受欢迎", "据报道", "可能会", "成立于", "预计", "我认为"]
    pieces = ["最受", "受欢", "欢迎", "据报", "报道", "可能会", "成立", "预计", "我认", "认为", "，", "ab"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(150)] + words
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = terms.signals(df, "text", {"cn": words}).withColumn("other", claims.found_words(F.col("text"), words, [])).collect()
    assert sum(len(r.signals) for r in got) > len(words)
    for r in got:
        assert sorted((s.word, s.at) for s in r.signals) == sorted((o.word, o.pos - 1) for o in r.other)
