"""Rules over many terms: one pass over each text finds all of them, however many there are.

A terms table (group, term, ...) becomes an Aho-Corasick automaton, which is sent
to the tasks only after its size was checked: ``MOST_BYTES`` of terms at a time;
a larger table is cut into parts of that size, and texts pass one after the
other through their automata. Hits carry the place, so that the rules on top
(replacing, forbidding, compliance, industries, fuzzy signals) need no further
search of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of terms in one automaton; it takes about a hundred times as much memory in a task.
MOST_BYTES = 4 << 20
HITS = "array<struct<group: string, term: string, at: int, skipped: boolean>>"

# Parts of a text in which no term is replaced (URLs, code, quoted strings, file paths).
SKIPPED = (r"https?://\S+", r"```[\s\S]*?```", r"`[^`]+`", r'"[^"]*?"', r"/[^\s]*?\.[a-z]{1,6}")
# Terms for customers, terms that no report may promise, and those that a publishing target forbids.
CUSTOMER_TERMS = {
    "SOV": "品牌被 AI 看见的程度", "Share of Voice": "AI 提到品牌的比例", "hallucination": "AI 错误信息", "semantic anchor": "AI 记住的品牌关键说法", "semantic stability": "AI 对品牌描述的一致性",
    "citation rate": "AI 引用官方来源的频率", "scenario recall": "AI 在真实场景中想到品牌的能力", "first recommendation rate": "AI 优先推荐品牌的比例", "accuracy rate": "AI 描述品牌的准确程度",
    "completeness rate": "AI 对品牌描述的完整程度", "cross-platform consistency": "不同 AI 平台对品牌说法的统一程度", "differentiation": "AI 是否区分品牌与竞品的差异", "recommendation quality": "AI 推荐品牌时的理由质量",
    "GT": "品牌事实库", "Ground Truth": "品牌事实库", "KPI": "观察指标", "LLM": "AI 平台",
}
FORBIDDEN = ("一定", "必然", "肯定", "保证", "所有用户都会", "永远", "绝对", "毫无疑问", "100%")
COMPLIANCE = {
    "absolute_claim": ("领先", "第一", "最大", "最好", "唯一", "最强", "顶级", "绝对", "独家", "首创"),
    "ad_tone": ("立即购买", "马上咨询", "限时优惠", "折扣", "免费试用", "火爆", "抢购", "不容错过"),
    "sensitive_medical": ("治愈", "治疗", "疗效", "康复", "根治"),
    "sensitive_financial": ("稳赚", "保本", "高收益", "无风险"),
    "sensitive_efficacy": ("保证有效", "100%有效", "绝对有效"),
}
SEVERITY = {"ad_tone": "medium"}  # all others are high
ENCYCLOPEDIAS = ("baidu_baike", "baike_card", "baike")

Terms = Mapping[str, Sequence[str]]


def table_of(spark: SparkSession, terms: Terms) -> DataFrame:
    """(group, term, place) of lists by group; ``place`` is the order given."""
    rows = [(g, t, i) for i, (g, t) in enumerate((g, t) for g, words in terms.items() for t in words)]
    return spark.createDataFrame(rows, "group string, term string, place int")


def parts(terms: DataFrame) -> Iterator[dict[str, list[str]]]:
    """The table's groups by term, in parts of MOST_BYTES; equal terms of several groups stay together.

    The running size is counted by Spark; only one part at a time comes to the driver."""
    held = terms.where("term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("group")).alias("groups"), F.sum(F.octet_length("term") + F.octet_length("group")).alias("size"))
    total = held.agg(F.sum("size")).first()[0] or 0
    n = -(-total // MOST_BYTES) or 1
    for i in range(n):
        yield {r.term: r.groups for r in held.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()}


def automaton(terms: dict[str, list[str]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, groups in terms.items():
        found.add_word(term, (term, groups))
    if terms:
        found.make_automaton()
    return found


def skipped(text: str) -> list[tuple[int, int]]:
    """The skipped regions, joined and in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(m.span() for p in SKIPPED for m in re.finditer(p, text)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def places(found: ahocorasick.Automaton, text: str) -> list[dict]:
    """Of each term the hits that don't overlap, from the left, by place; longer terms first."""
    if not len(found):
        return []
    last: dict[str, int] = {}
    out, regions, at = [], None, 0
    hits = sorted(((end - len(term) + 1, -len(term), term, groups) for end, (term, groups) in found.iter(text)), key=lambda h: h[:3])
    for start, _, term, groups in hits:
        if start < last.get(term, 0):
            continue
        last[term] = start + len(term)
        regions = skipped(text) if regions is None else regions
        while at < len(regions) and regions[at][1] <= start:
            at += 1
        inside = at < len(regions) and regions[at][0] <= start
        out += [{"group": g, "term": term, "at": start, "skipped": inside} for g in groups]
    return out


def searching(sent):
    """The automaton of the broadcast terms as a column function; each task builds it once."""

    @F.pandas_udf(HITS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = automaton(sent.value)
        for batch in batches:
            yield pd.Series([places(own, t) if t else [] for t in batch], dtype=object)

    return search


def with_hits(texts: DataFrame, column: str, terms: DataFrame, name: str = "hits") -> DataFrame:
    """``texts`` with an array of (group, term, at, skipped): the places, from 0, of every term in ``column``; of one term no two overlap.

    Null texts have no hits; case counts; all other columns stay."""
    spark, found = texts.sparkSession, None
    for part in parts(terms):
        hits = searching(spark.sparkContext.broadcast(part))(F.col(column))
        found = hits if found is None else F.array_sort(F.concat(found, hits), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(F.length(b["term"]) - F.length(a["term"])))
    return texts.withColumn(name, found)


def longest(hits: Column) -> Column:
    """Hits that lie in no longer hit."""
    end = lambda h: h["at"] + F.length(h["term"])
    return F.filter(hits, lambda m: ~F.exists(hits, lambda o: (F.length(o["term"]) > F.length(m["term"])) & (o["at"] <= m["at"]) & (end(o) >= end(m))))


def counts(hits: Column) -> Column:
    """(term, n, first) of each term hit."""
    return F.transform(F.array_distinct(F.transform(hits, lambda h: h["term"])), lambda t: F.struct(t.alias("term"), F.size(F.filter(hits, lambda h: h["term"] == t)).alias("n"), F.array_min(F.transform(F.filter(hits, lambda h: h["term"] == t), lambda h: h["at"])).alias("first")))


def replaced(texts: DataFrame, column: str, swaps: Mapping[str, str] = CUSTOMER_TERMS, mode: str = "strict", name: str = "replaced") -> DataFrame:
    """``column`` with each term outside of skipped regions swapped; in mode ``explain_first`` its first place names the old term.

    Where terms overlap, each keeps its own start, as in a replacement term by term: a longer one covers what lies within it,
    and of two that start together the later one of ``swaps`` stands."""
    spark = texts.sparkSession
    order = {t: i for i, t in enumerate(swaps)}
    found = with_hits(texts, column, table_of(spark, {"swap": tuple(swaps)}), "_hits")

    @F.pandas_udf("string")
    def swap(text: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, hs in zip(text, hits, strict=True):
            if t is None:
                out.append(None)
                continue
            letters, seen = list(t), set()
            for h in sorted((h for h in hs if not h["skipped"]), key=lambda h: (order[h["term"]], h["at"])):
                new = swaps[h["term"]]
                letters[h["at"] : h["at"] + len(h["term"])] = [f"{new}（原称 {h['term']}）" if mode == "explain_first" and h["term"] not in seen else new] + [""] * (len(h["term"]) - 1)
                seen.add(h["term"])
            out.append("".join(letters))
        return pd.Series(out, dtype=object)

    return found.withColumn(name, swap(F.col(column), F.col("_hits"))).drop("_hits")


def in_order(hits: Column, words: Sequence[str]) -> Column:
    """Which of the words are hit, in their own order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.exists(hits, lambda h: h["term"] == w))


def forbidden(texts: DataFrame, column: str, words: Sequence[str] = FORBIDDEN, name: str = "forbidden") -> DataFrame:
    """``texts`` with the forbidden terms of ``column``, in the list's order."""
    return with_hits(texts, column, table_of(texts.sparkSession, {"forbidden": tuple(words)}), "_hits").withColumn(name, in_order(F.col("_hits"), words)).drop("_hits")


def flags_of(kind: str, words: Sequence[str]) -> Column:
    """The flags of one kind, in the list's order."""
    own = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.exists("_hits", lambda h: (h["term"] == w) & (h["group"] == kind)))
    return F.transform(own, lambda w: F.struct(F.lit(kind).alias("type"), w.alias("text"), F.lit(SEVERITY.get(kind, "high")).alias("severity")))


def compliance(variants: DataFrame, rules: Terms = COMPLIANCE) -> DataFrame:
    """Variants (target_type, body_markdown, markdown, infobox map, sections array of (title, content), n_references) with flags, counts and status.

    A flag is (type, text, severity); high ones block, others ask for a review; encyclopedias need references."""
    columns = variants.columns
    empty = lambda c: F.coalesce(c, F.lit(""))
    body = F.when(empty(F.col("body_markdown")) != "", F.col("body_markdown")).otherwise(empty(F.col("markdown")))
    sections = F.transform(F.coalesce("sections", F.array().cast("array<struct<title: string, content: string>>")), lambda s: F.concat(empty(s["title"]), F.lit(" "), empty(s["content"])))
    boxes = F.coalesce(F.map_values("infobox"), F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(body), F.transform(boxes, empty), sections), " ")
    found = with_hits(variants.withColumn("_whole", whole), "_whole", table_of(variants.sparkSession, rules), "_hits")
    made = [flags_of(kind, words) for kind, words in rules.items()]
    missing = F.col("target_type").isin(*ENCYCLOPEDIAS) & (F.coalesce("n_references", F.lit(0)) == 0)
    needed = F.struct(F.lit("reference_required").alias("type"), F.lit("百科类内容缺少参考资料").alias("text"), F.lit("high").alias("severity"))
    made.append(F.when(missing, F.array(needed)).otherwise(F.array().cast("array<struct<type: string, text: string, severity: string>>")))
    flags = found.withColumn("flags", F.concat(*made)).withColumn("high_count", F.size(F.filter("flags", lambda f: f["severity"] == "high"))).withColumn("flags_count", F.size("flags"))
    status = F.when(F.col("high_count") > 0, "blocked").when(F.col("flags_count") > 0, "needs_review").otherwise("passed")
    return flags.select(*columns, "flags", "flags_count", "high_count", status.alias("status"), (F.col("flags_count") == 0).alias("passed"))


def grams(word: str) -> list[str]:
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)] if len(word) >= 3 else []


def signals(texts: DataFrame, column: str, words: Terms, fuzzy: float = 0.6, name: str = "signals") -> DataFrame:
    """``texts`` with (group, word, at): words of each list that occur, or of which the share ``fuzzy`` of two- and three-letter parts do.

    Words and their parts are one automaton; a word without its own place has that of its first part found; of one group,
    words that are part of another found word are left out."""
    spark = texts.sparkSession
    rows = [(g, w) for g, own in words.items() for w in own]
    found = with_hits(texts, column, table_of(spark, {"w": tuple(dict.fromkeys(x for _, w in rows for x in (w, *grams(w))))}), "_hits")
    parts_of = {w: grams(w) for _, w in rows}

    @F.pandas_udf("array<struct<group: string, word: string, at: int>>")
    def judge(hits: pd.Series) -> pd.Series:
        out = []
        for hs in hits:
            first: dict[str, int] = {}
            for h in hs:
                first.setdefault(h["term"], h["at"])
            met = []
            for g, w in rows:
                own = [p for p in parts_of[w] if p in first]
                if w in first:
                    met.append((g, w, first[w]))
                elif own and len(own) / len(parts_of[w]) >= fuzzy:
                    met.append((g, w, first[own[0]]))
            out.append([{"group": g, "word": w, "at": at} for g, w, at in met if not any(g == h and w != x and w in x for h, x, _ in met)])
        return pd.Series(out, dtype=object)

    return found.withColumn(name, judge(F.col("_hits"))).drop("_hits")
