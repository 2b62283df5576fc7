"""Claims in answers: relevance, extraction, nature, and verification against facts.

All of it is column expressions; the one pandas function is the character
similarity of near-miss names, which runs only on rows that need it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import lexicon as X
from answerscope.operators.kpi import FIELD_LEVELS
from answerscope.sources.scratch import written

FOUND = "array<struct<word:string,pos:int>>"


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


# --- relevance ---------------------------------------------------------------


def short_name(name: Column) -> Column:
    return F.trim(F.split(name, "[（(]").getItem(0))


def variants(name: Column, official: Column) -> Column:
    return F.filter(F.array_distinct(F.array(name, official, short_name(name), short_name(official))), lambda v: F.coalesce(v, F.lit("")) != "")


def relevance(answer: Column, names: Column, industry_words: Sequence[str] = X.INDUSTRY_WORDS, separators: str = "[。\n]+") -> Column:
    """brand_centric, brand_mentioned, category_general or irrelevant.

    A sentence has the brand for its subject if a name starts in its first third and first 20 characters.
    """
    every = F.split(answer, separators, -1)
    parts = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")
    subject = F.size(F.filter(parts, lambda x: F.exists(names, lambda v: F.contains(x, v) & (F.instr(x, v) - 1 < F.least(F.length(x) / 3, F.lit(20))))))
    said = F.exists(names, lambda v: F.contains(answer, v))
    return F.when(subject >= 1, "brand_centric").when(said & (F.size(every) <= 5), "brand_mentioned").when(T.any_contains(answer, industry_words), "category_general").otherwise("irrelevant")


def subject_type(text: Column, names: Column, competitors: Column) -> Column:
    return F.when(F.exists(names, lambda v: F.contains(text, v)), "target_brand").when(F.exists(competitors, lambda v: F.contains(text, v)), "competitor").otherwise("generic")


# --- extraction --------------------------------------------------------------


def extract(answers: DataFrame, signals: Mapping[str, Sequence[str]] = X.FIELD_SIGNALS, separators: str = "[。\n]+", least: int = 10) -> DataFrame:
    """A row per answer, sentence and field: the fragment around the first listed signal that occurs."""
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(w) for w in words]).alias("words")) for f, words in signals.items()])
    said = answers.withColumn("sentence", F.explode(F.transform(F.split("answer_text", separators), lambda x: F.trim(x)))).where(F.length("sentence") >= least)
    low = F.lower("sentence")
    hits = F.transform(table, lambda s: F.struct(s["field"].alias("field"), F.filter(s["words"], lambda w: F.contains(low, w)).alias("hits")))
    rows = said.withColumn("hit", F.explode(F.filter(hits, lambda h: F.size(h["hits"]) > 0)))
    word, at = F.col("hit.hits")[0], F.instr(low, F.col("hit.hits")[0])
    start = F.greatest(F.lit(1), at - 20)
    fragment = F.trim(F.substr("sentence", start, at + F.length(word) + 40 - start))
    return rows.select(*answers.columns, "sentence", F.col("hit.field").alias("field"), F.left(fragment, F.lit(150)).alias("claim_text"), F.round(0.6 + 0.1 * F.size("hit.hits"), 2).alias("confidence"))


# --- nature ------------------------------------------------------------------


def grams(word: str) -> list[str]:
    return [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)] if len(word) >= 3 else []


def found_words(text: Column, plain: Sequence[str], english: Sequence[str]) -> Column:
    """Words of the lists that occur, or of which three fifths of the n-grams do; none that is part of another."""
    rows = [(w, grams(w), False) for w in plain] + [(w, grams(w) if " " not in w else [], True) for w in english]
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.array(*[F.lit(g) for g in gs]).cast("array<string>").alias("grams"), F.lit(en).alias("en")) for w, gs, en in rows])
    low = F.lower(text)

    def match(m: Column) -> Column:
        t = F.when(m["en"], low).otherwise(text)
        at = F.instr(t, m["word"])
        near = F.filter(m["grams"], lambda g: F.contains(t, g))
        fuzzy = F.size(near) / F.greatest(F.size(m["grams"]), F.lit(1)) >= 0.6
        return F.struct(m["word"].alias("word"), F.when(at > 0, at).when(fuzzy, F.instr(t, F.get(near, 0))).otherwise(0).cast("int").alias("pos"))

    hits = F.filter(F.transform(table, match), lambda m: m["pos"] > 0)
    return F.get(F.transform(F.array(hits), lambda h: F.filter(h, lambda m: ~F.exists(h, lambda o: (o["word"] != m["word"]) & F.contains(o["word"], m["word"])))), 0)


def negated(text: Column, m: Column) -> Column:
    start = F.greatest(F.lit(1), m["pos"] - 5)
    window = F.substr(text, start, m["pos"] + F.length(m["word"]) + 5 - start)
    return T.any_contains(window, X.NEGATIONS) | T.any_contains(F.lower(window), X.NEGATIONS_EN)


def with_nature(claims: DataFrame, text: str = "claim_text", words: Mapping = X.NATURE_WORDS) -> DataFrame:
    """``claims`` with nature (fact, opinion, speculation, unknown), its confidence, strength, and whether a word is negated."""
    t = F.trim(F.col(text))
    df = claims
    for nature, lists in words.items():
        df = df.withColumn(f"_{nature}_strong", found_words(t, lists["strong"], lists["strong_en"])).withColumn(f"_{nature}_weak_all", found_words(t, lists["weak"], lists["weak_en"]))
        strong = F.col(f"_{nature}_strong")
        df = df.withColumn(f"_{nature}_weak", F.filter(f"_{nature}_weak_all", inside_none(strong)))
    live = lambda c: F.size(F.filter(c, lambda m: ~negated(t, m)))
    score = {n: 2 * live(F.col(f"_{n}_strong")) + live(F.col(f"_{n}_weak")) for n in words}
    score["fact"] = score["fact"] + t.rlike(X.NUMERIC).cast("int") + t.rlike(X.STRUCTURAL).cast("int")
    any_signal = sum((s for s in score.values()), F.lit(0)) > 0
    asking = F.regexp_replace(t, "[?？!！。.）)]+$", "").rlike(f"({'|'.join(X.PARTICLES)})$") & (F.length(t) > 5)
    df = df.withColumn("_fact", score["fact"]).withColumn("_opinion", score["opinion"]).withColumn("_speculation", score["speculation"] + asking.cast("int"))
    f, o, s = F.col("_fact"), F.col("_opinion"), F.col("_speculation")
    # speculation wins ties with opinion, and beats fact from half its score on; order of the rest: fact, opinion, speculation
    spec = ((s > 0) & (s == o) & (s >= f)) | ((s > 0) & (f > 0) & (s >= f)) | ((s > 0) & (f >= o) & (f >= s) & (s >= f * 0.5))
    first = F.when(spec | ((s > f) & (s > o)), "speculation").when(f >= o, "fact").otherwise("opinion")
    natural_first = F.when((f >= o) & (f >= s), "fact").when(o >= s, "opinion").otherwise("speculation")
    top = F.when(first == "speculation", s).when(first == "fact", f).otherwise(o)
    second = F.when(first == "speculation", F.greatest(f, o)).when(first == "fact", F.greatest(s, o)).otherwise(F.greatest(f, s))
    overridden = (first == "speculation") & (natural_first != "speculation")
    clash = ~overridden & (second > 0) & (top / F.greatest(second, F.lit(1)) < 1.3)
    unknown = (F.length(t) < 5) | ~(any_signal | (s > 0)) | (top == 0) | clash
    confidence = F.when(unknown, 0.0).when(second == 0, F.when(top >= 3, 0.85).otherwise(0.65)).otherwise(F.round(T.clamp(top / (top + second) * 0.9, 0.55, 0.95), 2))
    n_strong = sum((F.size(f"_{n}_strong") for n in words), F.lit(0))
    n_weak = sum((F.size(f"_{n}_weak") for n in words), F.lit(0)) + asking.cast("int")
    strength = F.when(unknown, "none").when((n_strong > 0) & (n_weak > 0), "mixed").when(n_strong > 0, "strong").when(n_weak > 0, "weak").otherwise("none")
    any_negated = sum((F.size(F.filter(f"_{n}_{k}", lambda m: negated(t, m))) for n in words for k in ("strong", "weak")), F.lit(0)) > 0
    out = [F.when(unknown, "unknown").otherwise(first).alias("nature"), confidence.alias("nature_confidence"), strength.alias("signal_strength"), (any_negated & ~unknown).alias("negated"), (F.size("_speculation_strong") > 0).alias("hedged"), F.transform("_opinion_strong", lambda m: m["word"]).alias("opinion_words")]
    return df.select(*claims.columns, *out)


def inside_none(strong: Column):
    """Keeps words that are no part of a word in ``strong``."""
    return lambda m: ~F.exists(strong, lambda o: (o["word"] != m["word"]) & F.contains(o["word"], m["word"]))


def speculation_risk(predicate: Column, hedged: Column) -> Column:
    return F.when(predicate.isin(*X.HIGH_RISK_PREDICATES), "high").when(predicate.isin(*X.LOW_RISK_PREDICATES), "low").when(hedged, "medium").otherwise("low")


def review_flag(df: DataFrame, text: str = "claim_text") -> DataFrame:
    """``df`` (with nature columns, predicate and industry) with industry_risk and needs_review."""
    key = lookup(F.col("industry"), X.RISK_INDUSTRIES, "")
    risk = F.lit(False)
    for name, terms in X.RISK_TERMS.items():
        risk = risk | ((key == name) & T.any_contains(F.col(text), terms))
    risk = risk & ~F.col("nature").isin("fact", "unknown")
    level = F.when(F.col("nature") == "speculation", speculation_risk(F.col("predicate"), F.col("hedged"))).otherwise("")
    absolute = F.arrays_overlap("opinion_words", F.array(*[F.lit(w) for w in X.ABSOLUTE_OPINIONS]))
    review = (F.col("nature") == "unknown") | (F.col("nature_confidence") < 0.6) | (level == "high") | (risk & ((F.col("nature") == "speculation") | ((F.col("nature") == "opinion") & absolute)))
    return df.withColumn("speculation_risk", level).withColumn("industry_risk", risk).withColumn("needs_review", review)


# --- verification ------------------------------------------------------------


def char_ratio(a: Column, b: Column) -> Column:
    """Similarity of two short strings by matching blocks, in [0, 1]."""

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda s, t: SequenceMatcher(None, s or "", t or "").ratio())

    return ratio(a, b)


def verify(claims: DataFrame, forbidden: Sequence[str] = X.OVERCLAIMS) -> DataFrame:
    """``claims`` (field, claim_text, subject_type, nature, fact) with verdict, severity, error_type and path.

    ``fact`` is the text of the fact record's field, null or empty if it has none.
    """
    field, claim, fact, kind = F.col("field"), F.col("claim_text"), F.coalesce("fact", F.lit("")), F.col("subject_type")
    df = claims.withColumn("_ct", T.ngram_tokens(claim)).withColumn("_gt", T.ngram_tokens(fact))
    df = df.withColumn("_cc", T.overlap(F.col("_ct"), F.col("_gt"))).withColumn("_gc", T.overlap(F.col("_gt"), F.col("_ct"))).withColumn("_extra", F.array_except("_ct", "_gt"))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-zA-Z0-9一-鿿]", "")
    x, y = bare(claim), bare(fact)
    checkable, opinion = kind.isin("target_brand"), F.col("nature") == "opinion"
    literal = (F.length(fact) >= 2) & (F.contains(F.lower(claim), F.lower(fact)) | F.contains(F.lower(fact), F.lower(claim)))
    enough = (F.col("_gc") >= 0.3) & (F.col("_cc") >= 0.2)
    close = field.isin("official_name", "industry", "category") & enough & ~F.contains(x, y) & ~F.contains(y, x) & (F.greatest(F.length(x), F.length(y)) <= 50) & checkable & ~opinion & ~literal & (fact != "")
    # only rows that come this far are sent to Python
    near = df.where(close).withColumn("_similar", char_ratio(x, y))
    df = near.unionByName(df.where(~F.coalesce(close, F.lit(False))).withColumn("_similar", F.lit(1.0)))
    level = lookup(field, FIELD_LEVELS, "P1")
    absolute = T.any_contains(claim, X.ABSOLUTES)
    tokens = (F.size("_ct") > 0) & (F.size("_gt") > 0)
    hits = F.exists("_extra", lambda t: t.isin(*forbidden))
    contradicted = (F.size("_extra") > 0) & (F.col("_gc") < 0.15)
    path = (
        F.when(kind == "generic", "not_checkable:generic").when(kind == "competitor", "not_checkable:competitor").when(~checkable, "not_checkable:unknown_subject")
        .when(opinion & absolute, "opinion:absolute_claim").when(opinion, "opinion:subjective").when(fact == "", "gt_insufficient:field_missing").when(literal, "literal_substring_match")
        .when(~tokens, "ambiguous:no_tokens").when(F.col("_similar") < 0.85, "near_miss_identity").when(enough, "token_match").when(hits, "forbidden_claim")
        .when(contradicted, "contradicted:extra_tokens").when(F.col("_cc") > 0, "unsupported:partial_match").otherwise("ambiguous:no_overlap")
    )
    df = df.withColumn("path", path)
    p = F.col("path")
    verdict = (
        F.when(p == "not_checkable:generic", "generic_statement").when(p.startswith("not_checkable") | p.startswith("opinion"), "not_checkable").when(p.startswith("gt_insufficient"), "gt_insufficient")
        .when(p.isin("literal_substring_match", "token_match"), "supported").when(p.startswith("ambiguous"), "ambiguous").when(p.isin("near_miss_identity", "forbidden_claim", "contradicted:extra_tokens"), "contradicted").otherwise("unsupported")
    )
    risky = field.isin("official_name", "industry", "category", "core_products", "core_features")
    severity = F.when(p == "opinion:absolute_claim", F.when(risky, "P1").otherwise("P2")).when(p.isin("near_miss_identity", "forbidden_claim"), "P0").when(verdict.isin("supported", "contradicted", "unsupported"), level).otherwise("Info")
    kind_of = F.when(p == "opinion:absolute_claim", "opinion_absolute_claim").when(p == "opinion:subjective", "opinion_claim").when(p == "near_miss_identity", F.when(field == "official_name", "identity_error").otherwise("category_error")).when(p == "forbidden_claim", "overclaim")
    error = kind_of.when(p == "contradicted:extra_tokens", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in X.ERROR_TYPES.items() for v in kv]), field), F.when(T.any_contains(claim, X.OVERCLAIMS), "overclaim").otherwise("unsupported_claim")))
    review = p.isin("opinion:absolute_claim", "near_miss_identity", "forbidden_claim") | ((p == "contradicted:extra_tokens") & ((level == "P0") | field.isin("official_name", "category", "positioning")))
    similarity = F.when(p == "literal_substring_match", 1.0).when(fact != "", F.round((F.col("_cc") + F.col("_gc")) / 2, 3))
    out = df.select(*claims.columns, "path", verdict.alias("verdict"), severity.alias("severity"), error.alias("error_type"), review.alias("needs_review"), similarity.alias("similarity"))
    return adjust_speculation(out)


def detect(answers: DataFrame, facts: DataFrame, signals: Mapping[str, Sequence[str]] = X.FIELD_SIGNALS, industry_words: Sequence[str] = X.INDUSTRY_WORDS, separators: str = "[。\n]+") -> DataFrame:
    """Claims of ``answers`` with every judgement: relevance, extraction, subject, nature, verdict, severity and review.

    ``answers``: answer_id, brand, answer_text, names and competitors (arrays), industry. ``facts``: brand, field, fact.
    Answers that are irrelevant to the brand or general about its category yield no claims; facts are joined by brand
    and field, so that a claim on a field without fact is insufficient, not wrong.
    """
    judged = answers.withColumn("relevance", relevance(F.col("answer_text"), F.col("names"), industry_words, separators)).where(F.col("relevance").isin("brand_centric", "brand_mentioned"))
    claims = extract(judged, signals, separators)
    claims = claims.withColumn("subject_type", subject_type(F.col("claim_text"), F.col("names"), F.col("competitors"))).withColumn("predicate", lookup(F.col("field"), X.PREDICATES, "other"))
    # written between the stages: each stage's expressions use the columns of the one before many times
    claims = written(claims, "claims-found")
    marked = review_flag(written(with_nature(claims), "claims-nature")).withColumnRenamed("needs_review", "nature_review")
    kept = ["answer_id", "brand", "relevance", "field", "claim_text", "confidence", "subject_type", "nature", "nature_confidence", "speculation_risk", "industry_risk", "nature_review"]
    verified = verify(written(marked.select(*kept), "claims-marked").join(facts.select("brand", "field", "fact"), ["brand", "field"], "left"))
    return verified.withColumn("needs_review", F.col("needs_review") | F.col("nature_review")).drop("nature_review")


def adjust_speculation(df: DataFrame) -> DataFrame:
    """Severity of speculative claims: kept or raised for risky predicates, lowered for others."""
    spec, risky = F.col("nature") == "speculation", lookup(F.col("field"), X.PREDICATES, "other").isin(*X.HIGH_RISK_PREDICATES)
    wrong, unsure = F.col("verdict") == "contradicted", F.col("verdict") == "unsupported"
    severity = F.when(spec & risky & (wrong | unsure), F.when(F.col("severity") == "P0", "P0").otherwise("P1")).when(spec & ~risky & wrong, "P2").when(spec & ~risky & unsure & (F.col("severity") == "P0"), "P1").otherwise(F.col("severity"))
    error = F.when(spec & risky & (wrong | unsure), F.concat(F.lit("high_risk_speculation_"), lookup(F.col("field"), X.PREDICATES, "other"))).when(spec & ~risky & wrong, "low_risk_speculation").otherwise(F.col("error_type"))
    review = F.col("needs_review") | (spec & risky & (wrong | unsure))
    return df.withColumns({"severity": severity, "error_type": error, "needs_review": review})
