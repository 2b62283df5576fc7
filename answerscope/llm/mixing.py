"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed up to cells of source, language and topic. The cells'
token weights are raked: scaled in turn so that their sums meet the target of
each margin, until all margins hold. A cell's raked weight over its tokens is
the weight of its documents; a common rate turns weights into probabilities,
at most 1, such that the expected tokens are ``keep`` of all, and documents are
drawn by a hash of their id (Poisson sampling), so that a rerun draws the same.

Targets are shares by value. Without any, a margin's own shares are tempered
(raised to ``temper`` and normalised), which lowers a dominant source. The
cells are an aggregate; they are never collected, and each scaling is a join
with the margin's sums.

Defined results: null source or language is a value of its own; a null or
empty text has topic "empty" and no tokens, weight 1 and is drawn at the rate;
values without target keep their own share; repeated rows share their fate;
an empty table gives no rows; a very long text is one row, whose words are
counted in memory of some times its size; other columns are kept, except source-, cell-
and weight columns of the same name, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import SPACE, whole_text, written

MARGINS = ("source", "lang", "topic")
TEMPER, KEEP, ROUNDS, FILLS = {"source": 0.5, "lang": 0.7, "topic": 0.7}, 0.7, 6, 4
#: Topics by marks in the text, the first that holds; DuckDB and Spark read them alike.
TOPICS = (("tabular", r"\|"), ("licensed", r"[Ll]icense"), ("contact", r"@|\+[0-9]"), ("records", r"[0-9]{3}"), ("loud", r"!"))


def topic(text: Column) -> Column:
    out = F.when(text == "", "empty")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens(text: Column) -> Column:
    """Words between white space."""
    blank = lambda c: F.instr(F.lit(" \t\n\u000b\f\r"), c) > 0
    ends = blank(F.left(text, F.lit(1))).cast("int") + blank(F.right(text, F.lit(1))).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SPACE, -1)) - ends).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with n_tokens and topic, and ``source`` and ``lang`` without nulls as _source and _lang."""
    text = whole_text()
    null = F.lit("(none)")
    return docs.select("*", tokens(text).alias("n_tokens"), topic(text).alias("topic"), F.coalesce("source", null).alias("_source"), F.coalesce("lang", null).alias("_lang"))


def targets(cells: DataFrame, margin: str, shares: Mapping[str, float] | None, temper: float) -> DataFrame:
    """(value, target): tokens that the margin's values should have; they sum up to all tokens."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("n").alias("n"))
    if shares:
        wanted = F.create_map(*[F.lit(x) for kv in sorted(shares.items()) for x in kv])
        total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0.0
        raw = F.coalesce(F.element_at(wanted, F.col("value")) * total, F.col("n"))
    else:
        raw = F.pow("n", F.lit(temper))
    sized = written(sums.select("value", "n", raw.alias("raw")), "mixing-targets")
    scale = sized.agg(F.sum("n").alias("n"), F.sum("raw").alias("raw")).first()
    return sized.select("value", (F.col("raw") * ((scale["n"] or 0.0) / (scale["raw"] or 1.0))).alias("target"))


def rake(cells: DataFrame, wanted: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins, n) with the raked weight w."""
    now = cells.withColumn("w", F.col("n"))
    for _ in range(rounds):
        for margin in MARGINS:
            sums = now.groupBy(F.col(margin).alias("value")).agg(F.sum("w").alias("_sum")).join(wanted[margin], "value")
            factor = sums.select(F.col("value").alias(margin), (F.col("target") / F.col("_sum")).alias("_factor"))
            now = written(now.join(factor, margin).withColumn("w", F.col("w") * F.col("_factor")).drop("_factor"), "mixing-raked")
    return now


def rate(raked: DataFrame, keep: float, fills: int = FILLS) -> float:
    """The common rate at which the expected tokens are ``keep`` of all, though no probability exceeds 1."""
    found = keep
    for _ in range(fills):
        full = F.col("w") * found >= F.col("n")
        got = raked.agg(F.sum("n").alias("n"), F.sum(F.when(full, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("rest")).first()
        if not got["rest"]:
            break
        found = max(found, (keep * got["n"] - got["full"]) / got["rest"])
    return found


def weigh(docs: DataFrame, shares: Mapping[str, Mapping[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with n_tokens, topic, weight, probability and sampled.

    Texts are read for tokens and topic once; what is kept of the documents is written with these.
    """
    docs = docs.drop("n_tokens", "topic", "weight", "probability", "sampled", "_source", "_lang")
    wanted_columns = docs.columns if columns is None else list(columns)
    celled = written(with_cells(docs).select(*wanted_columns, "n_tokens", "topic", "_source", "_lang"), "mixing-documents")
    small = celled.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(F.sum("n_tokens").cast("double").alias("n"))
    cells = written(small.where("n > 0"), "mixing-cells")
    wanted = {m: targets(cells, m, (shares or {}).get(m), TEMPER[m]) for m in MARGINS}
    raked = rake(cells, wanted, rounds)
    share = rate(raked, keep)
    weights = raked.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", (F.col("w") / F.col("n")).alias("weight"))
    out = celled.join(weights, ["_source", "_lang", "topic"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * share))
    out = out.withColumn("sampled", uniform(F.col("doc_id")) < F.col("probability"))
    return out.select(*wanted_columns, "n_tokens", "topic", "weight", "probability", "sampled")
