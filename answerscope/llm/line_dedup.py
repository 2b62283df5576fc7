"""Removal of boilerplate lines that spread over many sites, in SQL functions only.

Every line of ``least_chars`` or more (spaces at its ends left out) is known by
a 64-bit hash. Occurrences are first combined by line and site, so that a line
of a third of all documents is no more rows than it has sites; then one
aggregation merges, per line, a HyperLogLog sketch of these sites. Lines that fewer
documents than ``sites`` hold can't spread that far and get no sketch.
Estimates well above or below the threshold decide by themselves; those within
``margin`` of it are counted exactly. The sketch's error at 2^12 registers is
under two per cent, so the margin is more than ten standard errors.

Whole documents that were copied to many sites share their lines as well; these
are for the duplicate operators. A cross-site line counts as copied, not as
boilerplate, by evidence: fewer than ``sites`` distinct texts hold it, or it
occurs as part of one passage (half the texts of two cross-site lines hold them
one after the other) and fewer than ``sites`` distinct texts hold it beside
mostly letters of their own. A document whose copied lines make up more than
``most_share`` of its letters is a copy: it keeps those lines and loses its
boilerplate. Every other document loses all its cross-site lines, however short
its own text is.

Defined results: null texts stay null; documents without boilerplate keep
their text byte for byte; empty texts stay empty, as one line; a null site is
one site of its own; repeated rows count as documents, not as sites; ids may
repeat or be null; an empty table gives no rows; a very long text is split in
memory of some times its size; other columns are kept, whatever their names,
but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import written

SITES, LEAST_CHARS, MARGIN, REGISTERS, MOST_SHARE = 10, 12, 0.25, 12, 0.5
#: Neighbouring lines belong to one passage if this share of the texts of either holds both.
TOGETHER = 0.5
#: Hashes of eight bytes, so a broadcast of a few megabytes at most.
BROADCAST = 200_000
#: A text that more documents hold is dealt in parts of about so many.
HOT = 256


def split_lines() -> Column:
    return F.split("text", "\n", -1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(line, site): the distinct long lines of each document, by hash."""
    long = F.filter(split_lines(), lambda x: F.length(F.trim(x)) >= least_chars)
    hashes = F.array_distinct(F.transform(long, line_hash))
    return docs.select(F.explode(hashes).alias("line"), F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("site"))


def spread(every: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """Lines with n_docs, estimated spread, exact spread where that is near the threshold, and verdict."""
    # one row a line and site, combined before the shuffle: what is dealt by line alone no longer grows with a line's documents
    pairs = written(every.groupBy("line", "site").agg(F.count("*").alias("n")), "lines-sites")
    often = pairs.groupBy("line").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= sites)
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS))
    held = pairs.select("line", "site").join(often, "line")
    sketched = written(held.groupBy("line").agg(F.max("n_docs").alias("n_docs"), sketch.alias("estimate")), "lines-spread")
    near = sketched.where(F.col("estimate").between(sites * (1 - margin), sites * (1 + margin)))
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    return sketched.join(exact, "line", "left").withColumn("boilerplate", F.coalesce("exact", "estimate") >= sites)


def letters(some: Column, length: Callable[[Column], Column] = F.length) -> Column:
    return F.aggregate(some, F.lit(0), lambda n, x: n + length(x))


def small(some: DataFrame, most: int = BROADCAST) -> DataFrame:
    return F.broadcast(some) if some.count() <= most else some


def texts_with(docs: DataFrame, bad: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row, held, total): the cross-site lines of each distinct text in order, with their letters, and the letters of the text; ``bad`` (line).

    Occurrences meet ``bad`` where they are read, so that no text is dealt, and equal texts are combined on the way."""
    long = F.filter(split_lines(), lambda x: F.length(F.trim(x)) >= least_chars)
    each = F.transform(long, lambda x, i: F.struct(i.alias("at"), line_hash(x).alias("line"), F.length(x).alias("chars")))
    # in a step of its own, so that a text is hashed and its letters are counted once, not for each line
    whole = docs.select(F.xxhash64("text").alias("row"), letters(split_lines()).alias("total"), each.alias("each"))
    met = whole.select("row", "total", F.explode_outer("each").alias("e")).select("row", "total", "e.*").join(bad, "line")
    held = met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "line", "chars"))).alias("held"), F.max("total").alias("total"))
    return held.select("row", F.transform("held", lambda h: F.struct(h["line"].alias("line"), h["chars"].alias("chars"))).alias("held"), "total")


def copied_lines(texts: DataFrame, sites: int = SITES, most_share: float = MOST_SHARE) -> DataFrame:
    """Those cross-site lines of ``texts`` that were copied with whole documents."""
    mostly = letters(F.col("held"), lambda h: h["chars"]) > most_share * F.col("total")
    once = texts.select(F.array_distinct("held.line").alias("held"), mostly.alias("mostly"))
    stats = once.select("mostly", F.explode("held").alias("line")).groupBy("line").agg(F.count("*").alias("texts"), F.count_if(~F.col("mostly")).alias("hosts"))
    stats = written(stats, "lines-held")
    follow = F.arrays_zip(F.slice("held", 1, F.size("held") - 1).alias("a"), F.slice("held", 2, F.size("held") - 1).alias("b"))
    pairs = once.where(F.size("held") > 1).select(F.explode(follow).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    known = lambda c: stats.select(F.col("line").alias(c), F.col("texts").alias(f"texts_{c}"))
    linked = pairs.join(known("a"), "a").join(known("b"), "b").where(F.col("n") >= TOGETHER * F.greatest("texts_a", "texts_b"))
    linked = linked.select(F.explode(F.array("a", "b")).alias("line"))
    few, unsure = stats.where(F.col("texts") < sites), stats.where((F.col("texts") >= sites) & (F.col("hosts") < sites))
    return few.select("line").unionByName(unsure.select("line").join(linked, "line", "left_semi"))


def with_lost(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` (row, text and rest) with the lines that their text loses (``lost``, row and bad). This is the one time that texts are dealt, each to where its row's
    hash says; a text of many documents goes to many tasks. ``lost`` is small beside the texts, which therefore need no sort."""
    held = rows.groupBy("row").agg(F.ceil(F.count("*") / HOT).alias("parts")).where(F.col("parts") > 1)
    hot = small(written(held, "lines-hot"))
    # by the other columns, so that a repeated task deals as the first did
    rest = F.xxhash64(F.col("rest").cast("string"))
    rows = rows.join(hot, "row", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(rest, "parts")))
    lost = lost.join(hot, "row", "left").select("row", "bad", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    return rows.join(lost.hint("shuffle_hash"), ["row", "part"], "left")


def remove_boilerplate(docs: DataFrame, sites: int = SITES, least_chars: int = LEAST_CHARS, most_share: float = MOST_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    bad = small(written(spread(lines(docs, least_chars), sites).where("boilerplate").select("line"), "lines-boilerplate"))
    # equal texts lose equal lines, so that texts are matched by their hash
    texts = written(texts_with(docs, bad, least_chars), "lines-in-order")
    copied = small(written(copied_lines(texts, sites, most_share), "lines-copied"))
    stay = texts.select("row", F.explode(F.array_distinct("held.line")).alias("line")).join(copied, "line").groupBy("row").agg(F.collect_list("line").alias("stay"))
    copies = texts.join(stay, "row").where(letters(F.filter("held", lambda h: F.array_contains("stay", h["line"])), lambda h: h["chars"]) > most_share * F.col("total"))
    gone = F.array_distinct("held.line")
    lost = texts.join(copies.select("row", "stay"), "row", "left").select("row", F.when(F.col("stay").isNull(), gone).otherwise(F.array_except(gone, "stay")).alias("bad"))
    # the caller's columns are in a struct, so that no name clashes
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"), "text", F.xxhash64("text").alias("row"))
    joined = with_lost(rows, lost).withColumn("lines", split_lines())
    is_bad = lambda x: (F.length(F.trim(x)) >= least_chars) & F.array_contains("bad", line_hash(x))
    cut = F.col("bad").isNotNull()
    joined = joined.withColumn("kept", F.when(cut, F.filter("lines", lambda x: ~is_bad(x))))
    n = F.coalesce(F.size("lines"), F.lit(0))
    text = F.when(cut, F.array_join("kept", "\n")).otherwise(F.col("text"))
    n_removed = F.when(cut, n - F.size("kept")).otherwise(F.lit(0))
    columns = [text.alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), n_removed.alias("n_removed"))
