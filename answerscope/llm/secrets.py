"""Secrets by fixed patterns and a randomness test battery, in SQL functions only.

Fixed kinds: assign (a name of a secret and a value of 12 characters or more),
access (AKIA keys) and hex (16 characters or more). Beside these, every run of
``LEAST`` or more key characters is a candidate. From its characters an
encoding is inferred (hex, base32, base64), and three tests ask whether it
looks drawn at random from that alphabet: chi-squared uniformity, the runs
test around the alphabet's middle, and lag-one serial correlation. The least
p-value, times three, is the candidate's. Within strata of encoding and
length the Benjamini-Hochberg rule at level ``Q`` finds the candidates that
are not random; the others are reported as kind random where no fixed span
covers them. The rule needs ranks of p-values, which come from a histogram of
at most BUCKETS numbers a stratum, the same at every size of input.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives no rows; a very long text costs time in proportion
to its matches; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.llm.common import whole_text, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates of the battery; shorter runs tell too little about randomness.
LEAST = 20
KEY = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
Q, BUCKETS = 0.05, 400
KINDS = ("assign", "access", "hex", "random")
#: The alphabets in the order of their digits.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
SPAN = "array<struct<start:int,end:int,match:string>>"
#: Matches whose positions are added up at a time.
PART = 256


def located(text: Column, pattern: str) -> Column:
    """(start, end, match) of every match, from the pieces between the matches."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        one = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["match"].alias("match")))
        return F.struct(end.cast("int").alias("at"), F.when(pair["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match")))

    def add(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["found"], F.array(moved(part["found"], acc["at"]))).alias("found"))

    # arrays grow by copying, so positions are added up a part at a time, and then by parts
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda i: F.aggregate(F.slice(all_, i * PART + 1, F.lit(PART)), zero, step))
    parts = F.get(F.transform(F.array(pairs), cut), 0)
    return F.when(text.rlike(pattern), F.aggregate(parts, none, add, lambda acc: F.flatten(acc["found"]))).otherwise(F.array().cast(SPAN))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, to three digits."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def encoding(token: Column) -> Column:
    """hex, base32 or base64; null if the characters are those of words."""
    bare = F.regexp_replace(token, "=+$", "")
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Z]") & bare.rlike("[a-z]")
    return (
        F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$") & bare.rlike("[0-9]") & bare.rlike("[a-fA-F]"), "hex")
        .when(bare.rlike("^[A-Z2-7]+$") & bare.rlike("[2-7]") & bare.rlike("[A-Z]"), "base32")
        .when(bare.rlike("^[A-Za-z0-9+/_-]+$") & mixed, "base64")
    )


def p_value(token: Column, kind: Column) -> Column:
    """The least p-value of the three tests, times three."""
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    k = F.length(alphabet).cast("double")
    plain = F.translate(F.regexp_replace(F.when(kind == "hex", F.lower(token)).otherwise(token), "=+$", ""), "-_", "+/")
    digits = F.transform(F.split(plain, "(?!^)"), lambda c: F.instr(alphabet, c).cast("double"))
    n = F.length(plain).cast("double")

    def tests(x: Column) -> Column:
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))
        squares = total(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), 2))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = total(x, lambda v: (v > k / 2).cast("double"))
        low = n - high
        following = F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(1)))
        pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1))), following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + total(pairs, lambda p: ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double"))
        mean = 2 * high * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, F.abs(runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.sqrt(n))
        centre = total(x, lambda v: v) / n
        variance = total(x, lambda v: (v - centre) * (v - centre))
        lagged = total(pairs, lambda p: (p["a"] - centre) * (p["b"] - centre))
        z_serial = F.when(variance > 0, F.abs(lagged / F.greatest(variance, F.lit(1e-9))) * F.sqrt(n)).otherwise(F.sqrt(n))
        least = F.least(upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial))
        return F.least(F.lit(1.0), 3 * least)

    # a one-element array binds the digits, so that they are made once
    return F.get(F.transform(F.array(digits), tests), 0)


def stratum(token: Column, kind: Column) -> Column:
    """Encoding and power of two of the length."""
    return F.concat_ws(":", kind, F.floor(F.log2(F.length(token).cast("double"))).cast("string"))


def bucket(p: Column) -> Column:
    """p-values by logarithm: bucket b holds those up to 10^(-8 b / BUCKETS)."""
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BUCKETS / 8))).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fixed spans and tested candidates."""
    text = whole_text()
    assign = F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)
    candidates = F.transform(located(text, KEY), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), encoding(s["match"]).alias("encoding")))
    candidates = F.filter(candidates, lambda s: s["encoding"].isNotNull())
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), assign.alias("assign"), located(text, ACCESS).alias("access"), located(text, HEX).alias("hex"), candidates.alias("candidates"))
    tested = F.transform(
        "candidates",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), stratum(s["match"], s["encoding"]).alias("stratum"), p_value(s["match"], s["encoding"]).alias("p")),
    )
    ends = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *[ends(k).alias(k) for k in ("assign", "access", "hex")], tested.alias("candidates"))


def thresholds(scanned: DataFrame) -> dict[str, int]:
    """Per stratum, the least bucket (largest p-value) that the Benjamini-Hochberg rule rejects; none if it rejects none."""
    each = scanned.select(F.explode("candidates").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), bucket(F.col("c.p")).alias("bucket")).agg(F.count("*").alias("n"))
    within = W.partitionBy("stratum")  # at most BUCKETS rows a stratum
    ranked = each.select("stratum", "bucket", F.sum("n").over(within).alias("m"), F.sum("n").over(within.orderBy(F.desc("bucket"))).alias("rank"))
    edge = F.pow(F.lit(10.0), -8.0 * F.col("bucket") / BUCKETS)
    kept = ranked.where(edge <= Q * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("bucket").alias("bucket"))
    return {r["stratum"]: r["bucket"] for r in kept.collect()}  # three encodings times the lengths' powers of two


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array<struct<kind,start,end>>, by start, then kind in the order of KINDS."""
    scanned = written(scan(docs), "secrets-scan")
    rejected = thresholds(scanned)
    limit = F.lit(BUCKETS)
    table = F.create_map(*[F.lit(x) for kv in sorted(rejected.items()) for x in kv]) if rejected else F.lit(None).cast("map<string,int>")

    def of(kind: str) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), order.alias("_order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    fixed = F.concat(of("assign"), of("access"), of("hex"))
    accepted = F.filter("candidates", lambda c: bucket(c["p"]) < F.coalesce(F.element_at(table, c["stratum"]) if rejected else limit, limit))
    uncovered = F.filter(accepted, lambda c: ~F.exists("fixed", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    more = F.transform(uncovered, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("_order"), s["end"].alias("end"), F.lit("random").alias("kind")))
    spans = F.array_sort(F.concat("fixed", more))
    return scanned.withColumn("fixed", fixed).select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
