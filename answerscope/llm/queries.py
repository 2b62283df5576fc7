"""The dealt queries: thin wrappers that derive the contracts' columns from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm import conversations, fingerprints, gif, html_extraction, line_dedup, merkle, mixing, near_dedup, packing, pii, secrets, substring_dedup, toxicity
from answerscope.llm.common import documents, whole_text, written


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), word_tokenizer())
    digest = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(written(digest, "packing-pieces"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = mixing.weigh(documents(spark, sf_dir), columns=["doc_id", "source", "lang"])
    return weighed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def counted(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    return [F.size(of_kinds(spans, (k,))).cast("long").alias(f"n_{k}") for k in kinds]


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans, base = secrets.find(documents(spark, sf_dir)), F.col("spans"), ("assign", "access", "hex")
    digest = F.sha2(joined(of_kinds(spans, base)), 256).alias("base_sha256")
    return found.select("doc_id", *counted(spans, base), digest, joined(spans).alias("spans"), *counted(spans, ("random",)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, spans = pii.with_spans(docs), F.col("spans")
    digest = F.sha2(joined(of_kinds(spans, pii.BASE_KINDS)), 256).alias("base_sha256")
    return found.select("doc_id", *counted(spans, pii.BASE_KINDS), digest, joined(spans).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return cut.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(whole_text(), "utf-8")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("raw"))
    size = F.greatest(F.lit(192), F.ceil(F.length("raw") / 192) * 192)
    padding = F.unhex(F.repeat(F.lit("20"), (size - F.length("raw")).cast("int")))
    read = gif.with_media(docs.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.concat("raw", padding).alias("payload")))
    levels = F.transform(F.array(*[F.lit(21 * i) for i in range(4)]), lambda i: F.aggregate(F.transform("frames.histogram", lambda h: F.get(h, i)), F.lit(0).cast("long"), lambda a, n: a + n))
    feature = F.format_string("frames=%d;ms=%d;greys=%s", F.size("frames"), F.aggregate("frames.duration_ms", F.lit(0).cast("long"), lambda a, n: a + n), F.array_join(levels, ","))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(documents(spark, sf_dir), size=3, percent=85).drop("text_hash")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = fingerprints.with_next(documents(spark, sf_dir))
    changed = linked.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    signed = changed.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    own = F.col("fingerprint")
    near_edited, near_next = fingerprints.likeness(own, F.col("edited_fingerprint")), fingerprints.likeness(own, F.col("next_fingerprint"))
    return signed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(conversations.damaged(rows))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, verified for texts of which every other one, by its id's checksum, has lost its line feeds."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = F.when(hit, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", merkle.leaf([*columns, F.col("text")]).alias("node"), merkle.leaf([*columns, shown]).alias("shown"))
    proved = merkle.manifest(leaves)
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_gif": op7_gif,
    "op8_near_dedup": op8_near_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversations": op11_conversations,
    "op12_html_extraction": op12_html_extraction,
    "op13_merkle": op13_merkle,
}

def line_sql() -> str:
    """Exact spread of every line; what remove_boilerplate does."""
    d = line_dedup
    return f"""
    WITH l AS (
      SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
    ), bad AS (
      SELECT trim(line) AS line FROM l WHERE length(trim(line)) >= {d.LEAST_CHARS} GROUP BY 1 HAVING count(DISTINCT source) >= {d.SITES}
    ), marked AS (
      SELECT l.*, bad.line IS NOT NULL AND length(trim(l.line)) >= {d.LEAST_CHARS} AS gone FROM l LEFT JOIN bad ON trim(l.line) = bad.line
    ), mostly AS (
      SELECT text, sum(length(line)) FILTER (gone) > {d.MOST_SHARE} * sum(length(line)) AS mostly FROM (SELECT DISTINCT text, line, i, gone FROM marked) GROUP BY 1
    ), held AS (
      SELECT text, trim(line) AS line, min(i) AS i, any_value(mostly) AS mostly FROM marked JOIN mostly USING (text) WHERE gone GROUP BY 1, 2
    ), stats AS (
      SELECT line, count(*) AS texts, count(*) FILTER (NOT mostly) AS hosts FROM held GROUP BY 1
    ), pairs AS (
      SELECT a, b, count(*) AS n FROM (SELECT lag(line) OVER (PARTITION BY text ORDER BY i) AS a, line AS b FROM held) WHERE a IS NOT NULL GROUP BY 1, 2
    ), linked AS (
      SELECT unnest([a, b]) AS line FROM pairs JOIN stats x ON a = x.line JOIN stats y ON b = y.line WHERE n >= {d.TOGETHER} * greatest(x.texts, y.texts)
    ), copied AS (
      SELECT line FROM stats WHERE texts < {d.SITES} OR hosts < {d.SITES} AND line IN (SELECT line FROM linked)
    ), judged AS (
      SELECT *, gone AND trim(line) IN (SELECT line FROM copied) AS copied FROM marked
    ), copies AS (
      SELECT doc_id, coalesce(sum(length(line)) FILTER (copied), 0) > {d.MOST_SHARE} * sum(length(line)) AS copy FROM judged GROUP BY 1
    ), each AS (
      SELECT doc_id, count(*) AS n, count(*) FILTER (gone AND NOT (copy AND copied)) AS n_gone, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone OR (copy AND copied)) AS kept
      FROM judged JOIN copies USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, n AS n_lines, n_gone AS n_removed, sha256(coalesce(kept, '')) AS text_sha256 FROM each
    """


def mixing_sql() -> str:
    """The same raking, one window per margin and round."""
    m = mixing
    cases = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in m.TOPICS)
    steps = [f"""
    d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
    e AS (SELECT doc_id, source, lang, CASE WHEN t = '' THEN 'empty' {cases} ELSE 'prose' END AS topic,
      len(regexp_extract_all(t, '[^ \t\n\v\f\r]+')) AS n_tokens FROM d),
    cells AS MATERIALIZED (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, sum(n_tokens)::DOUBLE AS n FROM e GROUP BY ALL HAVING n > 0)"""]
    for margin in m.MARGINS:
        steps.append(f"""
    t_{margin} AS MATERIALIZED (SELECT v, r * sum(n) OVER () / sum(r) OVER () AS target FROM (SELECT {margin} AS v, sum(n) AS n, pow(sum(n), {m.TEMPER[margin]}) AS r FROM cells GROUP BY 1))""")
    last = "(SELECT *, n AS w FROM cells)"
    for i in range(m.ROUNDS):
        for margin in m.MARGINS:
            name = f"w_{margin}_{i}"
            steps.append(f"""
    {name} AS MATERIALIZED (SELECT source, lang, topic, n, w * target / sum(w) OVER (PARTITION BY {margin}) AS w FROM {last} c JOIN t_{margin} ON {margin} = v)""")
            last = name
    rate = str(m.KEEP)
    for i in range(m.FILLS):
        steps.append(f"""
    r_{i} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(r0, ({m.KEEP} * n - filled) / rest) ELSE r0 END AS r FROM (
      SELECT sum(n) AS n, sum(CASE WHEN w * {rate} >= n THEN n ELSE 0 END) AS filled, sum(CASE WHEN w * {rate} >= n THEN 0 ELSE w END) AS rest, any_value({rate}) AS r0 FROM {last}))""")
        rate = f"(SELECT r FROM r_{i})"
    return f"""WITH {",".join(steps)},
    p AS (SELECT e.*, coalesce(w / n, 1.0) AS weight FROM e LEFT JOIN {last} c ON coalesce(e.source, '(none)') = c.source AND coalesce(e.lang, '(none)') = c.lang AND e.topic = c.topic),
    q AS (SELECT *, least(1.0, weight * {rate}) AS probability FROM p)
    SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
      ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled FROM q"""


ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing_sql(), "op6_line_dedup": line_sql()}
