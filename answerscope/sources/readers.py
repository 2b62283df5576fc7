"""Sources: tables, JSON lines, configuration, generated answers, landed search results, catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.functions import text as T

GOLDEN = "claim_text string, expected_claim_nature string, expected_signals array<string>, industry string, expected_confidence_min double, notes string"
ANSWERS = "collection_run_id string, brand_id string, organization_id string, template_id string, platform string, question string, answer_text string, status string, collected_at timestamp"
SEARCH = "provider string, title string, url string, snippet string"
# Failure modes of a platform.
MODES = ("success", "rate_limited", "timeout", "auth_failed", "quota_exhausted", "empty_response", "network_error", "parse_failed")


def json_lines(spark: SparkSession, path: str, schema: str = GOLDEN) -> DataFrame:
    """JSON lines with a fixed schema; rows that do not fit are an error, not nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def landed_answers(spark: SparkSession, path: str) -> DataFrame:
    """The latest answer to each question of a run and template, from JSON lines in a folder per platform (platform=...).

    Platform filters prune folders. An unknown status is a parse failure; a success without text is an empty response.
    Answers collected at the same time tie by text.
    """
    landed = spark.read.schema(ANSWERS).json(path)
    keys, text = ["collection_run_id", "brand_id", "template_id", "platform", "question"], F.trim(F.coalesce("answer_text", F.lit("")))
    status = F.when(~F.coalesce(F.col("status").isin(*MODES), F.lit(False)), "parse_failed").when((F.col("status") == "success") & (text == ""), "empty_response").otherwise(F.col("status"))
    latest = landed.groupBy(*keys).agg(F.max(F.struct("collected_at", text.alias("answer_text"), status.alias("status"), "organization_id")).alias("last"))
    return latest.select(*keys, "last.*")


def with_parameters(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], **values) -> DataFrame:
    """SQL text with named parameters and DataFrames for its relations."""
    return spark.sql(sql, args=values, **views)


def kpi_mapping(spark: SparkSession, config: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(kpi, question_type, mode) of a parsed configuration."""
    rows = [(kpi, q, mode) for kpi, modes in config.items() for mode, types in modes.items() for q in types]
    return spark.createDataFrame(rows, "kpi string, question_type string, mode string")


def lookup(spark: SparkSession, values: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A fixed lookup table; small by construction, so it may be broadcast."""
    return spark.createDataFrame(sorted(values.items()), f"{key} string, {value} string")


def mock_answers(questions: DataFrame, platforms: Sequence[str], mode: str = "mixed") -> DataFrame:
    """An answer per question and platform; the outcome of a mixed run follows from a hash, so reruns agree."""
    asked = questions.withColumn("platform", F.explode(F.array(*[F.lit(p) for p in platforms])))
    pick = F.pmod(F.crc32(F.concat_ws(":", "question", "platform").cast("binary")), F.lit(len(MODES))).cast("int")
    status = F.element_at(F.array(*[F.lit(m) for m in MODES]), pick + 1) if mode == "mixed" else F.lit(mode)
    said = F.when(status == "success", F.concat(F.lit("Answer to "), "question")).otherwise("")
    return asked.withColumn("status", status).withColumn("answer_text", said)


def search_results(landed: DataFrame) -> DataFrame:
    """Landed search results with rank per provider and query, tier, and only the first of each URL."""
    from pyspark.sql import Window as W

    u = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "/+$", "")
    ranked = landed.withColumn("rank", F.row_number().over(W.partitionBy("provider", "query").orderBy("arrival"))).withColumn("normal_url", u)
    first = ranked.groupBy("normal_url").agg(F.min_by(F.struct("provider", "query", "title", "url", "rank"), F.struct("arrival", "provider")).alias("r"))
    return first.select("normal_url", "r.*").withColumn("tier", T.source_tier(F.col("url"), F.col("title")))


def described(spark: SparkSession, views: Mapping[str, DataFrame]) -> DataFrame:
    """Catalogue: table, column and type of the given relations."""
    rows = [(name, c, t) for name, df in views.items() for c, t in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
