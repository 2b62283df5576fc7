"""The corpus pipeline: five stages over ``documents``, each a training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next one's documents. All but the last return the columns of
documents. SQL cannot express the first stage; tests hold the pipeline against
brute-force versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm import line_dedup, mixing, near_dedup, packing, toxicity
from answerscope.llm.common import documents, written
from answerscope.llm.queries import word_tokenizer

#: Score from which a document is rejected.
TOXIC = 0.5


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """What an operator needs, and all else in a struct, so that no name of the caller's clashes with its own."""
    return docs.select(*needed, "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))


def together(docs: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns again, with those that a stage changes."""
    return docs.select(*[changed.get(c, F.col("text") if c == "text" else F.col("rest").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the model learns from labelled rows outside the held-out fold."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return together(toxicity.score(apart(docs), model).where(F.col("score") < TOXIC), docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their cross-site lines; n_chars follows the text."""
    cut = line_dedup.remove_boilerplate(apart(docs, "source"))
    return together(cut, docs.columns, n_chars=F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_duplicates(docs, size=5, percent=80).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights of source, language and topic."""
    weighed = mixing.weigh(apart(docs, "doc_id", "source", "lang"), columns=["doc_id", "text", "rest"])
    return together(weighed.where("sampled"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens."""
    cut = packing.pieces(docs, word_tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(written(cut, "packing-pieces"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("near dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
