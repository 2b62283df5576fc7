"""Answers as a Python data source, for batch and stream: one partition per platform and range of questions.

``register(spark)`` and then

    spark.read.format("answers").option("questions", 1000).option("platforms", "a,b").load()

gives a row per question number and platform; join the numbers with a questions
table. A platform is asked in ``ask``, here a mock whose outcome follows from a
hash, so that repeated partitions agree; a subclass asks a real one. Filters on
the platform are pushed down: other platforms get no partition. The stream's
offset is the next question; a batch asks at most ``per_batch`` of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from answerscope.sources.readers import MODES

SCHEMA = "platform string, question_no long, status string, answer_text string, error_code string, retryable boolean"
# Error code of a failure mode, and whether asking again may help.
ERRORS = {
    "rate_limited": ("platform_rate_limited", True), "timeout": ("platform_timeout", True), "auth_failed": ("platform_auth_failed", False), "quota_exhausted": ("platform_quota_exhausted", False),
    "empty_response": ("platform_empty_response", False), "network_error": ("platform_network_error", True), "parse_failed": ("platform_parse_failed", False),
}


@dataclass
class Range(InputPartition):
    platform: str
    first: int
    end: int


def ask(platform: str, question: int, mode: str) -> tuple:
    """A mock platform's answer: in mode ``mixed`` the outcome is picked by a hash of question and platform."""
    status = MODES[zlib.crc32(f"{question}:{platform}".encode()) % len(MODES)] if mode == "mixed" else mode
    if status == "success":
        return (platform, question, status, f"[MOCK {platform}] {question}", None, None)
    return (platform, question, status, "", *ERRORS.get(status, ("platform_unknown_error", False)))


def ranges(platforms: Sequence[str], first: int, end: int, per_partition: int) -> list[Range]:
    return [Range(p, at, min(at + per_partition, end)) for p in platforms for at in range(first, end, per_partition)]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.platforms = [p.strip() for p in options.get("platforms", "").split(",") if p.strip()]
        self.questions, self.per_partition = int(options.get("questions", 0)), int(options.get("per_partition", 10_000))
        self.mode = options.get("mode", "mixed")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps the platforms that the filters name; Spark evaluates all other filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("platform",):
                self.platforms = [p for p in self.platforms if p == f.value]
            elif isinstance(f, In) and f.attribute == ("platform",):
                self.platforms = [p for p in self.platforms if p in f.value]
            else:
                yield f

    def partitions(self) -> list[Range]:
        return ranges(self.platforms, 0, self.questions, self.per_partition)

    def read(self, partition: Range) -> Iterator[tuple]:
        for question in range(partition.first, partition.end) if partition else ():
            yield ask(partition.platform, question, self.mode)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.asked = Reader(options)
        self.per_batch, self.at = int(options.get("per_batch", 1_000)), 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"question": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.per_batch, self.asked.questions)
        return {"question": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["question"])  # after a restart the first batch names where the last run stood
        return ranges(self.asked.platforms, start["question"], end["question"], self.asked.per_partition)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.asked.read(partition)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["question"])


class AnswerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known, with pushdown of platform filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(AnswerSource)
