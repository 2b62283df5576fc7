"""Places in an order within groups, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.sources.scratch import written


def numbered(rows: DataFrame, keys: list[str], order: list[Column], place: str = "place", size: str = "size") -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of ``order`` within equal ``keys``, and the group's ``size``.

    One range sort over keys and order: a large group lies in many neighbouring partitions, whose counts give each its
    first place. Rows of equal order take places in any order; null keys form a group.
    """
    columns, by = rows.columns, [F.col(k).asc_nulls_first() for k in keys] + order
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pos", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_pos", 33)), "numbered")
    group = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    names = [f"_key{i}" for i in range(len(keys))]
    held = ranged.groupBy(*group, F.col("_part").alias("_of")).agg(F.count("*").alias("_held"), F.min("_pos").alias("_from"))
    whole = W.partitionBy(*names)  # at most one row per range partition
    before = F.sum("_held").over(whole.orderBy("_of")) - F.col("_held")
    starts = held.select(*names, "_of", "_from", before.alias("_before"), F.sum("_held").over(whole).alias(size))
    same = F.col("_part") == F.col("_of")
    for name, key in zip(names, keys, strict=True):
        same &= F.col(key).eqNullSafe(F.col(name))
    return ranged.join(starts, same).select(*columns, (F.col("_pos") - F.col("_from") + F.col("_before") + 1).alias(place), size)
