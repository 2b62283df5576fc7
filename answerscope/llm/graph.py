"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of its component.

    Every round moves each node to the least of its closed neighbourhood and
    contracts the edges accordingly, so their number falls fast; each round's
    tables are written to the shared folder, and nothing but an emptiness
    check reaches the driver.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moves")
        if labels is None:
            labels = move.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = move.withColumnRenamed("a", "label")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if edges.isEmpty():
            return labels
        b = move.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        moved = edges.join(move, "a").join(b, "b").where("to <> b_to")
        edges = written(moved.select(F.least("to", "b_to").alias("a"), F.greatest("to", "b_to").alias("b")).distinct(), "edges")
