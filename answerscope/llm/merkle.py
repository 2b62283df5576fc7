"""A Merkle manifest of a dataset, with an inclusion proof for every row.

Leaves are numbered within their tree by one global sort. ``BLOCK`` leaves from
an aligned start (a power of the fanout) are one contiguous numpy matrix of
64-byte hex digests: each level is reshaped by the fanout and its rows hashed;
the siblings of every leaf follow from its index alone. The roots of blocks are
the leaves of the next matrix, until each tree has one node. Then paths come
back down: a block needs only its own path to hash its leaves' proofs. A tree
of any size is thus cut into blocks of bounded size, and no block holds more
than its leaves and a path.

A path is text: per level the digests left of the own node, ``*``, those right
of it, levels joined by ``/``; a node without siblings has ``*`` alone.

Defined results: rows of equal id are ordered by their leaf; a null id comes
first; nulls are ``-``; empty texts have zero bytes; equal rows have equal
leaves and their own places; a table of one row has its leaf as root; an empty
table gives no rows; very long texts are hashed where they are read, and never
move; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.llm.common import written

FANOUT = 3
#: Leaves in a block: a power of the fanout.
BLOCK = FANOUT**8


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def levels(nodes: np.ndarray, heights: int) -> list[np.ndarray]:
    """The digests of a block, level by level: each row of ``FANOUT`` digests is one node of the next level."""
    out = [nodes]
    for _ in range(heights):
        nodes = out[-1]
        whole = len(nodes) // FANOUT * FANOUT
        rows = np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT)
        above = [sha(row.tobytes()) for row in rows]
        if whole < len(nodes):
            above.append(sha(nodes[whole:].tobytes()))
        out.append(np.array(above, dtype="S64"))
    return out


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def paths(matrix: list[np.ndarray]) -> list[str]:
    """The path of each leaf of a block up to the block's root."""
    at = np.arange(len(matrix[0]))
    steps = []
    for nodes in matrix[:-1]:
        run = at // FANOUT * FANOUT
        end = np.minimum(run + FANOUT, len(nodes))
        raw = nodes.tobytes().decode("ascii")
        steps.append([f"{raw[64 * a : 64 * i]}*{raw[64 * i + 64 : 64 * b]}" for a, i, b in zip(run.tolist(), at.tolist(), end.tolist(), strict=True)])
        at = at // FANOUT
    return ["/".join(p) for p in zip(*steps, strict=True)] if steps else [""] * len(matrix[0])


def fold(node: str, path: str) -> str:
    """The root that a node and its path lead to."""
    for step in path.split("/") if path else []:
        left, _, right = step.partition("*")
        node = sha((left + node + right).encode())
    return node


def proof(path: str) -> str:
    return sha(path.replace("*", "").replace("/", "").encode())


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``i``, the place in the own tree, and ``n``, the tree's size."""
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_pos", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_pos", 33)), "merkle-ranged")
    held = ranged.groupBy(tree, "_part").agg(F.count("*").alias("_held"), F.min("_pos").alias("_from"))
    whole = W.partitionBy(tree)  # at most one row per range partition
    starts = held.select(tree, "_part", "_from", F.sum("_held").over(whole).alias("n"), (F.sum("_held").over(whole.orderBy("_part")) - F.col("_held")).alias("_before"))
    same = ranged[tree].eqNullSafe(starts[tree]) & (ranged["_part"] == starts["_part"])
    joined = ranged.join(starts, same).drop(starts[tree]).drop(starts["_part"])
    return joined.withColumn("i", F.col("_pos") - F.col("_from") + F.col("_before")).drop("_pos", "_part", "_from", "_before")


def climb(nodes: DataFrame, tree: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes (tree, i, n, node) below each row of blocks, lowest first, and the roots (tree, node)."""
    kind = nodes.schema[tree].dataType.simpleString()
    steps, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:

        def block_root(part: pd.DataFrame) -> pd.DataFrame:
            part, n = part.sort_values("i"), int(part["n"].iloc[0])
            matrix = levels(part["node"].to_numpy(dtype="S64"), min(height(n), height(BLOCK)))
            return pd.DataFrame([(part["tree"].iloc[0], int(part["i"].iloc[0]) // BLOCK, -(-n // BLOCK), matrix[-1][0].decode())], columns=["tree", "i", "n", "node"])

        blocks = steps[-1].select(F.col(tree).alias("tree"), "i", "n", "node").groupBy("tree", F.floor(F.col("i") / BLOCK))
        above = blocks.applyInPandas(block_root, f"tree {kind}, i long, n long, node string").withColumnRenamed("tree", tree)
        steps.append(written(above, "merkle-blocks"))
        most = -(-most // BLOCK)
    return steps[:-1], steps[-1].select(tree, "node")


def with_paths(finish):
    """Gives ``finish`` a block's rows in order and the path of each to the root of all."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        upper = part["path"].iloc[0]
        own = paths(levels(part["node"].to_numpy(dtype="S64"), min(height(int(part["n"].iloc[0])), height(BLOCK))))
        return finish(part, ["/".join(filter(None, (p, upper))) for p in own])

    return run


def descend(steps: list[DataFrame], tops: DataFrame, tree: str, finish, schema: str) -> DataFrame:
    """Carries the paths (tree, path, ...) of the roots down to the lowest nodes, and gives ``finish`` each block of these with its leaves' paths.

    ``finish(part, paths)`` returns the block's rows; on the way down they are the nodes' own paths."""
    carried = [c for c in tops.columns if c not in (tree, "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(steps):
        lowest = nodes is steps[0]
        held = nodes.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))
        same = held[tree].eqNullSafe(above[tree]) & (held["block"] == above["block"])
        met = held.join(above, same).drop(above[tree]).drop(above["block"]).withColumnRenamed(tree, "tree")
        last = finish if lowest else lambda part, full: part[["tree", *carried]].assign(block=part["i"], path=full)

        kinds = "".join(f", {c} {tops.schema[c].dataType.simpleString()}" for c in carried)
        shape = schema if lowest else f"tree {nodes.schema[tree].dataType.simpleString()}{kinds}, block long, path string"
        above = met.groupBy("tree", "block").applyInPandas(with_paths(last), shape)
        if not lowest:
            above = written(above.withColumnRenamed("tree", tree), "merkle-paths")
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) for ``rows`` (doc_id, source, node, shown): ``node`` is the leaf, ``shown`` what stands for it when it is verified.

    Rows of a source form a tree by doc_id; the trees' roots form one more by source."""
    # ids pass through Python as text: with nulls among them, large integers would lose digits
    placed = written(numbered(rows, "source", "doc_id", "node").withColumn("doc_id", F.col("doc_id").cast("string")), "merkle-leaves")
    back = F.col("doc_id").cast(rows.schema["doc_id"].dataType)
    steps, subroots = climb(placed, "source")
    listed = numbered(subroots.withColumn("all", F.lit(0)), "all", "source")
    upper, root = climb(listed, "all")

    def tops_of(part: pd.DataFrame, full: list[str]) -> pd.DataFrame:
        return part[["source", "root"]].assign(path=full, subroot=part["node"])

    kind = rows.schema["source"].dataType.simpleString()
    top = root.select("all", F.lit("").alias("path"), F.col("node").alias("root"))
    shape = f"source {kind}, root string, path string, subroot string"
    if upper:
        tops = descend(upper, top, "all", tops_of, shape)
    else:  # one source, whose root is the root of all
        tops = listed.select("source", F.col("node").alias("root"), F.lit("").alias("path"), F.col("node").alias("subroot"))
    tops = written(tops, "merkle-tops")

    def verified(part: pd.DataFrame, full: list[str]) -> pd.DataFrame:
        folded = [fold(n, p) for n, p in zip(part["shown"], full, strict=True)]
        return part[["doc_id", "subroot", "root"]].assign(leaf=part["node"], proof_sha256=[proof(p) for p in full], folded_root=folded)

    shape = "doc_id string, subroot string, root string, leaf string, proof_sha256 string, folded_root string"
    if steps:
        return descend(steps, tops, "source", verified, shape).withColumn("doc_id", back)
    alone = placed.join(tops, placed["source"].eqNullSafe(tops["source"])).drop("source")
    return alone.mapInPandas(lambda batches: (verified(p, p["path"].tolist()) for p in batches), shape).withColumn("doc_id", back)
