"""The Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from answerscope.llm import merkle
from answerscope.llm.queries import merkle_manifest, op13_merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and each node's siblings level by level as (left, right)."""
    at, steps, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            steps[k].append((level[run:i], level[i + 1 : run + 3]))
            at[k] = i // 3
        level = [h(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], steps


def expected(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[1], []).append((r, h(map(field, r))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([x[1] for x in by[s]])
    root, above = climb([trees[s][0] for s in order]) if order else (None, [])
    for s, upper in zip(order, above, strict=True):
        for (r, leaf), own in zip(by[s], trees[s][1], strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = h(map(field, (*r[:4], text)))
            path = own + upper
            for left, right in path:
                node = h([*left, node, *right])
            proof = h(x for left, right in path for x in left + right)
            out.append((r[0], leaf, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def found(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle_manifest(df).select(*columns).collect()), key=str)


def rows_of(*sizes):
    texts = ["a\nb", "", None, "\n", "x" * 5, "é\nü\n"]
    rows, i = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((i, s, "en" if i % 4 else None, i if i % 5 else None, texts[i % 6]))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [[], [("a", 1)], [("a", 2)], [("a", 1), ("b", 1)], [(None, 4), ("", 1), ("Z", 28), ("a", 9), ("é", 10), ("b", 3)], [(f"s{i}", 1) for i in range(11)]])
def test_trees_of_many_sizes(spark, sizes):
    rows = rows_of(*sizes)
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_blocks_of_a_large_tree(spark, monkeypatch):
    """Blocks of nine: several rows of blocks, for the leaves of a source and for the sources."""
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = rows_of(("hot", 300), ("b", 81), ("c", 82), ("d", 9), ("e", 10), *[(f"s{i}", 1) for i in range(20)])
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_repeats_nulls_and_clashing_columns(spark):
    rows = rows_of(("a", 6), (None, 3)) + [(None, None, None, None, None)] * 2 + [(1, "a", "en", 1, "a\nb")] * 3 + [(None, "a", "x", 1, "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("i", "n", "node", "path", "root", "block", "tree", "all", "leaf", "_pos", "_part"):
        df = df.withColumn(name, F.lit(1))
    assert found(df) == expected(rows)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "a", "en", 1, "y\n"), (2, "a", "en", 1, "z")], SCHEMA).withColumn("text", F.expr("repeat(text, 5000000)"))
    assert found(df) == expected([tuple(r) for r in df.collect()])


def test_query_on_the_table(spark, data):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in op13_merkle(spark, data).select(*columns).collect()), key=str)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert got == expected([tuple(r) for r in docs.collect()])
