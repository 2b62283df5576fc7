"""The pipeline, stage by stage: each against a brute-force version on what the stage before kept, and on odd tables."""

import corpus_pipeline
import duckdb
import pytest
from answerscope.llm import queries, toxicity
from pyspark.sql import functions as F
from test_llm import SCHEMA, linked, prose, scores, shingles, without_boilerplate

LABELS = "doc_id long, quality int, toxic int"


def kept_by(name, spark, docs, path, sf_dir):
    """(doc_id, text) that the stage must keep, in plain Python or SQL."""
    rows = {r.doc_id: r for r in docs.collect()}
    if name == "toxicity":
        sample = toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).orderBy("doc_id").collect()
        model = toxicity.train([r.text for r in sample], [r.toxic for r in sample])
        found = scores(model, [r.text or "" for r in rows.values()])
        return {k: r.text for (k, r), s in zip(rows.items(), found, strict=True) if s < corpus_pipeline.TOXIC}
    if name == "line dedup":
        some = {k: r for k, r in rows.items() if r.text is not None}
        cut = without_boilerplate([(r.text, r.source) for r in some.values()])
        return {k: r.text for k, r in rows.items()} | dict(zip(some, cut, strict=True))
    if name == "near dedup":
        least = linked({k: shingles(r.text or "", 5) for k, r in rows.items()}, 80)
        return {k: r.text for k, r in rows.items() if least[k] == k}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return {k: rows[k].text for (k,) in c.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op3_mixing']}) WHERE sampled").fetchall()}


def test_stages_equal_brute_force(spark, data, tmp_path):
    docs, path = spark.read.parquet(f"{data}/documents.parquet"), f"{data}/documents.parquet"
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        want = kept_by(name, spark, docs, path, data)
        stage(spark, docs, data).write.parquet(path := f"{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        if name == "line dedup":
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    pieces, sequences = {}, {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == {r.doc_id for r in docs.collect()}
    for parts in pieces.values():
        ends = [0, *(s + n for s, n, _ in sorted(parts))]
        assert [s for s, _, _ in sorted(parts)] == ends[:-1] and ends[-1] == parts[0][2]
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_run_packs_what_the_stages_keep(spark, data):
    got = corpus_pipeline.run(spark, data)
    sums = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want"))
    assert sums.where("n <> want").count() == 0 and got.count() > 0


@pytest.mark.parametrize("full", [True, False])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, full):
    """Nulls in any column, empty and very long texts and words, repeated rows, columns of clashing names; and no rows at all."""
    extra = "row int, key int, n int, _n string, rank int, hash int, text_hash int, class2 int"
    own = ["_source", "_lang", "score", "margin", "n_lines", "n_removed", "n_tokens", "topic", "weight", "probability", "sampled", "rest", "doc", "salt", "salts"]
    texts = [None, "", " \n ", "one", prose(1, 60), prose(1, 60), prose(2, 30_000), "x" * 300_000, "é" * 3000]
    rows = [(i, t, "en", "s", len(t or ""), 1, "c", 2, "q", 1, 2, 3, "4", 5, 6, 7, 8) for i, t in enumerate(texts)] + [(3, "one", None, None, None, *[None] * 12), (None, None, *[None] * 15)]
    docs = spark.createDataFrame(rows if full else [], f"{SCHEMA}, {extra}").withColumns({c: F.lit(f"my {c}") for c in own})
    spark.createDataFrame([(4, 1, 0), (7, 0, 1), (6, None, None)] if full else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.schema(out.schema).parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert after.columns == docs.columns and after.count() <= docs.count()
            assert all(r[c] == f"my {c}" for r in after.collect() for c in own)
            docs = after
    assert (after.count() > 0) == full
