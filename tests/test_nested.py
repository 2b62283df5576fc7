"""Nested JSON rules and HMAC against plain Python; the answer source against its mock, and over a restart."""

import hashlib
import hmac
import json
import random

from answerscope.functions import text as T
from answerscope.operators import nested
from answerscope.sources import answer_source
from pyspark.sql import functions as F


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([None, 1, 2.5, True, "x", "é\"", ""])
    if kind < 0.45:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "API_Key", "userPassword", "nested", "é", "token_x"]): tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def mask(v, depth=0):
    if depth <= 5 and isinstance(v, list):
        return [mask(x, depth + 1) for x in v]
    if depth > 5 or not isinstance(v, dict):
        return v
    secret = ("api_key", "apikey", "api-key", "secret", "token", "password", "authorization")
    return {k: nested.MASK if any(s in k.lower() for s in secret) else mask(x, depth + 1) for k, x in v.items()}


def merge(base, over):
    for k in over:
        if isinstance(over[k], dict) and isinstance(base.get(k), dict):
            merge(base[k], over[k])
        else:
            base[k] = json.loads(json.dumps(over[k]))
    return base


def test_trees_equal_recursion(spark):
    rng = random.Random(8)
    rows = [(i, *[json.dumps({"r": tree(rng, 6), "s": tree(rng, 5)} if rng.random() < 0.9 else tree(rng, 1)) for _ in range(3)]) for i in range(200)] + [(900, None, "", "{broken"), (901, "{}", None, "[1]")]
    df = spark.createDataFrame(rows, "i long, a string, b string, c string")
    got = df.select("i", nested.masked(F.col("a")).alias("m"), nested.merged(F.col("a"), F.col("b"), F.col("c")).alias("g")).collect()
    deep = 0
    for r, (_, *texts) in zip(sorted(got, key=lambda r: r.i), rows, strict=True):
        if texts[0] is None:
            assert r.m is None
        else:
            assert json.loads(r.m) == mask(json.loads(texts[0]))
            deep += r.m.count(nested.MASK)
        value = {}
        for t in texts:
            layer = nested.parsed(t)
            value = merge(value, layer) if isinstance(layer, dict) else value
        assert json.loads(r.g) == value
    assert deep > 100


def test_task_payloads_and_layers(spark):
    payload = {"Key": 1, "a": {"b": {"token": 2, "c": {"token": 3}}}, "l": [{"password": 4}, [{"password": 5}], "sk-12345678"], "v": "sk-12345678", "w": "a" * 32, "x": "short"}
    want = {"Key": nested.MASK, "a": {"b": {"token": nested.MASK, "c": {"token": 3}}}, "l": [{"password": nested.MASK}, [{"password": 5}], "sk-12345678"], "v": nested.MASK, "w": nested.MASK, "x": "short"}
    df = spark.createDataFrame([(json.dumps(payload), "not json")], "p string, q string")
    r = df.select(nested.masked(F.col("p"), task=True).alias("p"), nested.masked(F.col("q")).alias("q")).first()
    assert json.loads(r.p) == want and r.q == "not json"
    default = {"kpi_weights": {"a": 0.5, "b": 0.5}, "hallucination_thresholds": {"x": {"y": 1, "z": [1, 2]}}, "other": 1}
    industry = {"kpi_weights": {"a": 0.6}, "hallucination_thresholds": {"x": {"z": [3]}}, "other": 2}
    brand = {"kpi_weights": {"c": 1.0}, "hallucination_thresholds": {"x": {"y": None}}, "competitor_rules": {"n": 1}}
    df = spark.createDataFrame([(json.dumps(default), json.dumps(industry), json.dumps(brand)), (json.dumps(default), None, "")], "d string, i string, b string")
    got = [json.loads(x[0]) for x in df.select(nested.resolved(F.col("d"), F.col("i"), F.col("b"))).collect()]
    assert got[0] == {"kpi_weights": {"c": 1.0}, "hallucination_thresholds": {"x": {"y": None, "z": [3]}}, "competitor_rules": {"n": 1}, "other": 1}
    assert got[1] == default


def test_payload_redaction(spark):
    payload = {"callback": {"callback_token": "abc", "url": "u"}, "content": {"body_html": "x" * 600, "title": "t"}, "n": 1}
    df = spark.createDataFrame([(json.dumps(payload),), ("[]",), (None,)], "p string")
    got = [r[0] for r in df.select(nested.redacted_payload(F.col("p"))).collect()]
    assert json.loads(got[0]) == {"callback": {"callback_token": nested.MASK, "url": "u"}, "content": {"body_html": "x" * 500 + "...[truncated]", "title": "t"}, "n": 1}
    assert got[1:] == ["[]", None]


def test_hmac_vectors(spark):
    """The vectors of RFC 4231 (cases 1 to 4, 6 and 7), empty and odd keys."""
    cases = [(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 20, b"\xdd" * 50), (bytes(range(1, 26)), b"\xcd" * 50), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"), (b"\xaa" * 131, b"x" * 152), (b"", b""), (b"k" * 64, b""), (b"\x00", b"\xff"), ("é".encode(), "ü".encode())]
    df = spark.createDataFrame(cases, "k binary, m binary")
    got = [r[0] for r in df.select(T.hmac_sha256(F.col("m"), F.col("k"))).collect()]
    assert got == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in cases]
    assert got[0] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    assert got[1] == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert spark.sql("select string(null) as k, 'm' as m").select(T.hmac_sha256(F.col("m"), F.col("k"))).first()[0] is None


def test_answer_source_batch(spark):
    answer_source.register(spark)
    source = lambda **o: spark.read.format("answers").options(platforms="a,b,c", questions=25, per_partition=10, **o).load()
    got = sorted((tuple(r) for r in source().collect()), key=str)
    assert got == sorted((answer_source.ask(p, q, "mixed") for p in "abc" for q in range(25)), key=str)
    assert source().rdd.getNumPartitions() == 9
    assert {r.status for r in source(mode="timeout").collect()} == {"timeout"}
    one = source().where("platform = 'b' and question_no < 5")
    assert one.rdd.getNumPartitions() == 3 and {(r.platform, r.question_no) for r in one.collect()} == {("b", q) for q in range(5)}
    two = source().where(F.col("platform").isin("a", "c", "z"))
    assert two.rdd.getNumPartitions() == 6 and two.count() == 50
    assert source().where("platform = 'none'").count() == 0


def test_answer_stream_goes_on_after_a_restart(spark, tmp_path):
    answer_source.register(spark)

    def run(questions):
        stream = spark.readStream.format("answers").options(platforms="a,b", questions=questions, per_batch=7, per_partition=3).load()
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/at").foreachBatch(put).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.platform, r.question_no) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(20) == sorted((p, q) for p in "ab" for q in range(20))
    assert run(33) == sorted((p, q) for p in "ab" for q in range(33))
