"""Conversation repair against a plain search over all edits, on damaged data and odd tables."""

import hashlib
import heapq
import random
import re
import zlib

from answerscope.llm import conversations as c
from answerscope.llm.queries import op11_conversations
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        role, text = sp(role), sp(text)
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def search(initials, faults):
    """(cost, audit) of the cheapest edits: every sequence of edits in order of (cost, audit), nothing pruned but dead ends."""
    heap, n = [(0, "", 0, "")], len(initials)
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        if not re.fullmatch(r"(s?(ua)*u?)?", made):
            continue
        if i == n and re.fullmatch(r"(s?(ua)+)?", made):
            return cost, audit
        if not audit.endswith("III"):
            for x in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", i, made + x))
        if i < n:
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, made + (initials[i] or "?")))
                for x in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, made + x))


def replay(rows, audit):
    at, lines, i = "", [], 0
    for edit in audit:
        new = "assistant" if at.endswith("u") else "user"
        if edit == "I":
            lines.append(new + ":")
        else:
            role, text = rows[i][2:]
            i += 1
            if edit == "D":
                continue
            new = role if edit == "K" else new
            lines.append(f"{new}:{text}")
        at += new[0]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damage(rows):
        by[r[0]].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = search(initials, faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, replay(own, audit))
    return out


def found(spark, rows, schema=SCHEMA):
    got = c.repair(c.damaged(spark.createDataFrame(rows, schema))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def odd_rows():
    random.seed(5)
    rows = [(random.choice([None, *range(60)]), random.choice([None, *range(6)]), random.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), random.choice(["a.", "b!", "no end", "", None, "x? \n", " \t", "é。"])) for _ in range(240)]
    return rows + [(1000, 1, "user", "hi."), (1000, 2, "assistant", "ho."), (None, None, None, None)]


def test_odd_rows_against_search(spark):
    rows = odd_rows()
    assert found(spark, rows) == expected(rows)


def test_stretches_of_a_long_conversation(spark, monkeypatch):
    """Every row in a stretch of its own, three stretches to a product: as in one piece."""
    random.seed(6)
    rows = [(7, t // 2, random.choice(["user", "assistant", "system"]), random.choice(["a.", f"b{t}.", "cut", ""])) for t in range(9)] + odd_rows()[:60]
    whole = found(spark, rows)
    assert whole == expected(rows)
    monkeypatch.setattr(c, "STRETCH", 2)
    monkeypatch.setattr(c, "FANOUT", 3)
    assert found(spark, rows) == whole


def test_product_is_associative():
    random.seed(7)
    for _ in range(30):
        codes = "".join(random.choice("sua-") + random.choice("0123") for _ in range(7))
        one = c.identity()
        for i in range(0, len(codes), 2):
            one = c.times(one, c.turn(codes[i], codes[i + 1]))
        assert one == c.product(codes) == c.times(c.product(codes[:6]), c.product(codes[6:]))


def test_long_text_and_repeats(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y.")] + [(2, 1, "user", "same.")] * 500
    got = found(spark, rows)
    want = {k: v for k, v in expected(rows[:2]).items()}
    assert got[1] == want[1]
    assert got[2][2] >= 499 and got[2][6].count("D") >= 499


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == {}
    rows = [(1, 1, "user", "hi."), (1, 2, "assistant", "ho.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "code", "n", "kind", "audit", "live", "hit", "copy", "digest", "stretch"):
        df = df.withColumn(name, F.lit("x"))
    assert {r.conv_id: tuple(r)[1:] for r in c.repair(c.damaged(df)).collect()} == expected(rows)


def test_query_on_the_table(spark, data):
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversations(spark, data).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == expected(rows)
