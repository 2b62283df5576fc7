"""Repair of conversation structure by a min-plus matrix scan.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. The
four states of that pattern (start, after s, after u, after ua) make each turn
a 4x4 matrix over (cost, audit) elements: the sum takes the lesser element, the
product adds costs and joins audits. Before each turn stands the closure of
insertions. Products are associative, and two audits of equal cost for the same
turns are never prefixes of each other, so that the ASCII-least of the cheapest
audits is found by products in any grouping: turns are ranged over partitions,
each stretch of a conversation in a partition becomes one matrix, and a tree of
aggregates multiplies up to ``FANOUT`` neighbouring stretches at a time. A very
long conversation thus costs many small tasks; only the last pass, which hashes
its repaired text, reads its rows in order, as a stream of bounded memory.

Defined results: rows are ordered by turn (nulls first), then role, then text
(by its first 64 characters, then by digest); equal rows are counted, not
moved, until they are hashed; null roles and texts are one space; a null id is
a conversation of its own; an empty role has no initial and is never legal; a
conversation without rows has zeros and empty strings; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, DONE = range(4)
#: From a state, by a role's initial, to a state.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: The role that an insertion or a new role has in each state.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}
#: Neighbouring stretches that one product joins, and rows in a stretch, about.
FANOUT, STRETCH = 16, 100_000
#: A turn's code: its initial (s, u, a or other) in lower case, and its fault.
OK, BLANK, DUPLICATE, CUT = "0123"

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def lesser(a: Element, b: Element) -> Element:
    return a if b is None or (a is not None and a <= b) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Element] = []
        for j in range(4):
            best: Element = None
            for x, other in zip(row, b, strict=True):
                y = other[j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = lesser((x[0] + y[0], x[1] + y[1]), best)
            line.append(best)
        out.append(line)
    return out


def identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


@lru_cache(1)
def closure() -> Matrix:
    """Any number of insertions."""
    step: Matrix = [[None] * 4 for _ in range(4)]
    for state, role in NEXT.items():
        step[state][MOVES[state, role[0]]] = (INSERT, "I")
    total = power = identity()
    for _ in range(3):
        power = times(power, step)
        total = [[lesser(x, y) for x, y in zip(r, s, strict=True)] for r, s in zip(total, power, strict=True)]
    return total


@lru_cache(None)
def turn(initial: str, fault: str) -> Matrix:
    """Insertions before a turn, then the turn kept, given a new role or deleted."""
    m: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    more = TRUNCATED if fault == CUT else 0
    if fault in (OK, CUT):
        for state, role in NEXT.items():
            to = MOVES[state, role[0]]
            m[state][to] = lesser(m[state][to], (REROLE + more, "R"))
        for (state, letter), to in MOVES.items():
            if letter == initial:
                m[state][to] = lesser(m[state][to], (KEEP + more, "K"))
    return times(closure(), m)


@lru_cache(1 << 16)
def few(codes: str) -> Matrix:
    """The product of at most four turns; most conversations are made of the same few stretches."""
    m = turn(codes[0], codes[1])
    for i in range(2, len(codes), 2):
        m = times(m, turn(codes[i], codes[i + 1]))
    return m


def tree(matrices: list[Matrix]) -> Matrix:
    while len(matrices) > 1:
        pairs = [times(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0] if matrices else identity()


def product(codes: str) -> Matrix:
    return tree([few(codes[i : i + 8]) for i in range(0, len(codes), 8)])


def cheapest(m: Matrix) -> tuple[int, str]:
    """The least element that leads from the start to an accepting state, with insertions at the end."""
    last = times(m[:1], closure())[0]
    return lesser(last[START], last[DONE])


LEGAL = {"su", "ua", "au"}


def flat(m: Matrix) -> tuple[list, list]:
    cells = [x for row in m for x in row]
    return [None if x is None else x[0] for x in cells], [None if x is None else x[1] for x in cells]


def square(costs: list, audits: list) -> Matrix:
    cells = [None if c is None or c != c else (int(c), a) for c, a in zip(costs, audits, strict=True)]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
STRETCHES = "conv_id string, stretch long, costs array<long>, audits array<string>, first string, last string, turns long, lo long, hi long, blank long, duplicate long, truncated long, illegal long"


def stretch_of(batches):
    """Each stretch's codes as one matrix, with its counts and what meets the neighbouring stretches."""
    for part in batches:
        out = []
        for codes in part["codes"]:
            initials, faults = codes[::2], codes[1::2]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            out.append((*flat(product(codes)), initials[:1], initials[-1:], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal))
        added = pd.DataFrame(out, columns=["costs", "audits", "first", "last", *COUNTS], index=part.index)
        yield pd.concat([part.drop(columns="codes"), added], axis=1)


def joined(batches):
    """The product of a group of neighbouring stretches."""
    for part in batches:
        out = []
        for parts in part["parts"]:
            met = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            first = last = ""
            turns, lo, hi = 0, None, None
            for p in parts:
                for k in COUNTS:
                    met[k] += p[k]
                if p["first"]:
                    met["illegal"] += bool(last) and last + p["first"] not in LEGAL
                    first, last = first or p["first"], p["last"]
                if p["turns"]:  # stretches ascend by turn: only the turn that two of them share is counted twice
                    turns += p["turns"] - (hi is not None and hi == p["lo"])
                    lo, hi = p["lo"] if lo is None else lo, p["hi"]
            m = tree([square(p["costs"], p["audits"]) for p in parts])
            out.append((*flat(m), first, last, turns, lo, hi, *met.values()))
        added = pd.DataFrame(out, columns=["costs", "audits", "first", "last", "turns", "lo", "hi", *COUNTS], index=part.index)
        yield pd.concat([part.drop(columns="parts"), added.astype({"lo": "Int64", "hi": "Int64"})], axis=1)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as they come in: (conv_id, turn, role, text, live), of which some are dropped (not live), changed or repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(key) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    made = hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") != 0).alias("live"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("n"))
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "copy")


def ordered_columns() -> list[Column]:
    return [F.left(F.col("text"), F.lit(64)).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest")]


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, piece): each distinct row's place in the order of all rows, and its codes, repeated as often as the row is."""
    letter = F.left(F.col("role"), F.lit(1))
    initial = F.when(letter.isin("s", "u", "a"), letter).otherwise("-")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(OK)
    live = F.col("live")
    light = rows.select("conv_id", F.when(live, F.col("turn")).alias("turn"), *[F.when(live, c).otherwise(empty).alias(n) for n, c, empty in (("role", F.col("role"), ""), ("head", ordered_columns()[0], ""), ("digest", ordered_columns()[1], F.lit(b"")), ("code", F.concat(initial, fault), ""))])
    key = ["conv_id", "turn", "role", "head", "digest"]
    counted = light.groupBy(*key).agg(F.first("code").alias("code"), F.count("*").alias("n"))
    counted = written(counted, "turns-counted")
    parts = max(counted.sparkSession.sparkContext.defaultParallelism, math.ceil(counted.count() / STRETCH))
    ranged = counted.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("pos", F.monotonically_increasing_id())
    ranged = written(ranged, "turns-ranged")
    fault = F.substring("code", 2, 1)
    once = ranged.where((F.col("code") != "") & (fault != BLANK)).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("seen_first"))
    marked = ranged.join(once, "pos", "left")
    again = F.concat(F.substring("code", 1, 1), F.lit(DUPLICATE))
    copies = F.when(fault == BLANK, F.repeat("code", F.col("n").cast("int"))).when(F.col("seen_first"), F.concat("code", F.repeat(again, (F.col("n") - 1).cast("int")))).otherwise(F.repeat(again, F.col("n").cast("int")))
    return marked.select("conv_id", "turn", "pos", F.when(F.col("code") == "", "").otherwise(copies).alias("piece"))


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation with its counts, turns and the 16 elements of its product."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
    # a stretch is what one range partition holds of a conversation
    stretches = turns.groupBy("conv_id", F.shiftright("pos", 33).alias("stretch")).agg(
        F.array_join(pieces, "").alias("codes"), F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min("turn").alias("lo"), F.max("turn").alias("hi")
    )
    columns = ["conv_id", "stretch", "costs", "audits", "first", "last", "turns", "lo", "hi", *COUNTS]
    scanned = written(stretches.mapInPandas(lambda b: (p[columns] for p in stretch_of(b)), STRETCHES), "turns-stretches")
    most = scanned.agg(F.max("stretch")).first()[0] or 0
    while True:
        group = F.floor(F.col("stretch") / FANOUT).cast("long").alias("stretch")
        fields = [c for c in columns if c not in ("conv_id", "stretch")]
        grouped = scanned.groupBy("conv_id", group).agg(F.array_sort(F.collect_list(F.struct("stretch", *fields))).alias("parts"))
        scanned = written(grouped.mapInPandas(lambda b: (p[columns] for p in joined(b)), STRETCHES), "turns-joined")
        if most < FANOUT:
            return scanned
        most //= FANOUT


def repaired_hashes(batches):
    """Reads each conversation's row of edits, then its turns in order, and hashes the repaired lines as they pass."""
    kept = ["conv_id", "gaps", *COUNTS, "cost", "audit"]
    now = None

    def insertions():
        while now["at"] < len(now["audit"]) and now["audit"][now["at"]] == "I":
            line(NEXT[now["state"]], "")
            now["at"] += 1

    def line(role: str, text: str):
        now["sha"].update((("\n" if now["lines"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        now["lines"] += 1
        now["state"] = MOVES[now["state"], role[0]]

    for part in batches:
        done = []
        for row in part.itertuples(index=False):
            if row.kind == 0:
                if now is not None:
                    insertions()
                    done.append((*now["row"], now["sha"].hexdigest()))
                now = {"row": [getattr(row, c) for c in kept], "audit": row.audit, "at": 0, "state": START, "sha": hashlib.sha256(), "lines": 0}
                continue
            insertions()
            edit = now["audit"][now["at"]]
            now["at"] += 1
            if edit == "K":
                line(row.role, row.text)
            elif edit == "R":
                line(NEXT[now["state"]], row.text)
        yield pd.DataFrame(done, columns=[*kept, "repaired_sha256"])
    if now is not None:
        insertions()
        yield pd.DataFrame([(*now["row"], now["sha"].hexdigest())], columns=[*kept, "repaired_sha256"])


def finished(batches):
    for part in batches:
        cost, audit = zip(*[cheapest(square(c, a)) for c, a in zip(part["costs"], part["audits"], strict=True)], strict=True) if len(part) else ((), ())
        yield part[["conv_id", "gaps", *COUNTS]].assign(cost=list(cost), audit=list(audit))


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, live): gaps, faults, cost and audit of the cheapest repair, and its digest.

    Rows that are not live don't count, but their conversations are listed."""
    # ids pass through Python as text: with nulls among them, large integers would lose digits
    back = F.col("conv_id").cast(rows.schema["conv_id"].dataType)
    rows = rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    whole = audits(coded(rows))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    edits = written(whole.select("conv_id", gaps, *COUNTS, "costs", "audits").mapInPandas(finished, schema), "turns-edits")
    heads = edits.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "head": F.lit(""), "digest": F.lit(b"")})
    texts = rows.where("live").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *ordered_columns())
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "head", "digest")
    light = stream.select("conv_id", "kind", "role", "text", "gaps", *COUNTS, "cost", "audit")
    return light.mapInPandas(repaired_hashes, schema + ", repaired_sha256 string").withColumn("conv_id", back)
