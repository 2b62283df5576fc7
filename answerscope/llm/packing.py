"""Packing documents into fixed windows: non-negative least squares on the length histogram.

Each document becomes token ids (its text, then one end id) and is cut into
pieces of at most ``window`` ids. Only the histogram of piece lengths, at most
``window`` numbers whatever the input, reaches the driver. There, all
combinations of up to three lengths that fill a window are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and
rounded, and what is left is packed greedily, again by length and count. The
outcome is a list of patterns with repeat counts; pieces find their slot by
their rank among the pieces of equal length, which is counted in groups of a
bounded size, so that one very common length does not meet in one task.

Defined results: a null or empty text is the single end id; null ids are
kept; repeated rows are packed as often as they occur; an empty table gives no
pieces; a very long text is encoded in one piece, in memory of some times its
size, and cut into rows of a window; other columns of ``pieces`` are ignored,
and those of ``assign`` kept, but sequence_id and offset replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.llm.common import whole_text, written

END_ID = 1
#: Pieces of one length that are ranked in one group, about; a commoner length is dealt to more groups.
RANKED = 50_000
#: Words that a worker remembers the ids of, twice; a bound on memory only.
CACHE_WORDS = 300_000
#: Letters whose lower case and composed form are single letters, with marks after them that make one piece.
PLAIN = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?$&%#*]*)$", re.M)
ODD_SPACE, OTHER = re.compile(r"[\x1c-\x1f]"), re.compile(r"[^\x00-\xff]")
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class WordEncoder:
    """Ids of a text from the ids of its words.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words in turn. Words of plain letters are encoded many at
    a time: each is one piece, whose last token carries the end-of-word mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                out += self._raw(some)
                continue
            raw, last = ids.tobytes(), 0
            for stop in (stops * 4).tolist():
                out.append(raw[last:stop])
                last = stop
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:  # words that are met again come back from the generation before
            self.known, self.before = {}, self.known
        new = words.difference(self.known)
        again = new.intersection(self.before)
        self.known.update((w, self.before[w]) for w in again)
        new -= again
        found = PLAIN.findall("\n".join(new))
        plain = list({base for base, _ in found}.difference(self.known))
        self.known.update(zip(plain, self._letters(plain), strict=True))
        marks = list({mark for _, mark in found if mark}.difference(self.marks))
        self.marks.update(zip(marks, self._raw(marks), strict=True))
        marked = {base + mark: self.known[base] + self.marks[mark] for base, mark in found if mark}
        self.known.update(marked)
        odd = list(new.difference(self.known))
        self.known.update(zip(odd, self._raw(odd), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*filter(None, split)))
        get = self.known.__getitem__
        for text, words in zip(texts, split, strict=True):
            yield self._raw([text])[0] if words is None else b"".join(map(get, words))

    @staticmethod
    def words(text: str) -> list[str] | None:
        """None where white space means other things to Python than to the tokenizer."""
        if ODD_SPACE.search(text):
            return None
        # in these letters lower case is one to one, and the tokenizer takes it anyway
        return text.split() if OTHER.search(text) or "<|" in text else text.lower().split()


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One a Python worker, so that the words known outlive a task."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit)."""

    def cut(batches):
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 500):
                rows = []
                for doc_id, raw in zip(ids[at : at + 500], encoder.encode(texts[at : at + 500].to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    rows += [(doc_id, s, min(window, n - s), n, raw[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All combinations of one to three of the sorted ``lengths`` that fill a window: rows of falling lengths, 0 for none."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths], there[0] = True, True
    rows = []
    for a in lengths.tolist():
        b = np.concatenate([[0], lengths[: np.searchsorted(lengths, min(a, window - a), "right")]])
        c = window - a - b
        fits = (c >= 0) & (c <= b)
        b, c = b[fits], c[fits]
        b, c = b[there[c]], c[there[c]]
        rows.append(np.stack([np.full(len(b), a), b, c], axis=1))
    return np.concatenate(rows) if rows else np.empty((0, 3), dtype=np.int64)


def fit_counts(combos: np.ndarray, counts: np.ndarray, tolerance: float = 0.002) -> np.ndarray:
    """argmin ||A x - h|| over x >= 0; row p of ``combos`` has the lengths that one repeat of p uses, ``counts`` is h by length.

    Descent by blocks: of all combinations, those that lower the error the most and share no length are solved at once.
    It ends when a block lowers the squared error by less than ``tolerance`` of it, or no repeat count by half a sequence.
    """
    a, b, c = combos.T
    norm = (1.0 + (b > 0) + (c > 0)) + 2.0 * ((a == b) + (b == c) * (b > 0)) + 2.0 * (a == c)
    left, x = counts.astype(float), np.zeros(len(combos))
    left[0] = 0.0
    error, before = float(left @ left), np.inf
    while len(combos) and error < (1 - tolerance) * before:
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -x)
        worth = step * step * norm
        most = min(3000, len(worth))
        best = np.argpartition(worth, len(worth) - most)[-most:]
        best = best[np.argsort(-worth[best], kind="stable")]
        best = best[np.abs(step[best]) >= 0.5]
        used, chosen = {0}, []
        for p, mine in zip(best.tolist(), combos[best].tolist(), strict=True):
            if used.isdisjoint(m for m in mine if m):
                used.update(mine)
                chosen.append(p)
        if not chosen:
            break
        x[chosen] += step[chosen]
        np.subtract.at(left, combos[chosen].ravel(), np.repeat(step[chosen], 3))
        left[0] = 0.0
        error, before = float(left @ left), error
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) with repeat counts that use every counted piece exactly once."""
    left = {k: v for k, v in counts.items() if v > 0}
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(k, 0) // n for k, n in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times

    histogram = np.zeros(window + 1, dtype=np.int64)
    for k, v in left.items():
        histogram[k] = v
    combos = combinations(np.flatnonzero(histogram), window)
    fitted = fit_counts(combos, histogram)
    for p in np.argsort(-fitted, kind="stable").tolist():
        if (times := int(fitted[p] + 0.5)) < 1:
            break
        take(dict(Counter(combos[p][combos[p] > 0].tolist())), times)
    lengths = sorted(k for k, v in left.items() if v > 0)
    while lengths:
        pattern, room = {}, window
        while room > 0 and (i := bisect_right(lengths, room)):
            while i and pattern.get(lengths[i - 1], 0) >= left[lengths[i - 1]]:
                i -= 1
            if not i:
                break
            k = lengths[i - 1]
            n = min(room // k, left[k] - pattern.get(k, 0))
            pattern[k] = pattern.get(k, 0) + n
            room -= n * k
        take(pattern, 1 << 62)
        lengths = [k for k in lengths if left[k] > 0]
    return out


def assign(cut: DataFrame, window: int = 2048) -> DataFrame:
    """``cut`` (doc_id, start, length and any more columns) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    slots, base, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, window):
        at = 0
        for length, each in pattern.items():
            slots.append((length, taken[length], taken[length] + times * each, base, at, each))
            taken[length] += times * each
            at += length * each
        base += times
    slot = spark.createDataFrame(slots, "length long, from long, to long, base long, at long, each long")  # bounded by the window: a slot for each length of each pattern
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, salts long")  # at most ``window`` rows
    # the caller's columns are in a struct, so that no name clashes
    whole = cut.select(F.struct(*cut.columns).alias("piece"), "length", F.xxhash64(*cut.columns).alias("hash"))
    salted = whole.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("hash", "salts")).drop("salts")
    counted = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "packing-counts")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    start = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each RANKED pieces
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("hash")))
    # dealt by these keys already
    ranked = ranked.join(start, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    hit = (ranked["length"] == slot["length"]) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    placed = ranked.join(F.broadcast(slot), hit)
    nth = F.col("rank") - F.col("from")
    return placed.select("piece.*", (F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("piece.length")).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048) -> DataFrame:
    """Pieces with their ids, sequence_id and offset."""
    return assign(written(pieces(docs, tokenizer_path, window), "packing-pieces"), window)


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """Token ids of each sequence, padded to ``window`` except at a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    padded = F.when(F.expr("n_tokens & (n_tokens - 1)") == 0, F.col("n_tokens")).otherwise(F.lit(window))
    pad = F.expr(f"hex(unhex('{np.array([pad_id], dtype='<u4').tobytes().hex()}'))")
    ids = F.concat(F.array_join("parts.ids", ""), F.repeat(pad, (padded - F.col("n_tokens")).cast("int")))
    return out.select("sequence_id", "n_tokens", F.unhex(ids).alias("ids"))
