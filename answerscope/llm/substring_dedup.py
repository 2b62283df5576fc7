"""Removal of word passages that repeat anywhere, by fixed-block anchors.

Documents are dealt by hash to chunks; a chunk is the unit of work. Of every
document the non-overlapping reference blocks of ``block`` words are indexed,
and every rolling window of ``block`` words is a probe. As
``window >= 2 * block - 1``, every repeat of ``window`` words holds a whole
reference block of one side, which a rolling window of the other side hits.

1. Each chunk sends its distinct window hashes, with a mark for those that are
   reference blocks and one for those it holds twice, packed by hash range
   (some four bytes a word). A range sorts what it gets and answers each chunk
   with those of its hashes that are a reference block and occur elsewhere:
   the anchors.
2. Hits are extended: each ``window``-word run that contains an anchor is a
   candidate for a maximal repeat; chunks send the full hashes of these runs,
   and ranges answer with those that start more than once.
3. Each chunk removes the words that such runs cover; overlapping runs join
   into maximal exact repeats.

A chunk sends a hash once, however often it holds it, so that a passage that
a third of all documents share costs a few bytes per chunk. Texts are dealt
once; all three steps read the same exchange. Defined results: null and empty
texts have no words; texts of fewer words than the window keep all; repeated
rows repeat all their passages; ids may repeat or be null; an empty table gives
no rows; a very long text is one member of its chunk, hashed a block at a time;
other columns are ignored. A 64-bit hash stands for a run of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import words
from answerscope.llm.common import whole_text

WINDOW, BLOCK = 35, 18
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 12 << 20
U = np.uint64
#: Low bits of an anchor message: the window is a reference block; the chunk holds it more than once.
IS_BLOCK, IS_TWICE = 2, 1
#: Bits of a hash in step 1, a filter only: step 2 compares all 64.
BITS = 46


def valid_starts(w: words.Words, width: int) -> np.ndarray:
    """Of each rolling window over all words, whether it lies within one document."""
    n = max(len(w.hash) - width + 1, 0)
    last = np.repeat(w.first[1:], np.diff(w.first))  # of each word, the end of its document
    return last[:n] - np.arange(n) >= width


def anchor_codes(w: words.Words, block: int) -> np.ndarray:
    return words.rolling(w.hash, block) >> U(64 - BITS)


def pack(codes: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit steps, or as they are if a step is larger."""
    if not len(codes):
        return b""
    steps = np.diff(codes, prepend=codes[:1])
    if steps.max() < 1 << 32:
        return b"s" + codes[:1].astype("<u8").tobytes() + steps[1:].astype("<u4").tobytes()
    return b"w" + codes.astype("<u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, dtype=U)
    if raw[:1] == b"w":
        return np.frombuffer(raw, dtype="<u8", offset=1)
    first = np.frombuffer(raw[1:9], dtype="<u8")
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, dtype="<u4", offset=9).astype(U))])


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and whether each occurs more than once."""
    codes = np.sort(codes)
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.append(at, len(codes))) > 1


def windows_message(w: words.Words, block: int) -> np.ndarray:
    """Distinct window codes with their marks in the two low bits."""
    codes, inside = anchor_codes(w, block), valid_starts(w, block)
    place = np.arange(len(codes)) - np.repeat(w.first[:-1], np.diff(w.first))[: len(codes)]
    found, twice = distinct(codes[inside])
    reference = np.isin(found, codes[inside & (place % block == 0)])
    return (found << U(2)) | (reference.astype(U) << U(1)) | twice.astype(U)


def candidates(w: words.Words, anchors: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts of the runs of ``window`` words that hold a hit."""
    n = max(len(w.hash) - window + 1, 0)
    if not n or not len(anchors):
        return np.empty(0, dtype=np.int64)
    codes = anchor_codes(w, block)
    hit = np.isin(codes, anchors) & valid_starts(w, block)
    count = np.concatenate([[0], np.cumsum(hit)])
    reach = window - block + 1
    has = (count[reach : reach + n] - count[:n]) > 0
    return np.flatnonzero(has & valid_starts(w, window))


def covered(w: words.Words, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(w.hash)), -1)
    return np.cumsum(edge[:-1]) > 0


def kept_texts(w: words.Words, gone: np.ndarray) -> list[bytes]:
    """Of each document, its kept words joined by one space."""
    keep = ~gone
    length = (w.end - w.start)[keep] + 1
    total = int(length.sum())
    # bytes of the kept words, each with the white space byte after it, which becomes a space
    offset = np.cumsum(length) - length
    source = np.repeat(w.start[keep] - offset, length) + np.arange(total)
    out = w.data[source]
    out[offset + length - 1] = 0x20
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(keep)])[w.first]]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sliced(frame: pd.DataFrame) -> words.Words:
    return words.split(frame["text"].tolist())


def messages(w: words.Words, chunk: int, codes: np.ndarray, ranges: int, bits: int) -> pd.DataFrame:
    """Sorted codes cut into ``ranges`` equal ranges of the ``bits``-bit numbers."""
    width = (((1 << bits) + ranges - 1) // ranges + 3) // 4 * 4  # marks never part equal codes
    cuts = np.searchsorted(codes, np.array([min(i * width, (1 << bits) - 1) for i in range(1, ranges)], dtype=U))
    parts = np.split(codes, cuts)
    return pd.DataFrame([(r, chunk, pack(p)) for r, p in enumerate(parts) if len(p)], columns=["range", "chunk", "codes"])


def answers(group: pd.DataFrame, marks: bool) -> pd.DataFrame:
    """For each chunk, those of its codes that occur elsewhere too (and are a reference block, if ``marks``)."""
    lists = [unpack(r) for r in group["codes"]]
    every = np.concatenate(lists)
    flags = every & U(3 if marks else 1)
    plain = every >> U(2 if marks else 1)
    order = np.argsort(plain, kind="stable")
    ordered, own = plain[order], flags[order].astype(np.uint8)
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    several = (np.diff(np.append(at, len(ordered))) > 1) | ((np.bitwise_or.reduceat(own, at) & IS_TWICE) > 0)
    if marks:
        several &= (np.bitwise_or.reduceat(own, at) & IS_BLOCK) > 0
    # back to the order of the lists, so that no chunk has to search the hot codes of all
    hot = np.empty(len(plain), dtype=bool)
    hot[order] = np.repeat(several, np.diff(np.append(at, len(ordered))))
    out, ends = [], np.cumsum([len(codes) for codes in lists])
    for chunk, end, codes in zip(group["chunk"], ends.tolist(), lists, strict=True):
        mine = plain[end - len(codes) : end][hot[end - len(codes) : end]]
        if len(mine):
            out.append((chunk, pack(mine)))
    return pd.DataFrame(out, columns=["chunk", "codes"])


def gathered(frame: pd.DataFrame) -> np.ndarray:
    return np.sort(np.concatenate([unpack(r) for r in frame["codes"]])) if len(frame) else np.empty(0, dtype=U)


def run_codes(w: words.Words, starts: np.ndarray, window: int) -> np.ndarray:
    """63 bits of the hash of each run, so that one bit is left for a mark."""
    return words.rolling(w.hash, window)[starts] >> U(1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunks: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept (bytes: the kept words joined by one space)."""
    block = (window + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    if chunks is None:
        size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        chunks = max(1, int(size // CHUNK_BYTES) + 1)
    n = F.lit(chunks)
    # repeated rows and null ids are spread by the text as well
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), n).cast("int"))
    ranges = chunks

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        w = sliced(frame)
        return messages(w, int(frame["chunk"].iloc[0]), windows_message(w, block), ranges, BITS + 2)

    def extend(key, frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["range", "chunk", "codes"])
        w = sliced(frame)
        codes, twice = distinct(run_codes(w, candidates(w, gathered(found), window, block), window))
        # the mark of a repeat within the chunk takes the lowest bit
        return messages(w, int(key[0]), (codes << U(1)) | twice.astype(U), ranges, 64)

    def cut(key, frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept"])
        w = sliced(frame)
        hot = gathered(found)
        n_runs = max(len(w.hash) - window + 1, 0)
        starts = np.flatnonzero(valid_starts(w, window) & np.isin(run_codes(w, slice(None), window), hot)) if n_runs and len(hot) else np.empty(0, dtype=np.int64)
        gone = covered(w, starts, window)
        removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
        return pd.DataFrame({"doc_id": frame["doc_id"].array, "n_words": np.diff(w.first), "n_removed": np.diff(removed), "kept": kept_texts(w, gone)})

    sent, answered = "range int, chunk int, codes binary", "chunk int, codes binary"
    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInPandas(send, sent).groupBy("range").applyInPandas(lambda g: answers(g, True), answered)
    runs = by_chunk.cogroup(anchors.groupBy("chunk")).applyInPandas(extend, sent)
    repeats = runs.groupBy("range").applyInPandas(lambda g: answers(g, False), answered)
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInPandas(cut, "doc_id long, n_words long, n_removed long, kept binary")
