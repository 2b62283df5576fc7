"""Vectorised word hashes for batches of texts.

A word's hash is a polynomial in its bytes, modulo 2^64, taken from prefix
sums over the whole batch, so that no Python code runs for single words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes, or hashes, that are worked on at a time, which bounds the tables and the memory of a worker.
BLOCK = 1 << 17
UP, DOWN = powers(BASE, 2 * BLOCK), powers(INVERSE, 2 * BLOCK)


def whole(hashes: np.ndarray) -> np.ndarray:
    """Hash of all numbers in turn, as one-element array; equal to that of a run of this length."""
    total = 0
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        total += int((part * UP[: len(part)]).sum(dtype=U)) * pow(BASE, at, 1 << 64)
    return np.array([total % (1 << 64)], dtype=U)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, each followed by a line feed
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end


def split(texts: list[bytes | None], lower: bool = False) -> Words:
    """Words of all texts; a null text has none."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    limits = np.concatenate([[0], np.cumsum(lengths)])
    inside = ~SPACES[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is a line feed, so that every word ends
    word = np.empty(len(start), dtype=U)
    long = np.flatnonzero(end - start > BLOCK)
    # a block holds the words that start in it and end before it does or in the next one
    cuts = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), BLOCK)), long, long + 1, [0, len(start)]]))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lo, hi = int(start[i]), int(end[j - 1])
        part = LOWER[data[lo:hi]] if lower else data[lo:hi]
        if hi - lo > 2 * BLOCK:  # one overlong word
            word[i:j] = mix(whole(part) + U(hi - lo))
            continue
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(part * UP[: len(part)], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        word[i:j] = mix((sums[e] - sums[s]) * DOWN[s] + (e - s).astype(U))
    return Words(data, start, end, word, np.searchsorted(start, limits))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` (at most BLOCK) hashes, by prefix sums; empty if there are fewer."""
    n = max(len(hashes) - width + 1, 0)
    out = np.empty(n, dtype=U)
    for at in range(0, n, BLOCK):
        part = hashes[at : min(at + BLOCK, n) + width - 1]
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(part * UP[: len(part)], out=sums[1:])
        out[at : at + BLOCK] = mix((sums[width:] - sums[:-width]) * DOWN[: len(part) - width + 1])
    return out
