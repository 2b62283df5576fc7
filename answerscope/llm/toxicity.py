"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings sums, over all three-letter subsequences they share,
a decay to the power of the spans these take up in both (Lodhi et al., 2002),
divided by the strings' norms. A letter put in between or left out only makes
spans longer, so "id-i-ot" or "idioot" stay close to "idiot". Letters of all
scripts count, accents and all; "^" marks a word's start.

Training: sentences of labelled documents carry the document's label, and
their segments (words, windows of overlong words, parts of hyphenated ones)
are the instances. Segments with the greatest excess in toxic documents (a
likelihood ratio) become landmarks, next to common ones; the kernel against
them, whitened by the landmarks' own kernel matrix (Nyström), feeds a linear
machine with squared hinge. Only a few segments of a toxic sentence make it
toxic, so training repeats: one half's machine judges the other half's
segments, and a toxic sentence's segment counts as a positive by the share of
such segments, at its margin, that clean sentences don't explain (an expected
label, cross-fitted), or if it is itself in too many toxic documents for
chance. Thereby a stem that turns up with a hundred endings is learnt in any
language, as are words that stand alone.

A document's evidence pools all its segments: the log-likelihood ratio of a
segment's margin among toxic and clean documents, measured on folds that the
machine was not fitted on, added up over distinct segments. So one chance hit
in a long text weighs little, and several weigh much. A logistic curve, also
fitted on folds, turns it into a score.
Neighbouring short tokens are joined ("id iot", "i d i o t") and count as far
as clean documents don't hold joined ones of their margin.

Scoring: landmarks, whitening and weights collapse into one weight for each
subsequence, so that a segment costs its own subsequences alone, computed for
all distinct segments of a batch at once.

The fit reads at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents of at
most ``MAX_CHARS`` letters, taken by hash; everything else covers all rows and
whole texts. Defined results: a null or empty text has no segments and gets
the score of no evidence; an empty table gives no rows; equal texts get equal
scores, whatever their ids, and repeated rows are scored row by row; of
contradicting labels of one id toxic wins, of several texts the least is
taken; a very long text costs time in proportion and no more memory than its
distinct words; without labels of both kinds every score is the share of toxic
labels (0 without any); other columns are kept, but margin and score replaced.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import fsum
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerscope.llm.common import release, whole_text

DECAY, SPAN = 0.7, 9
#: Letters of a segment; longer words are scored in overlapping windows.
LONGEST, STRIDE = 14, 6
AROUND = ".,;:!?*#\"'()[]{}<>|-_~%&$+="
#: Tokens of at most this many letters join with their neighbours of that kind.
SHORT = 2
#: Letters at most of each of two, and of each of three neighbouring tokens that are joined.
PART_OF_2, PART_OF_3 = 4, 3
#: Signs of a string: a to z, a gap, the start of a word, and other letters by their code point.
GAP, START, OTHER, SIGNS = 26, 27, 28, 48
SENTENCE = re.compile(r"[.!?\n]+\s+|\n+")
#: Digits and signs that stand in for letters.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
#: Tokens that a task remembers the evidence of; a bound on memory only.
CACHE = 250_000
#: Bounds of the fit: labelled documents of each kind, their letters, and landmarks (two thirds of them by excess).
MAX_TOXIC, MAX_CLEAN, MAX_CHARS, LANDMARKS = 700, 1500, 60_000, 240
#: Rounds of expected labels, folds, and the least share that makes a segment a positive.
ROUNDS, FOLDS, LEAST_SHARE = 2, 4, 0.3
#: Likelihood ratio by documents (chi-squared with one degree of freedom) that one segment in a hundred thousand
#: reaches by chance, and the share that must be left of it.
CERTAIN, SURE_SHARE = 20.0, 0.9
#: Steps of the margin in which log-likelihood ratios are measured.
GRID = np.arange(-1.5, 2.0, 0.05)
CODES = np.full(128, GAP, dtype=np.int32)
CODES[97:123], CODES[94] = np.arange(26), START


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def normal(token: str) -> str:
    """Lower-case letters, '#' for anything between them; '' without a letter."""
    token = token.lower().strip(AROUND)
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
    if token.isalpha():
        return token
    if not any(c.isalpha() for c in token):
        return ""
    return "".join(c if c.isalpha() else "#" for c in token.translate(LOOKS)).strip("#")


def windows(word: str) -> list[str]:
    word = "^" + word
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STRIDE, STRIDE)]


def of_token(token: str) -> tuple[str, ...]:
    word = normal(token)
    parts = [p for p in token.lower().split("-") if p] if "-" in token[1:-1] else []
    more = [normal(p) for p in parts] if len(parts) > 1 else []
    if "#" in word:
        more.append(word.replace("#", ""))
    return tuple({s: None for w in (word, *more) if len(w) > 2 for s in windows(w)})


def joined_runs(tokens: list[str]) -> set[str]:
    """Segments of runs of three or more very short tokens."""
    out: set[str] = set()
    if b"\1\1\1" not in bytes([len(t) <= SHORT + 1 for t in tokens]):
        return out
    run: list[str] = []
    for token in [*tokens, "-" * 9]:
        if len(token) <= SHORT or (len(token) == SHORT + 1 and not token.isalnum()):
            run.append(token)
            continue
        if len(run) > 2:
            joined = "".join(p for p in map(normal, run) if p).replace("#", "")
            if len(joined) > 2:
                out.update(windows(joined))
        run = []
    return out


@lru_cache(maxsize=100_000)
def part(token: str) -> str:
    """The letters of a token that may be part of a gapped word; '.' after them ends a sentence; '' if it is too long."""
    if len(token) > PART_OF_2 + 3:
        return ""
    word = normal(token)
    return word + "." * (token[-1] in ".!?") if word.isalpha() and len(word) <= PART_OF_2 else ""


def joined_neighbours(tokens: list[str]) -> set[str]:
    """Segments of two or three short tokens of a sentence, in a row."""
    parts = list(map(part, tokens))
    two = [a + b if a and b and a[-1] != "." else "" for a, b in zip(parts, parts[1:], strict=False)]
    out = set(two)
    out.update(x + c for x, a, b, c in zip(two, parts, parts[1:], parts[2:], strict=False) if x and c and x[-1] != "." and len(a) <= PART_OF_3 and len(b) <= PART_OF_3 and len(c.rstrip(".")) <= PART_OF_3)
    return {w for x in out if len(w := x.rstrip(".")) > 3}


def segments(text: str) -> set[str]:
    """The distinct segments of a text's tokens."""
    return set().union(*map(of_token, set(text.split())))


def joined(tokens: list[str]) -> set[str]:
    """Segments of joined neighbours and runs."""
    return joined_runs(tokens).union("^" + x for x in joined_neighbours(tokens))


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n signs, spans of more than SPAN left out, and the decayed weight of their span."""
    at = np.array([t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN], dtype=np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def codes(strings: list[str], n: int) -> np.ndarray:
    raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n)
    return np.where(raw < 128, CODES[np.minimum(raw, 127)], OTHER + raw % (SIGNS - OTHER)).astype(np.int32)


def features(strings: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of one length: subsequence numbers, weights (0 with a gap sign), and norms."""
    at, weight = triples(n)
    c = codes(strings, n)
    a, b, d = c[:, at[:, 0]], c[:, at[:, 1]], c[:, at[:, 2]]
    number = (a * SIGNS + b) * SIGNS + d
    w = np.where((a == GAP) | (b == GAP) | (d == GAP), 0.0, weight)
    order = np.argsort(number, axis=1)
    number, w = np.take_along_axis(number, order, 1), np.take_along_axis(w, order, 1)
    # equal subsequences of one string add up before they are squared
    total = np.cumsum(w, axis=1)
    last = np.ones_like(number, dtype=bool)
    last[:, :-1] = number[:, 1:] != number[:, :-1]
    upto = np.where(last, total, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(strings), 1)), upto[:, :-1]], 1), axis=1)
    norm = np.sqrt((np.where(last, total - before, 0.0) ** 2).sum(1))
    return number, w, np.maximum(norm, 1e-12)


def by_length(strings: list[str], most: int):
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        groups.setdefault(len(s), []).append(i)
    for n, rows in sorted(groups.items()):
        for at in range(0, len(rows) if n > 2 else 0, most):
            yield n, rows[at : at + most]


def project(strings: list[str], weights: np.ndarray) -> np.ndarray:
    """<weights, features of each string> / norm; ``weights`` is (SIGNS^3,), or (SIGNS^3, m) for single-precision rows of m."""
    one = weights.ndim == 1
    out = np.zeros((len(strings), *weights.shape[1:]), dtype=weights.dtype)
    for n, rows in by_length(strings, 1000 if one else 250):
        number, w, norm = features([strings[i] for i in rows], n)
        picked = weights[number]
        summed = np.einsum("ij,ij->i", picked, w) if one else np.einsum("ijm,ij->im", picked, w.astype(weights.dtype))
        out[rows] = (summed.T / norm).T
    return out


def dense(string: str) -> np.ndarray:
    number, w, norm = features([string], len(string))
    out = np.zeros(SIGNS**3)
    np.add.at(out, number[0], w[0])
    return out / norm[0]


@dataclass
class Model:
    weights: np.ndarray  # one for each subsequence of three signs
    intercept: float
    ratio: np.ndarray  # log-likelihood ratio of a segment, by step of the margin
    joined_ratio: np.ndarray  # that of joined neighbours
    plain: frozenset  # joined neighbours that clean documents hold: no evidence
    slope: float
    shift: float

    def margins(self, strings: list[str]) -> np.ndarray:
        return project(strings, self.weights) + self.intercept

    def of_segments(self, strings: list[str], together: bool = False) -> np.ndarray:
        """The evidence of each segment."""
        found = (self.joined_ratio if together else self.ratio)[np.digitize(self.margins(strings), GRID)]
        return np.where([s in self.plain for s in strings], 0.0, found) if together and strings else found

    def of_tokens(self, tokens: list[str]) -> list[float]:
        """The evidence of each token: that of its segments, added up."""
        found = list(map(of_token, tokens))
        place = {x: i for i, x in enumerate({x for f in found for x in f})}
        each = self.of_segments(list(place)) if place else np.zeros(0)
        owner = np.repeat(np.arange(len(tokens)), [len(f) for f in found])
        return np.bincount(owner, each[[place[x] for f in found for x in f]], len(tokens)).tolist() if place else [0.0] * len(tokens)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


class Evidence:
    """Evidence of texts, by the model; what a task knows of tokens is bounded by CACHE."""

    def __init__(self, model: Model):
        self.model, self.known, self.pairs = model, {}, {}

    def _learn(self, known: dict[str, float], needed: set[str], make) -> dict[str, float]:
        new = needed.difference(known)
        if len(known) + len(new) > CACHE:
            known = {x: known[x] for x in needed if x in known}
        new = list(new)
        known.update(zip(new, make(new), strict=True))
        return known

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        split = [t.split() for t in texts]
        tokens, pairs = [set(s) for s in split], [joined(s) for s in split]
        self.known = self._learn(self.known, set().union(*tokens), self.model.of_tokens)
        self.pairs = self._learn(self.pairs, set().union(*pairs), lambda new: self.model.of_segments(new, True).tolist() if new else [])
        for i, (own, others) in enumerate(zip(tokens, pairs, strict=True)):
            # exact sums, so that equal texts have equal ones whatever the order
            out[i] = fsum(map(self.known.__getitem__, own)) + fsum(map(self.pairs.__getitem__, others))
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift; the rarer label weighs half-way to the same. Newton steps, halved until the loss falls."""
    weight = np.where(y == 1, ((1 - y).sum() / y.sum()) ** 0.5, 1.0)
    centre, scale = x.mean(), x.std() + 1e-9
    z, sign = (x - centre) / scale, 2 * y - 1
    now = np.array([1.0, 0.0])

    def loss(p: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (p[0] * z + p[1]))).sum() + 0.005 * p[0] ** 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(now[0] * z + now[1], -30, 30)))
        pull, q = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(pull * z).sum() + 0.01 * now[0], pull.sum()])
        step, t = np.linalg.solve([[(q * z * z).sum() + 0.01, (q * z).sum()], [(q * z).sum(), q.sum()]], g), 1.0
        while t > 1e-3 and loss(now - t * step) > loss(now):
            t /= 2
        now = now - t * step
    slope = max(now[0] / scale, 1e-3)
    return float(slope), float(now[1] - slope * centre)


def svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, l2: float = 2e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge machine; row i has weight ``toxic[i]`` as a positive and ``clean[i]`` as a negative. Newton steps with halving."""
    m = x.shape[1]
    toxic, clean = toxic / max(toxic.sum(), 1e-12), clean / max(clean.sum(), 1e-12)
    ridge = l2 * np.eye(m + 1)
    ridge[-1, -1] = 1e-9
    w, out = np.zeros(m + 1), np.zeros(len(x))

    def loss(out: np.ndarray, w: np.ndarray) -> float:
        return float(toxic @ np.maximum(0, 1 - out) ** 2 + clean @ np.maximum(0, 1 + out) ** 2 + w @ ridge @ w)

    best = loss(out, w)
    for _ in range(steps):
        up, down = np.where(out < 1, toxic, 0.0), np.where(out > -1, clean, 0.0)
        rows = np.flatnonzero(up + down)
        a, g = ridge.copy(), np.zeros(m + 1)
        for at in range(0, len(rows), 20_000):
            i = rows[at : at + 20_000]
            part = np.concatenate([x[i], np.ones((len(i), 1), x.dtype)], axis=1)
            a += (part * (up + down)[i, None].astype(x.dtype)).T @ part
            g += part.T @ (up - down)[i]
        goal = np.linalg.solve(a, g)
        ahead, t = x @ goal[:-1].astype(x.dtype) + goal[-1], 1.0
        while t > 1e-3 and loss(out + t * (ahead - out), w + t * (goal - w)) >= best:
            t /= 2
        w, out = w + t * (goal - w), out + t * (ahead - out)
        before, best = best, loss(out, w)
        if before - best < 1e-6 * before:
            break
    return w[:-1], float(w[-1])


def excess(k1: np.ndarray, k0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood ratio of being in ``k1`` of ``n1`` toxic and ``k0`` of ``n0`` clean ones; 0 if no commoner in toxic ones."""
    share = (k1 + k0) / (n1 + n0)
    some = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-12)), 0.0)
    return np.where(k1 * n0 > k0 * n1, 2 * (some(k1, n1 * share) + some(k0, n0 * share) + some(n1 - k1, n1 * (1 - share)) + some(n0 - k0, n0 * (1 - share))), 0.0)


def sure(k1: np.ndarray, k0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The share of those in ``k1`` of ``n1`` toxic documents that clean ones don't explain; 0 where that is not certain."""
    left = 1 - k0 / max(n0, 1) / np.maximum(k1 / max(n1, 1), 1e-12)
    return np.where((excess(k1, k0, n1, n0) > CERTAIN) & (left >= SURE_SHARE), left, 0.0)


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest sequence that never falls: neighbours that do are averaged."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            pools[-1] = [(last[0] * last[1] + v * w) / (last[1] + w), last[1] + w, last[2] + n]
    return np.concatenate([[v] * int(n) for v, _, n in pools])


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_clean: float | None = None) -> np.ndarray:
    """By step of the margin, the log ratio of the shares of toxic and clean segments; never falling. ``n_clean``: all clean ones, if not these."""
    n = len(toxic)
    p1, p0 = (toxic + 0.5) / (toxic.sum() + 0.5 * n), (clean + 0.5) / ((clean.sum() if n_clean is None else n_clean) + 0.5 * n)
    return rising(np.log(p1 / p0), toxic / max(toxic.sum(), 1) + clean / max(clean.sum(), 1) + 1e-7)


def without_copies(texts: list[str], alike: float = 0.5, size: int = 5, probes: int = 8) -> list[int]:
    """The texts that are no near copy of one before, by their word shingles; copies would pass for evidence."""
    times = np.random.default_rng(1).integers(1, 1 << 62, probes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    met: dict[tuple[int, int], list[int]] = {}
    kept: dict[int, set[int]] = {}
    for d, text in enumerate(texts):
        words = text.split()
        own = {crc32(" ".join(words[i : i + size]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - size + 1))}
        least = (np.fromiter(own, np.uint64, len(own))[:, None] * times).min(0)
        keys = list(enumerate(least.tolist()))
        if not any(len(own & kept[other]) > alike * len(own | kept[other]) for other in {x for k in keys for x in met.get(k, ())}):
            kept[d] = own
            for k in keys:
                met.setdefault(k, []).append(d)
    return list(kept)


class Trainer:
    """The instances of labelled texts, in folds, and machines fitted on some of the folds."""

    def __init__(self, texts: list[str], toxic: list[int], landmarks: int):
        self.texts, self.y = texts, np.array(toxic)
        # equal texts are in one fold; labels are dealt evenly
        order = sorted(range(len(texts)), key=lambda d: (toxic[d], crc32(texts[d].encode("utf-8", "surrogatepass")), texts[d]))
        self.fold, at = np.zeros(len(texts), dtype=int), -1
        for i, d in enumerate(order):
            at += i == 0 or texts[d] != texts[order[i - 1]]
            self.fold[d] = at % FOLDS
        counts = [[Counter(), Counter()] for _ in range(FOLDS)]
        documents = [[Counter(), Counter()] for _ in range(FOLDS)]
        for d, text in enumerate(texts):
            own: set[str] = set()
            for sentence in SENTENCE.split(text):
                found = segments(sentence)
                counts[self.fold[d]][toxic[d]].update(found)
                own |= found
            documents[self.fold[d]][toxic[d]].update(own)
        # joined neighbours that are certain by themselves are instances as well, such as abuse made of short words
        self.pairs = [sorted(joined(text.split())) for text in texts]
        met = [[Counter(), Counter()] for _ in range(FOLDS)]
        for d, found in enumerate(self.pairs):
            met[self.fold[d]][toxic[d]].update(found)
        in_toxic = sum((pair[1] for pair in met), Counter())
        often = [x for x, n in in_toxic.items() if n > 3]
        k1, k0 = np.array([in_toxic[x] for x in often], dtype=float), np.array([sum(pair[0][x] for pair in met) for x in often], dtype=float)
        for x in np.array(often, dtype=object)[sure(k1, k0, float(self.y.sum()), float((1 - self.y).sum())) > 0]:
            for fold, pair in enumerate(met):
                for label in (0, 1):
                    counts[fold][label][x] += pair[label][x]
                    documents[fold][label][x] += pair[label][x]
        self.names = sorted(set().union(*(c.keys() for pair in documents for c in pair)))
        self.place = {s: i for i, s in enumerate(self.names)}
        table = lambda counters: np.array([[[c[label][s] for s in self.names] for label in (0, 1)] for c in counters], dtype=float)
        self.counts, self.documents = table(counts), table(documents)  # fold, label, segment
        k0, k1 = self.documents.sum(0)
        by_excess = np.argsort(-excess(k1, k0, float(self.y.sum()), float((1 - self.y).sum())), kind="stable")[: landmarks * 2 // 3]
        by_count = np.argsort(-k0, kind="stable")[: landmarks - landmarks * 2 // 3]
        marks = sorted({*by_excess.tolist(), *by_count.tolist()})
        basis = np.empty((SIGNS**3, len(marks)), dtype=np.float32)
        for column, i in enumerate(marks):
            basis[:, column] = dense(self.names[i])
        values, vectors = np.linalg.eigh((basis.T @ basis).astype(float))
        keep = values > 1e-5
        self.whiten = basis @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # subsequence space -> Nyström features
        del basis
        self.x = project(self.names, self.whiten)

    def machine(self, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        w, b = svm(self.x, toxic, clean)
        return w, b, self.x @ w.astype(np.float32) + b

    def fit(self, folds: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights, intercept and all segments' margins, from some folds, by expected labels."""
        halves = [self.counts[folds[: len(folds) // 2]].sum(0), self.counts[folds[len(folds) // 2 :]].sum(0)]
        clean, toxic = halves[0] + halves[1]
        k0, k1 = self.documents[folds].sum(0)
        n1, n0 = (max(float((np.isin(self.fold, folds) & (self.y == label)).sum()), 1.0) for label in (1, 0))
        certain = sure(k1, k0, n1, n0)
        share = np.ones(len(self.names))
        for _ in range(ROUNDS + 1):
            judged = np.zeros(len(self.names))
            for own, other in (halves, halves[::-1]):
                _, _, margin = self.machine(own[1] * share, own[0])
                step = np.digitize(margin, GRID)
                n = len(GRID) + 1
                left = 1 - np.exp(-log_ratio(np.bincount(step, other[1], n), np.bincount(step, other[0], n)))[step]
                judged += np.where(left >= LEAST_SHARE, left, 0.0) / 2
            share = np.maximum(judged, certain)
            if not (share * toxic).any():
                return np.zeros(self.x.shape[1]), 0.0, np.zeros(len(self.names))
        return self.machine(toxic * share, clean)


def histogram(margins: np.ndarray) -> np.ndarray:
    return np.bincount(np.digitize(margins, GRID), minlength=len(GRID) + 1).astype(float)


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled texts; their sentences inherit the label."""
    once = without_copies(texts)
    texts, toxic = [texts[d] for d in once], [toxic[d] for d in once]
    y = np.array(toxic)
    flat = np.zeros(len(GRID) + 1)
    share = float(y.mean()) if len(y) else 0.0
    none = Model(np.zeros(SIGNS**3), 0.0, flat, flat, frozenset(), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not len(y) or y.min() == y.max() or not any(map(segments, texts)):
        return none
    t = Trainer(texts, toxic, landmarks)
    # margins of each document's segments, by machines that never saw it
    single, together = np.zeros((len(texts), len(GRID) + 1)), np.zeros((len(texts), len(GRID) + 1))
    pairs = t.pairs
    clean_pairs = [{x for d in np.flatnonzero((t.fold == fold) & (y == 0)) for x in pairs[d]} for fold in range(FOLDS)]
    for fold in range(FOLDS):
        elsewhere = set().union(*(clean_pairs[f] for f in range(FOLDS) if f != fold))
        w, b, margin = t.fit([f for f in range(FOLDS) if f != fold])
        away = Model((t.whiten @ w.astype(np.float32)).astype(float), b, flat, flat, frozenset(), 0.0, 0.0)
        for d in np.flatnonzero(t.fold == fold):
            single[d] = histogram(margin[[t.place[s] for s in segments(texts[d])]])
            together[d] = histogram(away.margins([x for x in pairs[d] if x not in elsewhere]))

    def ratios(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        toxic_sum, clean_sum = single[rows & (y == 1)].sum(0), single[rows & (y == 0)].sum(0)
        # as if gaps were as common as plain writing; clean joined neighbours speak against them
        joint = log_ratio(toxic_sum, together[rows & (y == 0)].sum(0) + clean_sum, clean_sum.sum())
        return log_ratio(toxic_sum, clean_sum), np.maximum(0.0, joint)

    evidence = np.zeros(len(texts))
    for fold in range(FOLDS):
        alone, joint = ratios(t.fold != fold)
        mine = t.fold == fold
        evidence[mine] = single[mine] @ alone + together[mine] @ joint
    w, b, _ = t.fit(list(range(FOLDS)))
    alone, joint = ratios(np.ones(len(y), dtype=bool))
    slope, shift = logistic(np.clip(evidence, -30, 30), y)
    model = Model((t.whiten @ w.astype(np.float32)).astype(float), b, alone, joint, frozenset(), slope, shift)
    # only those that would be evidence need to be known
    every = sorted(set().union(*clean_pairs))
    model.plain = frozenset(x for x, e in zip(every, model.of_segments(every, True).tolist(), strict=True) if e > 0)
    return model


def labelled(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> DataFrame:
    """A bounded sample, by hash, of the labelled documents that are not held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit("fit")), F.col("doc_id")]
    some = rows.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean small rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, fitted in one task on the bounded sample; only the model itself comes to the driver."""

    def run(batches):
        rows = sorted((r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    sample = labelled(docs, labels).select("doc_id", "text", "toxic")
    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with margin (its evidence) and score; columns of these names are replaced."""
    spark, docs = docs.sparkSession, docs.drop("margin", "score")
    shared = spark.sparkContext.broadcast(model)  # SIGNS^3 weights whatever the input

    schema = [*docs.schema.fields]
    out = T.StructType([*schema, T.StructField("margin", T.DoubleType()), T.StructField("score", T.DoubleType())])
    place = [f.name for f in schema].index("text")

    def run(batches):
        evidence = Evidence(shared.value)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            each = np.concatenate([evidence.of([t or "" for t in texts[at : at + 500]]) for at in range(0, len(texts), 500)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each), pa.array(shared.value.score(np.clip(each, -30, 30)))], names=[*[f.name for f in schema], "margin", "score"])
        del evidence
        part.cache_clear()
        release()

    return docs.mapInArrow(run, out)
