"""Toxicity: a support vector machine on sentences, by a gap-weighted subsequence kernel with Nystroem landmarks.

A text is cut into sentences and these into windows: words (lower case, without marks), overlapping
parts of long ones, and runs of short fragments read together, so that spelled-out and broken words
are seen whole. The kernel of two sentences sums, over pairs of their windows, a power of the
windows' normalised kernel of common subsequences of three bytes, each weighed down by its gaps, so
that inserted letters still score. Landmarks are windows of labelled sentences of both classes; the
inverse root of their own kernel maps a sentence to the features of a linear machine. It is trained
on sentences: those of clean documents are clean, and of each toxic one the worst and others that the
last round found toxic and at least half as bad are toxic; the first round goes by the log odds of each sentence's strongest window. As the map is linear, a window has one share in any sentence's decision, which
workers remember. A document's worst sentence, and the sum and density of what its sentences exceed
the margin by, are calibrated to a probability.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_fold, small_batches
from .labelled import labelled_sample, learnt, sigmoid

#: Length of the subsequences, weight of a step, power of the normalised kernel, least normalised kernel that counts, bytes of a part of a long word, and its step.
ORDER, DECAY, POWER, FLOOR, WINDOW, STRIDE = 3, 0.7, 2, 0.35, 12, 6
#: Labelled documents of either class; windows that a worker remembers; longest fragment that is read together with its neighbours.
SAMPLE, MEMO, FRAGMENT = 2500, 300_000, 3
#: Documents of its class and standard errors that a landmark needs (4 documents where classes are equal in number, whatever that is); kernel from which a candidate adds nothing to a chosen one; most landmarks of toxic and of clean sentences; shortest start of words.
LEAST, SURE, ALIKE, LANDMARKS, CLEAN, START = 3, 2.0, 0.9, 400, 96, 5
#: Rounds of choosing sentences anew, most of a toxic document and the share of its worst one's decision that they need, those of a clean one that a round adds, penalty of the weights.
ROUNDS, WORST, NEAR, HARD, PENALTY = 4, 6, 0.5, 2, 1e-4
#: How far below the margin a sentence counts; documents added to either class's count of a landmark, as shares alike, in its first weight.
SLACK, PRIOR = 0.25, 2
#: Toxic documents below which the penalty grows as they get fewer.
ENOUGH = 250
SEED = 5

SPACE = b"\t\n\v\f\r "
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Words, windows, sentences and texts to learn from that are worked on at once: their tables fit a core's cache, and a worker's memory.
WORDS, ROWS, SENTENCES, TEXTS = 2000, 128, 2000, 250
#: Bytes that are dropped from words, the token that ends a sentence, and the sign before fragments read together.
STOP, JOINED = b"\1", b"+"
MARKS = bytes(b for b in range(128) if not LETTER[b] and b not in SPACE + STOP)
SENTENCE = re.compile(rb"[.!?]+(?=\s|$)|\n")
#: A bit for each kind of byte: letters their own, all others share the rest.
BIT = np.array([1 << (b - 97) if 97 <= b < 123 else 1 << (26 + b % 6) if LETTER[b] else 0 for b in range(256)], np.uint32)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of ``ORDER`` between rows of two byte matrices; 0 pads and matches nothing."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    n, la, lb = same.shape
    weight = np.where(same, np.float32(DECAY * DECAY), np.float32(0))
    inner = np.ones((n, la + 1, lb + 1), np.float32)
    for _ in range(ORDER - 1):
        step = weight * inner[:, :-1, :-1]
        for j in range(1, lb):
            step[:, :, j] += DECAY * step[:, :, j - 1]
        inner = np.zeros((n, la + 1, lb + 1), np.float32)
        for i in range(la):
            inner[:, i + 1, 1:] = DECAY * inner[:, i, 1:] + step[:, i]
    return (weight * inner[:, :-1, :-1]).sum((1, 2))


def own_kernel(table: np.ndarray) -> np.ndarray:
    """``kernel`` of each row of a byte matrix without padding with itself; rows come last, so that every step runs over all of them."""
    a = np.ascontiguousarray(table.T)
    n = len(a)
    weight = (a[:, None] == a[None]) * np.float32(DECAY * DECAY)
    inner = np.ones((n + 1, n + 1, a.shape[1]), np.float32)
    for _ in range(ORDER - 1):
        step = weight * inner[:-1, :-1]
        for j in range(1, n):
            step[:, j] += np.float32(DECAY) * step[:, j - 1]
        inner = np.zeros_like(inner)
        for i in range(n):
            inner[i + 1, 1:] = np.float32(DECAY) * inner[i, 1:] + step[i]
    return (weight * inner[:-1, :-1]).sum((0, 1))


def padded(words: list[bytes]) -> np.ndarray:
    """Rows of ``WINDOW`` bytes."""
    return np.frombuffer(b"".join(w[:WINDOW].ljust(WINDOW, b"\0") for w in words), np.uint8).reshape(-1, WINDOW)


def windows(word: bytes) -> list[bytes]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + STRIDE, STRIDE)]


def letters(words: list[bytes]) -> np.ndarray:
    """The kinds of bytes of each word, as bits."""
    length = np.array([len(w) for w in words], np.int64)
    return np.bitwise_or.reduceat(BIT[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(length) - length) if len(words) else np.empty(0, np.uint32)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, and ``STOP`` after each sentence."""
    raw = (text or "").lower().encode(errors="replace").replace(STOP, b"")
    return SENTENCE.sub(b" \1 ", raw).translate(None, MARKS).split()


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a window of ``n`` bytes, a row each, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


class Landmarks:
    """Kernels of windows to the landmarks, of which the first ``toxic`` are of toxic sentences.

    The landmarks' subsequences are a sparse table, so that a window's kernels to all of them are sums
    over the subsequences that it has in common with any.
    """

    def __init__(self, marks: list[bytes], toxic: int):
        self.marks, self.toxic = marks, toxic
        self.letters = letters(marks)
        present = sorted({*b"".join(marks)})
        self.base, self.code = len(present) + 1, np.zeros(256, np.int32)
        self.code[present] = np.arange(1, self.base)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j, m in enumerate(marks):
            at, weight = subsequences(len(m[:WINDOW]))
            key, place = np.unique(self.keys(np.frombuffer(m[:WINDOW], np.uint8)[None], at)[0], return_inverse=True)
            held.append((key, np.full(len(key), j), np.bincount(place, weight, len(key))))
        key, mark, value = (np.concatenate(x) for x in zip(*held, strict=True))
        self.own = np.maximum(np.bincount(mark, value * value, len(marks)), 1e-12)
        order = np.argsort(key, kind="stable")
        distinct, first = np.unique(key[order], return_index=True)
        self.row = np.zeros(self.base**ORDER, np.int32)
        self.row[distinct] = np.arange(1, len(distinct) + 1)
        self.first = np.r_[0, first, len(key)]
        self.many = np.diff(self.first, append=len(key))
        self.mark, self.value = mark[order], value[order]
        # the first three and the last three bytes of the toxic landmarks, numbered from 1
        self.ends = []
        for some in ([m.ljust(3, b"\0")[:3] for m in marks[:toxic]], [m.rjust(3, b"\0")[-3:] for m in marks[:toxic]]):
            key, number = np.unique(self.keys(padded(some), np.arange(3)[None])[:, 0], return_inverse=True)
            table = np.zeros(self.base**ORDER, np.int32)
            table[key] = np.arange(1, len(key) + 1)
            self.ends.append((table, number + 1))
        # a landmark with at most one letter put in between any two of its own
        self.gapped = [re.compile(".?".join(map(re.escape, m.decode(errors="ignore"))).join(("", "") if len(m) > 3 else ("^", "$")), re.DOTALL) for m in marks[:toxic]]

    def keys(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the subsequences of windows of one length; one with a byte that is in no landmark has a number that no landmark's has."""
        codes = self.code[table]
        key = codes[:, at[:, 0]]
        for k in range(1, ORDER):
            key *= self.base
            key += codes[:, at[:, k]]
        return key

    def gram(self) -> np.ndarray:
        """The landmarks' own kernels."""
        n, table = len(self.marks), padded(self.marks)
        parts = [kernel(np.repeat(table[i : i + 1], n, 0), table) for i in range(n)]
        return np.minimum(np.stack(parts) / np.sqrt(np.outer(self.own, self.own)), 1).astype(np.float64) ** POWER

    def inside(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(word, landmark) of the toxic landmarks that longer words hold as a whole, letters put in or not.

        Only words that have the landmark's first three bytes, and its last three, within reach of one another are searched.
        """
        if not (words and self.toxic):
            return []
        length = np.array([len(w) for w in words])
        flat, of = self.code[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), length)
        # a letter put in is one byte, or up to four in words that aren't ASCII alone
        wide = np.array([not w.isascii() for w in words])[of]
        met = [np.zeros((len(words), number.max() + 1), bool) for _, number in self.ends]
        for d, e in product(range(1, 6), repeat=2):
            n = max(len(flat) - d - e, 0)
            at = np.flatnonzero(wide[:n]) if max(d, e) > 2 else None
            one, two, three = (flat[k : k + n] if at is None else flat[at + k] for k in (0, d, d + e))
            key = one * self.base
            key += two
            key *= self.base
            key += three
            for (table, _), held in zip(self.ends, met, strict=True):
                found = table[key]
                some = np.flatnonzero(found > 0)
                place = some if at is None else at[some]
                same = of[place] == of[place + d + e]
                held[of[place[same]], found[some[same]]] = True
        both = met[0][:, self.ends[0][1]] & met[1][:, self.ends[1][1]]
        word, mark = np.divmod(np.flatnonzero(both), self.toxic)
        mask, size = letters(words), np.array([len(m) for m in self.marks[: self.toxic]])
        some = np.flatnonzero((mask[word] & self.letters[mark] == self.letters[mark]) & (length[word] > size[mark]))
        return [(k, m) for k, m in zip(word[some].tolist(), mark[some].tolist(), strict=True) if self.gapped[m].search(words[k].lstrip(JOINED).decode(errors="ignore"))]

    def compare(self, words: list[bytes]) -> np.ndarray:
        """Kernels of words, a row each: of each word's best part; those below ``FLOOR`` count as 0."""
        parts = [(p, k) for k, w in enumerate(words) if not w.startswith(JOINED) for p in windows(w)]
        parts += [(self.marks[m][:WINDOW], k) for k, m in self.inside(words)]
        many = len(self.marks)
        flat = np.zeros(len(words) * many, np.float32)
        by_length: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for p, k in parts:
            by_length[len(p)].append((p, k))
        for n, rows in by_length.items():
            at, weight = subsequences(n)
            weight = weight.astype(float)
            least = float((weight * weight).sum())
            for start in range(0, len(rows) if n >= ORDER else 0, ROWS):
                some = rows[start : start + ROWS]
                table = np.frombuffer(b"".join(p for p, _ in some), np.uint8).reshape(-1, n)
                row = self.row[self.keys(table, at)].ravel()
                hit = np.flatnonzero(row > 0)
                r, (i, c) = row[hit], np.divmod(hit, len(at))
                each = self.many[r]
                entry = spans(self.first[r], each)
                cell = np.repeat(i * many, each)
                cell += self.mark[entry]
                worth = np.repeat(weight[c], each)
                worth *= self.value[entry]
                common = np.bincount(cell, worth, len(some) * many)
                # a window's own kernel is at least that of one without repeated subsequences
                near = np.flatnonzero(common.reshape(-1, many) >= FLOOR * np.sqrt(least * self.own))
                if len(near):
                    i, j = np.divmod(near, many)
                    met, at_met = np.unique(i, return_inverse=True)
                    value = common[near] / np.sqrt(np.maximum(own_kernel(table[met]), 1e-12)[at_met] * self.own[j])
                    some_near = value >= FLOOR
                    np.maximum.at(flat, np.array([k for _, k in some])[i[some_near]] * many + j[some_near], value[some_near].astype(np.float32) ** POWER)
        return flat.reshape(-1, many)


class Lexicon:
    """Numbers of the words that a worker has met, 0 for ``STOP``, with their lengths and letters; ``values`` gives new words' values; ``most`` words are kept, or all for 0."""

    def __init__(self, values, most: int = MEMO):
        self.values, self.most = values, most
        self.clear()

    def clear(self) -> None:
        self.ids, self.length, self.mask, self.value = {STOP: 0}, np.zeros(1, np.int32), np.zeros(1, np.uint32), np.zeros(1, np.float32)

    def learn(self, words) -> None:
        new = sorted(w for w in words if w not in self.ids)
        for w in new:
            self.ids[w] = len(self.ids)
        if new:
            self.length = np.concatenate([self.length, np.array([len(w) for w in new], np.int32)])
            self.mask = np.concatenate([self.mask, letters(new)])
            self.value = np.concatenate([self.value, self.values(new)])

    def read(self, texts: list[str | None], marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, sentence) of every window of some texts, each sentence's text, and the words of each text."""
        if self.most and len(self.ids) > self.most:
            self.clear()
        held = [tokens(t) for t in texts]
        self.learn(set().union(*held))
        for t in held:
            t.append(STOP)
        word = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(held)), np.int32)
        many = np.array([len(t) for t in held], np.int64)
        sentence = np.cumsum(word == 0) - (word == 0)
        of_text = np.repeat(np.arange(len(texts)), many)
        text = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 0, np.int64)
        text[sentence] = of_text
        joined, at = self.fragments(word, held, marks)
        kept = word > 0
        count = np.bincount(of_text[kept], minlength=len(texts))
        return np.concatenate([word[kept], joined]), np.concatenate([sentence[kept], sentence[at]]), text, count

    def fragments(self, word: np.ndarray, held: list[list[bytes]], marks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
        """(word, place) of runs of words (``STOP`` after each text) of at most ``FRAGMENT`` bytes that have all letters of a toxic landmark, read together."""
        none = np.empty(0, np.int32), np.empty(0, np.int64)
        short = (self.length[word] <= FRAGMENT) & (word > 0)
        edge = np.flatnonzero(np.diff(np.r_[False, short, False].astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        some = end - start > 1
        start, end = start[some], end[some]
        if not len(start):
            return none
        mask = np.bitwise_or.reduceat(np.r_[self.mask[word], np.uint32(0)], np.stack([start, end], 1).ravel())[::2]
        fits = np.zeros(len(start), bool)
        for m in range(marks.toxic):
            if len(marks.marks[m]) > FRAGMENT:
                fits |= mask & marks.letters[m] == marks.letters[m]
        start, end = start[fits], end[fits]
        flat = list(chain.from_iterable(held)) if len(start) else []
        runs = [JOINED + b"".join(flat[a:b]) for a, b in zip(start, end, strict=True)]
        self.learn(set(runs))
        return np.fromiter((self.ids[r] for r in runs), np.int32, len(runs)), start


def starts(words: Iterable[bytes]) -> set[bytes]:
    """The words of at least 3 bytes, and their starts of at least ``START``."""
    return {w[:k] for w in words if len(w) > 2 for k in range(min(START, len(w)), len(w) + 1) if k == len(w) or w[k] & 0xC0 != 0x80}


def evidence(toxic_sets: Iterable[set[bytes]], clean_sets: Iterable[set[bytes]]) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Landmarks among the windows of documents of either class: those that stand out in the toxic ones, and of the clean ones the most frequent and the nearest to those.

    A word, or a start of words, stands out if the share of toxic documents that have it exceeds that of clean ones by
    ``SURE`` standard errors; they are taken by that excess, leaving out any whose kernel with a chosen one is ``ALIKE``.
    Also the log odds of each landmark of toxic documents, towards 0 where few documents have it. Nothing that stands out, no landmarks.
    """
    seen, usual, words_of = Counter(), Counter(), Counter()
    n0 = n1 = 1e-9
    for words in toxic_sets:
        seen.update({w[: 2 * WINDOW] for w in starts(words)})
        n1 += 1
    seen = Counter({w: a for w, a in seen.items() if a >= LEAST})
    for words in clean_sets:
        usual.update(w for w in starts(words) if w in seen)
        words_of.update(words)
        n0 += 1

    def excess(w: bytes) -> float:
        a, b = seen[w], usual[w]
        p = (a + b + 1) / (n0 + n1 + 2)
        return (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))

    # a start that only goes on in one way says no more than what it goes on to
    inner = {w[:-k] for w in seen for k in (1, 2) if seen.get(w[:-k]) == seen[w]}
    rank = {w: excess(w) for w in seen if w not in inner}
    order = sorted((w for w, z in rank.items() if z >= SURE), key=lambda w: (-rank[w], -len(w), w))
    toxic = unlike(order, LANDMARKS)
    if not toxic:
        return [], [], np.empty(0)
    clean = sorted((w for w in words_of if 4 <= len(w) <= WINDOW and rank.get(w, 0) < 1), key=lambda w: (-words_of[w], w))[:20_000]
    plain = Landmarks(toxic, 0)
    near = np.concatenate([np.empty(0), *(plain.compare(clean[k : k + WORDS]).max(1) for k in range(0, len(clean), WORDS))])
    close = [clean[k] for k in np.argsort(-near, kind="stable")[: 4 * CLEAN]]
    odds = np.array([np.log((seen[w] + PRIOR) / n1 * n0 / (usual[w] + PRIOR * n0 / n1)) for w in toxic])
    return toxic, unlike(close, min(CLEAN, len(toxic))), odds


def choose(toxic_sets: Iterable[set[bytes]], clean_sets: Iterable[set[bytes]]) -> tuple[list[bytes], list[bytes]]:
    """The landmarks of ``evidence``, toxic and clean."""
    return evidence(toxic_sets, clean_sets)[:2]


def unlike(words: list[bytes], most: int) -> list[bytes]:
    """The first of ``words`` that aren't alike, up to ``most``."""
    kept: list[bytes] = []
    table = np.empty((0, WINDOW), np.uint8)
    own = np.empty(0, np.float32)
    for w in dict.fromkeys(words):
        if len(kept) == most:
            break
        row = padded([w])
        k = np.maximum(kernel(row, row), 1e-12)
        if not kept or (kernel(np.repeat(row, len(kept), 0), table) / np.sqrt(k * own)).max() < ALIKE:
            kept.append(w)
            table, own = np.concatenate([table, row]), np.concatenate([own, k])
    return kept


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one after another."""
    out = np.repeat(start - np.cumsum(length) + length, length)
    out += np.arange(len(out))
    return out


def svm(x: np.ndarray, t: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge loss, by Newton steps over the rows within the margin; classes weigh alike. t is 1 or -1."""
    w = np.r_[np.zeros(x.shape[1]), -1.0]
    if len({*t}) < 2:
        return w[:-1], float(w[-1])
    parts = [slice(k, k + SENTENCES) for k in range(0, len(t), SENTENCES)]
    c = np.where(t > 0, 0.5 / (t > 0).sum(), 0.5 / (t < 0).sum()).astype(x.dtype)
    active = np.ones(len(t), bool)
    for _ in range(30):
        left, right = penalty * np.diag(np.r_[np.ones(x.shape[1]), 1e-6]), np.zeros(len(w))
        for part in parts:
            z = np.c_[x[part], np.ones(len(t[part]), x.dtype)][active[part]]
            a = z * c[part][active[part], None]
            left += a.T @ z
            right += a.T @ t[part][active[part]]
        w = np.linalg.solve(left, right)
        now = np.concatenate([t[part] * (x[part] @ w[:-1] + w[-1]) < 1 for part in parts])
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


class Model:
    """Landmarks, each one's weight in a sentence's decision, the bias and the calibration. Without landmarks all texts score 0."""

    def __init__(self, texts: list[str], y: np.ndarray):
        random = np.random.default_rng(SEED)
        y = np.asarray(y)
        back = random.random(len(y)) < 0.25
        if len({*y[back]}) < 2 or len({*y[~back]}) < 2:
            back[:] = False
        fit = np.flatnonzero(~back)
        words = lambda label: ({*tokens(texts[k])} - {STOP} for k in fit if y[k] == label)
        toxic, clean, self.odds = evidence(words(1), words(0))
        self.landmarks = None
        if not toxic:
            return
        self.landmarks = Landmarks(toxic + clean, len(toxic))
        values, vectors = np.linalg.eigh(self.landmarks.gram())
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        self.train([texts[k] for k in fit], y[fit])
        rows = np.flatnonzero(back) if back.any() else fit
        self.lexicon = Lexicon(self.share)
        self.curve = rising(np.concatenate([self.features([texts[k] for k in rows[i : i + TEXTS]]) for i in range(0, len(rows), TEXTS)]), y[rows])
        self.lexicon = None

    def train(self, texts: list[str], y: np.ndarray) -> None:
        """Multiple-instance rounds: of each toxic document the sentences found toxic, the worst at least, against the worst of the clean ones so far."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lexicon = Lexicon(lambda new: self.sparse(new, len(lexicon.value), held), 0)
        word, sentence, text, n = [], [], [], 0
        for k in range(0, len(texts), TEXTS):
            w, s, t, _ = lexicon.read(texts[k : k + TEXTS], self.landmarks)
            word, sentence, text, n = [*word, w], [*sentence, (s + n).astype(np.int32)], [*text, t + k], n + len(t)
        words = len(lexicon.value)
        del lexicon
        word, sentence, text = map(np.concatenate, (word, sentence, text))
        row, mark, value = map(np.concatenate, zip(*held, strict=True))
        first = np.searchsorted(row, np.arange(words + 1))
        # only windows with any kernel count
        some = (first[word + 1] > first[word]).nonzero()[0]
        some = some[np.argsort(sentence[some], kind="stable")]
        word, sentence = word[some], sentence[some]
        self.weight, self.bias = np.zeros(len(self.map)), -0.75
        self.weight[: self.landmarks.toxic] = self.odds
        chosen, penalty = np.zeros(n, bool), PENALTY * max(1, ENOUGH / max((y == 1).sum(), 1))
        for k in range(ROUNDS):
            if k:
                decision = np.bincount(sentence, np.bincount(row, value * self.weight[mark], words)[word], n)
            else:
                # by the strongest window, as long sentences have more weak ones
                strongest, decision = np.zeros(words), np.zeros(n)
                np.maximum.at(strongest, row, value * self.weight[mark])
                np.maximum.at(decision, sentence, strongest[word])
            ranked = np.lexsort((-decision, text))
            top = np.searchsorted(text[ranked], text[ranked])
            place, near = np.arange(n) - top, decision[ranked] >= NEAR * decision[ranked][top]
            bad = ranked[(y[text[ranked]] == 1) & ((place == 0) | (place < WORST) & near & (decision[ranked] + self.bias > 0))]
            chosen[ranked[(place < HARD) & (y[text[ranked]] == 0)]] = True
            rows = np.concatenate([bad, np.flatnonzero(chosen)])
            at = np.searchsorted(sentence, rows)
            windows_of = np.searchsorted(sentence, rows, "right") - at
            x = np.empty((len(rows), len(self.map)), np.float32)
            for start in range(0, len(rows), SENTENCES):
                some = slice(start, start + SENTENCES)
                w = word[spans(at[some], windows_of[some])]
                each = first[w + 1] - first[w]
                cell = np.repeat(np.repeat(np.arange(len(x[some])), windows_of[some]), each) * len(self.map) + mark[(entry := spans(first[w], each))]
                x[some] = np.bincount(cell, value[entry], x[some].size).astype(np.float32).reshape(x[some].shape) @ self.map.astype(np.float32)
            weight, self.bias = svm(x, np.r_[np.ones(len(bad), np.float32), -np.ones(len(rows) - len(bad), np.float32)], penalty)
            self.weight = self.map @ weight

    def sparse(self, words: list[bytes], start: int, held: list) -> np.ndarray:
        """Keeps (word, landmark, kernel) of new words, numbered from ``start``, in ``held``; their values are of no use yet."""
        for k in range(0, len(words), WORDS):
            table = self.landmarks.compare(words[k : k + WORDS])
            i, j = np.nonzero(table)
            held.append(((i + start + k).astype(np.int32), j.astype(np.int32), table[i, j]))
        return np.zeros(len(words), np.float32)

    def share(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the decision of a sentence."""
        parts = [self.landmarks.compare(words[k : k + WORDS]) @ self.weight for k in range(0, len(words), WORDS)]
        return np.concatenate(parts).astype(np.float32)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: its worst sentence's decision, the sum of the sentences' excess, from 0 to 2 each, and how dense that is."""
        if self.lexicon is None:
            self.lexicon = Lexicon(self.share)
        word, sentence, text, many = self.lexicon.read(texts, self.landmarks)
        decision = np.bincount(sentence, self.lexicon.value[word], len(text)) + self.bias
        worst, above = np.full(len(texts), self.bias), np.zeros(len(texts))
        np.maximum.at(worst, text, decision)
        np.add.at(above, text, np.clip(decision + SLACK, 0, 3))
        return np.stack([np.clip(worst, -1.5, 2.5), np.log1p(above), np.minimum(100 * above / (many + 20), 4), np.ones(len(texts))], 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.curve) if self.landmarks else np.zeros(len(texts))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over features, by Newton steps, with Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    t, w = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(x.shape[1])
    for _ in range(60):
        p = sigmoid(x @ w)
        slope = x.T @ (p - t) + 1e-2 * w
        w = w - np.clip(np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope), -2, 2)
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic curve of least log loss among those that use the first feature and in which no feature counts against the label."""
    found = []
    for some in ([0, 1, 2, 3], [0, 1, 3], [0, 2, 3], [0, 3]):
        curve = np.zeros(x.shape[1])
        curve[some] = logistic(x[:, some], y)
        p = np.clip(sigmoid(x @ curve), 1e-9, 1 - 1e-9)
        found.append(((curve[:-1] < 0).any(), -np.log(np.where(y > 0, p, 1 - p)).mean(), curve))
    return min(found, key=lambda f: f[:2])[2]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model | None:
    """The model of a bounded labelled sample; none if a class has no rows."""
    small_batches(docs.sparkSession)
    return learnt(labelled_sample(docs, labels, "toxic", modulus, held_out, SAMPLE), Model)


def scores(docs: DataFrame, model: Model | None, schema, make) -> DataFrame:
    """``make(batch, scores)`` of every batch of ``docs``; null text as empty. 0 without a model."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield make(batch, judge(texts) if judge else np.zeros(len(texts)))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row, by its whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scores(rows, model, "doc_id long, score double", lambda b, p: pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"]))


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``threshold``.

    Null and empty texts are clean, repeated rows stay or go together, other columns are kept as they
    are; an empty table stays empty. Without a model nothing goes.
    """
    return scores(docs, model, docs.schema, lambda b, p: b.filter(pa.array(p < threshold)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text; others are ignored).

    Labels (doc_id, toxic) are learnt only from ids of which crc32 mod ``modulus`` is not
    ``held_out``. Null and empty texts score as a text without any match; very long ones are read
    whole, and words of any length in parts; repeated rows score alike; a null doc_id counts as an
    empty one for the fold; an empty table gives no rows. Without labels of both classes all score 0.
    """
    scored = score(docs, fit(docs, labels, modulus, held_out))
    return scored.select("doc_id", (crc32_fold("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
