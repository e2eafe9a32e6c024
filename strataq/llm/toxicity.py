"""Toxicity: a gapped-subsequence string kernel over windows of text, Nystrom landmarks and a linear support vector machine."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataq.llm.quality import training_rows
from strataq.llm.tokens import TABLE, chunks, run_hashes

#: At most about so many labelled rows are fitted on, those of least hash; so the driver's share is bounded.
TRAIN_ROWS = 4_000
LANDMARKS = 256
#: Training texts are read in pieces of about so many bytes.
FIT_BYTES = 1 << 20
#: Bytes of the training texts together, which the driver reads whole.
TRAIN_BYTES = 1 << 24
THRESHOLD = 0.7
#: Two neighbours of a subsequence are at most so many letters apart, whatever else lies between them.
REACH = 2
#: What a skipped letter costs, and each code point skipped that is none: marks, blanks, digits, invisible ones.
DECAY, MARK = 0.7, 0.92
#: What subsequences of two, three and four letters count.
SHARE = (0.3, 0.6, 1.0)
#: Windows are words, and all runs of words of at most RUN letters; a word of more than WIDE is cut into halves that overlap.
RUN, WIDE = 16, 32
#: Margins count up to here.
TOP = 1.5
#: Letters that are gone through at a time.
PART = 1 << 16
_PAD = 3 * REACH
_SPANS = range(1, _PAD + 1)
#: Subsequences of up to four letters of five bits; no letter is 0.
SPACE = 1 << 20
_FADE = MARK ** np.arange(256, dtype=np.float32)

# Digits and marks that stand for letters.
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@cache
def letter_codes() -> np.ndarray:
    """By code point: a to z are 1 to 26, in either case and with accents, letters of other scripts 27 to 31, the rest 0."""
    out = np.zeros(1 << 17, np.int32)
    for k in range(128, len(out)):
        c = chr(k)
        if unicodedata.category(c)[0] == "L":
            plain = unicodedata.normalize("NFKD", c)[0].lower()
            out[k] = ord(plain) - 96 if "a" <= plain <= "z" else 27 + k % 5
    for k in range(26):
        out[97 + k] = out[65 + k] = k + 1
    for a, b in _LOOKALIKE.items():
        out[ord(a)] = ord(b) - 96
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and first[i]:first[i + 1], those of text i."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.int32), offsets
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    out = b[at].astype(np.int32)
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        some = np.flatnonzero((b[at] >= low) & (b[at] < (0xE0, 0xF0, 0xF8)[size - 2]))
        c = out[some] & mask
        for k in range(1, size):
            c = (c << 6) | (b[at[some] + k] & 0x3F)
        out[some] = c
    return out, np.searchsorted(at, offsets)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the letters, their places in code points; where each word starts and ends in them, and its text).

    After each text come zeros that no subsequence reaches over. A word without letters is none.
    """
    point, first = code_points(data, offsets)
    table = letter_codes()
    code = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], np.where(point < 0xE0000, 27 + point % 5, 0)).astype(np.int32)
    blank = (point == 32) | ((point >= 9) & (point <= 13))
    new = np.zeros(len(point), bool)
    new[1:] = blank[:-1]
    new[first[:-1][first[:-1] < len(point)]] = True
    place = np.flatnonzero(code)
    row = np.searchsorted(first, place, "right") - 1
    at = np.arange(len(place)) + _PAD * row
    codes, pos = np.zeros(len(place) + _PAD * (len(offsets) - 1), np.int32), np.zeros(len(place) + _PAD * (len(offsets) - 1), np.int32)
    codes[at], pos[at] = code[place], place
    word = np.cumsum(new)[place]
    head = np.flatnonzero(np.diff(word, prepend=-1))
    tail = np.append(head[1:], len(place))[: len(head)] - 1
    return codes, pos, at[head], at[tail] + 1 if len(head) else at[head], row[head]


def windows(starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words to windows (start, end, text), by start: words, pieces of very long ones, and runs of at most RUN letters."""
    long = ends - starts > WIDE
    found = [(starts[~long], ends[~long], row[~long])]
    if long.any():
        step, s, e = WIDE // 2, starts[long], ends[long]
        times = -(-(e - s - step) // step)
        a = np.repeat(s, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * step
        found.append((a, np.minimum(a + WIDE, np.repeat(e, times)), np.repeat(row[long], times)))
    i = np.arange(len(starts))
    for k in range(1, RUN):
        i = i[i + k < len(starts)]
        # letters of different texts are further apart than they are many, but never a run
        i = i[(row[i + k] == row[i]) & (ends[i + k] - starts[i] <= RUN)]
        if not len(i):
            break
        found.append((starts[i], ends[i + k], row[i]))
    a, b, r = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(a, kind="stable")
    return a[by], b[by], r[by]


def layout(segs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and places of segments one after another, each followed by zeros that no subsequence reaches over; where they start."""
    at = np.concatenate([[0], np.cumsum([len(c) + _PAD for c, _ in segs])]).astype(np.int64)
    codes, pos = np.zeros(at[-1], np.int32), np.zeros(at[-1], np.int32)
    for (c, p), k in zip(segs, at[:-1], strict=True):
        codes[k : k + len(c)], pos[k : k + len(c)] = c, p
    return codes, pos, at


def occurrences(codes: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each choice of distances: how far it spans, the weight of each subsequence, 0 if it isn't whole, and its number."""
    n = len(codes) - _PAD
    if n <= 0:
        return
    some = codes > 0
    step = {}
    for d in range(1, REACH + 1):
        gap = np.clip(pos[d:] - pos[:-d] - d, 0, len(_FADE) - 1)  # code points between the two that are no letters
        step[d] = np.float32(DECAY ** (d - 1)) * _FADE[gap] * (some[d:] & some[:-d])
    for d1 in range(1, REACH + 1):
        w2, two = step[d1][:n], (codes[:n] << 5) | codes[d1 : n + d1]
        yield d1, np.float32(SHARE[0]) * w2, two
        for d2 in range(d1 + 1, d1 + REACH + 1):
            w3, three = w2 * step[d2 - d1][d1 : n + d1], (two << 5) | codes[d2 : n + d2]
            yield d2, np.float32(SHARE[1]) * w3, three
            for d3 in range(d2 + 1, d2 + REACH + 1):
                yield d3, np.float32(SHARE[2]) * (w3 * step[d3 - d2][d2 : n + d2]), (three << 5) | codes[d3 : n + d3]


def sums(codes: np.ndarray, pos: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window a:b, by start: the sum of the table over the subsequences within it, and its norm."""
    total, square = np.zeros(len(a)), np.zeros(len(a))
    cuts = np.searchsorted(a, np.arange(0, len(codes) + PART, PART))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i == j:
            continue
        at = k * PART
        c, p = (np.concatenate([x[at : at + PART + WIDE], np.zeros(_PAD, np.int32)]) for x in (codes, pos))
        value, norm = np.zeros((_PAD, len(c)), np.float32), np.zeros((_PAD, len(c)), np.float32)
        for span, weight, number in occurrences(c, p):
            value[span - 1, : len(weight)] += weight * table[number]
            norm[span - 1, : len(weight)] += weight * weight
        x, y = a[i:j] - at, b[i:j] - at
        for out, per in ((total, value), (square, norm)):
            for span in _SPANS:  # what starts in the window and ends in it
                run = np.concatenate([[0.0], np.cumsum(per[span - 1], dtype=np.float64)])
                out[i:j] += run[np.maximum(y - span, x)] - run[x]
    return total, np.sqrt(np.maximum(square, 0) + 0.25)


def kernel(segs: list[tuple[np.ndarray, np.ndarray]], tables: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The kernel of each segment with each landmark, (segments, landmarks)."""
    out = np.zeros((len(segs), len(tables)), np.float32)
    columns = np.ascontiguousarray(tables.T)
    for i in range(0, len(segs), 2_000):
        codes, pos, at = layout(segs[i : i + 2_000])
        part, square = np.zeros((len(codes), len(tables)), np.float32), np.zeros(len(codes), np.float32)
        for _, weight, number in occurrences(codes, pos):
            where = np.where(weight > 0, index[number], 0)
            known = np.flatnonzero(where)
            part[known] += weight[known, None] * columns[where[known]]
            square[: len(number)] += weight * weight
        norm = np.sqrt(np.add.reduceat(square, at[:-1]) + np.float32(0.25))
        out[i : i + 2_000] = np.add.reduceat(part, at[:-1], axis=0) / norm[:, None]
    return out


def explicit(codes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel's explicit features of one segment, over its norm: numbers of subsequences and values."""
    found, square = [(np.zeros(0, np.int64), np.zeros(0))], 0.25
    for _, weight, number in occurrences(codes, pos):
        found.append((number[weight > 0], weight[weight > 0]))
        square += float((weight * weight).sum())
    ids, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return ids.astype(np.int64), np.bincount(back, np.concatenate([f[1] for f in found]), len(ids)) / np.sqrt(square)


def tables_of(segs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the features that landmarks have, where each number stands, a row of values for each landmark)."""
    rows = [explicit(*layout([x])[:2]) for x in segs]
    ids = np.unique(np.concatenate([r[0] for r in rows]))
    index = np.zeros(SPACE, np.int32)
    index[ids] = np.arange(1, len(ids) + 1)
    tables = np.zeros((len(rows), len(ids) + 1), np.float32)
    for t, (k, v) in zip(tables, rows, strict=True):
        t[index[k]] = v
    return ids, index, tables


@dataclass
class Model:
    """The machine as one table: with alpha the landmarks' weights, the sum of alpha times their features."""

    table: np.ndarray
    bias: float
    slope: tuple[float, float]

    def margins(self, codes: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total, norm = sums(codes, pos, self.table, a, b)
        return total / norm + self.bias

    def bags(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest margin of each text's windows, from -3 to TOP: beyond it, one is as surely toxic as another."""
        codes, pos, *words = letters(data, offsets)
        a, b, row = windows(*words)
        best = np.full(len(offsets) - 1, -3.0)
        np.maximum.at(best, row, np.minimum(self.margins(codes, pos, a, b), TOP))
        return best

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.slope[0] + self.slope[1] * self.bags(data, offsets)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Squared hinge loss and a ridge, by damped Newton steps on the rows within the margin; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = 0.05 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w + cost @ np.maximum(1 - y * (x @ w), 0) ** 2)

    w, now = np.zeros(x.shape[1]), float(cost.sum())
    for _ in range(rounds):
        near = y * (x @ w) < 1
        a = x[near] * cost[near, None]
        step = np.linalg.solve(a.T @ x[near] + ridge, a.T @ y[near]) - w
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        done = now - new < 1e-7 * now
        if new < now:
            w, now = w + size * step, new
        if done:
            break
    return w


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one input by Newton steps."""
    x = np.stack([np.ones(len(x)), x], 1)
    w = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def _disguised(codes: np.ndarray, pos: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same word with one, two or three marks or blanks between all letters, with one put in, and with a letter put in."""
    n = len(codes)
    if not 4 <= n <= RUN:
        return []
    k, flat = int(rng.integers(1, n)), np.arange(n)
    put = np.insert(codes, k, int(rng.choice([24, 26, 17, 11, 23])))
    return [*((codes, flat * m) for m in (2, 3, 4)), (codes, flat + (flat >= k)), (put, np.arange(n + 1))]


def _vocabulary(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The different words of letters, and pairs (word, text), each once."""
    hashes, kept, pairs = [], {}, []
    for i, j, data, offsets in chunks(pa.array(texts), FIT_BYTES):
        codes, pos, starts, ends, row = letters(data, offsets)
        short = ends - starts <= WIDE
        starts, ends, row = starts[short], ends[short], row[short]
        h, one, back = np.unique(run_hashes(TABLE[codes], starts, ends), return_index=True, return_inverse=True)
        both = np.unique(back * (j - i) + row)
        pairs.append((h[both // (j - i)], both % (j - i) + i))
        for x, s, e in zip(h.tolist(), starts[one].tolist(), ends[one].tolist(), strict=True):
            if x not in kept:
                kept[x] = (codes[s:e].astype(np.int8), pos[s:e] - pos[s])
        hashes.append(h)
    h = np.unique(np.concatenate(hashes))
    return [kept[x] for x in h.tolist()], np.searchsorted(h, np.concatenate([p[0] for p in pairs])), np.concatenate([p[1] for p in pairs])


def _telling(model: Model, texts: list[str], y: np.ndarray, most: int) -> tuple[list, list]:
    """The windows of clean texts with the largest margins, so many, and of each toxic text the one with the largest."""
    clean, toxic = {}, {}
    for i, j, data, offsets in chunks(pa.array(texts), FIT_BYTES):
        codes, pos, *words = letters(data, offsets)
        a, b, row = windows(*words)
        m = model.margins(codes, pos, a, b)
        one = y[i + row] == 1
        best = np.full(j - i, -np.inf)
        np.maximum.at(best, row, m)
        some = np.flatnonzero(~one)
        for w in some[np.argsort(-m[some])[:most]]:
            key = codes[a[w] : b[w]].tobytes()
            clean[key] = max(clean.get(key, (-np.inf,)), (float(m[w]), codes[a[w] : b[w]].copy(), pos[a[w] : b[w]] - pos[a[w]]), key=lambda v: v[0])
        clean = dict(sorted(clean.items(), key=lambda v: -v[1][0])[:most])
        for w in np.flatnonzero(one & (m == best[row]) & (m > 0)):
            toxic[codes[a[w] : b[w]].tobytes()] = (codes[a[w] : b[w]].copy(), pos[a[w] : b[w]] - pos[a[w]])
    return [(v[1], v[2]) for v in clean.values()], list(toxic.values())


def fit(texts: list[str], labels: list[int], *, landmarks: int = LANDMARKS, negatives: int = 8_000, rounds: int = 3) -> Model:
    """Labels mark texts, not windows: words that mark toxic texts start as examples; each round, the window of each
    toxic text with the largest margin joins them, and the windows of clean texts with the largest margins are
    counterexamples. The plainest toxic words also count with characters put in. The scale is fitted on the labelled texts.

    Without rows of both classes, or without words, the share of ones is the score.
    """
    y = np.array(labels, float)
    ones = y.mean() if len(y) else 0.5
    plain = Model(np.zeros(SPACE, np.float32), -1.0, (float(np.log((ones + 0.01) / (1.01 - ones))), 0.0))
    if not len(y) or not 0 < ones < 1:
        return plain
    vocabulary, seg, doc = _vocabulary(texts)
    if not len(vocabulary):
        return plain
    n = len(vocabulary)
    df1, df0 = np.bincount(seg, y[doc], n), np.bincount(seg, 1 - y[doc], n)
    n1, n0 = y.sum(), (1 - y).sum()
    p1, p0 = (df1 + 0.1) / (n1 + 1), (df0 + 0.1) / (n0 + 1)
    both = (df1 + df0 + 0.2) / (len(y) + 2)
    z = (p1 - p0) / np.sqrt(both * (1 / n1 + 1 / n0))
    rng = np.random.default_rng(5)
    toxic, clean = df0 * n1 < 0.05 * df1 * n0, np.flatnonzero(df0 > 0)
    positive = np.flatnonzero(toxic & (df1 >= 2) & (z > 3))
    if not len(positive):
        positive = np.argsort(-z)[:20]
    positive = positive[np.argsort(-z[positive])][:2_000]
    # each toxic text counts once, dealt over the words that mark it; so words of a few copied texts don't outweigh insults
    mark = np.zeros(n)
    mark[positive] = np.maximum(z[positive], 0.1) ** 2
    own = (y[doc] == 1) & (mark[seg] > 0)
    of = np.bincount(doc[own], mark[seg[own]], len(y))
    part = np.bincount(seg[own], mark[seg[own]] / of[doc[own]], n)
    positive = positive[np.argsort(-part[positive], kind="stable")]
    examples = {vocabulary[i][0].astype(np.int32).tobytes(): (vocabulary[i], min(part[i], 100.0)) for i in positive}
    made = [(v, min(part[i], 100.0) / 2) for i in positive[:64] for v in _disguised(*vocabulary[i], rng)]
    extra = [v[0] for v in made]
    some = [vocabulary[i] for i in rng.choice(clean, min(len(clean), negatives), replace=False)]
    near: dict = {}
    tainted = {vocabulary[i][0].astype(np.int32).tobytes() for i in clean[df0[clean] * n1 >= 0.05 * df1[clean] * n0]}
    model = Model(np.zeros(SPACE, np.float32), 0.0, (0.0, 1.0))
    for turn in range(rounds):
        third = landmarks // 3
        ones, zeros = [v[0] for v in examples.values()], list(near.values())
        marks = [*ones[: 2 * third], *(zeros[i] for i in rng.permutation(len(zeros))[:third]), *some[:third]][:landmarks]
        ids, index, tables = tables_of(marks)
        gram = tables.astype(float) @ tables.T
        value, vector = np.linalg.eigh(gram)
        good = value > 1e-3 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        rows = [*ones, *extra, *zeros, *some]
        sign = np.where(np.arange(len(rows)) < len(ones) + len(extra), 1.0, -1.0)
        cost = np.ones(len(rows))
        cost[: len(ones) + len(extra)] = [*(v[1] for v in examples.values()), *(v[1] for v in made)]
        w = _svm(kernel(rows, tables, index) @ root, sign, cost)
        model.table, model.bias = np.zeros(SPACE, np.float32), float(w[-1])
        model.table[ids] = ((root @ w[:-1]) @ tables)[1:]
        if turn + 1 < rounds:
            hard, told = _telling(model, texts, y, 1_500)
            near |= {(c.tobytes(), p.tobytes()): (c, p) for c, p in hard}
            seen = {k[0] for k in near} | tainted
            for c, p in told:
                if len(examples) < 4_000 and c.tobytes() not in seen:
                    examples.setdefault(c.tobytes(), ((c, p), 0.1))
    model.slope = (0.0, 1.0)
    bags = np.zeros(len(y))
    for i, j, part, offsets in chunks(pa.array(texts), FIT_BYTES):
        bags[i:j] = model.bags(part, offsets)
    model.slope = _platt(bags, y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    return fit(*training_rows(docs, labels, label, rows, TRAIN_BYTES))
