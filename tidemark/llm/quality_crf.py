"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line with a word is labelled good or bad. A line's features describe it and its neighbours; a chain
of two states links the labels. Documents' labels stand in for their lines' labels in training (weak
supervision). A document's score is the mean of its lines' forward-backward marginals, weighted by length in
characters, through a logistic curve fitted to the documents' labels.

Defined cases: texts without words (null, empty) get the share of good ones among such training documents,
or 0 if there are none; a null ``doc_id`` counts as held out; repeated rows get a row each; without any usable label the score is 1;
an empty table gives no rows; further columns stay out of the score, and ``keep_good`` hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.training import adam, calibrate, labelled_sample, remainder, sigmoid

MOD, HELD_OUT, THRESHOLD = 5, 0, 0.3
STEPS, RIDGE = 150, 0.02
_HINGES = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)
_MARKS = b"#*$%&|<>{}[]\\~^_=@+"
N_FEATURES = 18
_BATCH_CHARS = 1 << 21


def _byte_classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 sentence mark, 5 symbol, 6 white space."""
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 1, 2, 2, 3
    for marks, k in ((b".,;:!?", 4), (_MARKS, 5), (b" \t\r\x0b\x0c", 6)):
        kind[list(marks)] = k
    return kind


_KIND = _byte_classes()


def lines_of(text: str) -> Iterator[str]:
    """The lines that hold a word, one at a time."""
    a = 0
    while a <= len(text):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        line = text[a:b]
        if line and not line.isspace():
            yield line
        a = b + 1


def repeated(text: str) -> np.ndarray:
    """Which lines equal an earlier one. Lines are kept as 64-bit hashes: eight bytes for each, however many there are."""
    h = np.fromiter(map(hash, lines_of(text)), np.int64)
    again = np.ones(len(h), bool)
    again[np.unique(h, return_index=True)[1]] = False
    return again


def shape(line: str) -> tuple[float, ...]:
    """What a line says by itself."""
    words = line.split()
    n = len(words)
    raw = line.encode()
    c = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7).tolist()
    ink = max(1, len(raw) - c[6])
    letters = max(1, c[1] + c[2])
    kinds = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    third = max(1, n - 2)
    return (
        math.log1p(n), math.log1p(len(raw)), ink / n, kinds / n, kinds / math.sqrt(n), same / n,
        len(set(zip(words, words[1:], words[2:]))) / third if n > 2 else 1.0, c[1] / letters, c[3] / ink, c[4] / ink, c[5] / ink, c[0] / ink,
        (c[1] + c[2]) / ink, line.count("!") / n, line.count("|") / n, float(line.rstrip()[-1:] in ".!?"),
    )


_known_shape = lru_cache(maxsize=4096)(shape)


def features_of(line: str, again: bool, last: str | None) -> tuple[float, ...]:
    """Its shape (remembered for short lines, which come in great numbers), and whether it repeats an earlier line or the last one."""
    return (*(_known_shape(line) if len(line) <= 64 else shape(line)), float(again), float(line == last))


def strips(texts: list[str], rows: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Raw features of consecutive lines, ``rows`` at a time, each with the line before and after; their lengths, their texts' numbers, and whether they begin or end a text.

    Yields ``raw`` (one row more at either side), ``size``, ``doc`` and ``edge`` (two columns of flags).
    """
    zero = (0.0,) * N_FEATURES

    def walk():
        for d, text in enumerate(texts):
            again, last = repeated(text), None
            for k, line in enumerate(lines_of(text)):
                yield features_of(line, again[k], last), len(line), d, (k == 0, k == len(again) - 1)
                last = line

    lines, before = walk(), zero
    part = list(islice(lines, rows))
    while part:
        ahead = list(islice(lines, rows))
        raw = [before, *(p[0] for p in part), ahead[0][0] if ahead else zero]
        yield np.array(raw, np.float64), np.array([p[1] for p in part], np.float64), np.array([p[2] for p in part], np.int64), np.array([p[3] for p in part], bool)
        part, before = ahead, part[-1][0]


class LineCrf:
    """Two states, 0 bad and 1 good. ``w`` weighs the emission of good, ``t`` the four transitions."""

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> "LineCrf":
        found = list(strips(texts))
        doc = np.concatenate([np.zeros(0, np.int64), *(s[2] for s in found)])
        counts = np.bincount(doc, minlength=len(texts))
        self.empty = float(np.average(y[counts == 0], weights=weight[counts == 0])) if (counts == 0).any() else 0.0
        self.known = bool(len(doc))
        if not self.known:
            self.empty = self.empty if len(y) else 1.0
            return self
        self.hinges = np.quantile(np.concatenate([s[0][1:-1] for s in found]), _HINGES, axis=0)
        x = np.concatenate([self._expand(s[0], s[3]).astype(np.float32) for s in found])
        del found
        self.mean, self.scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
        x -= self.mean.astype(np.float32)
        x /= self.scale.astype(np.float32)
        label, lw = y[doc].astype(int), weight[doc]
        n_docs = len(counts)

        def gradient(p):
            w, b, t = p[:-5], p[-5], p[-4:].reshape(2, 2)
            gamma, pairs = marginals(x @ w.astype(np.float32) + b, t, counts, weight)
            e = lw * (gamma - label)
            same = np.zeros((2, 2))
            inner = np.ones(len(doc), bool)
            inner[np.cumsum(counts)[counts > 0] - counts[counts > 0]] = False
            for s in (0, 1):
                same[s, s] = lw[inner & (label == s)].sum()
            g = np.concatenate([x.T @ e.astype(np.float32), [e.sum()], (pairs - same).ravel()]) / n_docs
            g[:-5] += RIDGE * w
            g[-4:] += RIDGE * p[-4:]
            return g

        p = adam(gradient, np.zeros(x.shape[1] + 5), STEPS, 0.05)
        self.w, self.b, self.t = p[:-5], p[-5], p[-4:].reshape(2, 2)
        self.slope, self.shift = 1.0, 0.0
        full = counts > 0
        m = self._mean_marginal(texts)
        self.slope, self.shift = calibrate(m[full], y[full], weight[full])
        return self

    def _expand(self, raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Own features with hinges at training quantiles, the neighbours' features, and flags of the first and last line."""
        own = raw[1:-1]
        before = np.where(edge[:, :1], 0, raw[:-2])
        after = np.where(edge[:, 1:], 0, raw[2:])
        return np.hstack([own, *(np.maximum(own - h, 0) for h in self.hinges), before, after, edge])

    def _mean_marginal(self, texts: list[str]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text; NaN for one without words. A line costs some numbers: its features pass strip by strip."""
        w = self.w / self.scale
        b = self.b - self.mean @ w
        parts = [(self._expand(raw, edge) @ w + b, size, doc) for raw, size, doc, edge in strips(texts)]
        if not parts:
            return np.full(len(texts), np.nan)
        emit, sizes, doc = (np.concatenate(p) for p in zip(*parts))
        gamma, _ = marginals(emit, self.t, np.bincount(doc, minlength=len(texts)))
        size = np.bincount(doc, sizes, len(texts))
        good = np.bincount(doc, sizes * gamma, len(texts)) / np.maximum(size, 1)
        bad = np.bincount(doc, sizes * (1 - gamma), len(texts)) / np.maximum(size, 1)
        return np.where(size > 0, np.log((good + 1e-6) / (bad + 1e-6)), np.nan)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.known:
            return np.full(len(texts), self.empty)
        m = self._mean_marginal(texts)
        return np.where(np.isnan(m), self.empty, sigmoid(self.slope * np.nan_to_num(m) + self.shift))


def marginals(emit: np.ndarray, t: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line by forward-backward, and the weighted sum of pair marginals.

    ``emit`` is the score of good; that of bad is 0. All chains are one sequence, in which a chain's first line forgets what came before. It is cut into
    equal stretches: their two-by-two products, multiplied one after the other, give each stretch its start, and all stretches then walk side by side.
    """
    n = len(emit)
    first = np.zeros(n, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    psi, trans = np.exp(np.clip(emit.astype(np.float64), -30, 30)), np.exp(np.clip(t, -10, 10))
    long = max(1, math.isqrt(n))
    width = -(-n // long)
    # Step k takes a row (bad, good) on its left to line k: what it meets there is weighed by psi. Padding changes nothing.
    step = np.tile(np.eye(2), (width * long, 1, 1))
    step[:n] = np.where(first[:, None, None], 1.0, trans) * np.stack([np.ones(n), psi], axis=1)[:, None, :]
    step = step.reshape(width, long, 2, 2)
    alpha, beta = np.empty((width, long, 2)), np.empty((width, long, 2))
    whole = np.tile(np.eye(2), (width, 1, 1))
    for k in range(long):
        whole = whole @ step[:, k]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    starts, ends = np.ones((width, 2)), np.ones((width, 2))
    for i in range(1, width):
        v = starts[i - 1] @ whole[i - 1]
        starts[i] = v / v.sum()
        v = whole[width - i] @ ends[width - i]
        ends[width - i - 1] = v / v.sum()
    v, u = starts, ends
    for k in range(long):
        v = np.einsum("wi,wij->wj", v, step[:, k])
        v = v / v.sum(axis=1, keepdims=True)
        alpha[:, k] = v
        beta[:, long - 1 - k] = u
        u = np.einsum("wij,wj->wi", step[:, long - 1 - k], u)
        u = u / u.sum(axis=1, keepdims=True)
    alpha, beta = alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]
    g = alpha * beta
    gamma = g[:, 1] / g.sum(axis=1)
    pairs = np.zeros((2, 2))
    if weight is not None:
        at = np.flatnonzero(~first)
        right = beta[at] * np.stack([np.ones(len(at)), psi[at]], axis=1)
        joint = alpha[at - 1][:, :, None] * trans[None] * right[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs = np.tensordot(np.repeat(weight, counts)[at], joint, axes=1)
    return gamma, pairs


def train(docs: DataFrame, labels: DataFrame) -> LineCrf:
    return LineCrf().fit(*labelled_sample(docs, labels, "quality", MOD, HELD_OUT))


def scored(model, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of consecutive texts, null as empty, a bounded number of characters at a time; with the place of the first."""
    from tidemark.llm.transducer_bpe import small_groups

    for first, texts in small_groups(column, _BATCH_CHARS):
        yield first, model.score(texts)


def score_documents(docs: DataFrame, model, mod: int = MOD, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, s in scored(model, batch.column("text")):
                part = batch.slice(first, len(s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (remainder("doc_id", mod) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def filter_documents(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of ``docs`` whose score passes ``keep`` (scores to booleans), with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [np.zeros(0, bool)]
            mask += [keep(s) for _, s in scored(model, batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(run, docs.schema)


def keep_good(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    return filter_documents(docs, model, lambda s: s >= threshold)
