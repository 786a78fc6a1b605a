"""Toxicity by multiple-instance learning: sentences score, a noisy-or combines them, documents' labels train.

A sentence's evidence is z = bias + the sum of weights of its words and of their beginnings, which stand for inflected
stems. It is toxic with p = 1 - exp(-rate), rate = softplus(SHARP * z) / SHARP: a logistic link whose lower tail falls fast, so that a million
harmless sentences add up to nothing while several doubtful ones do add up. A document is toxic with 1 - prod(1 - p) over all its sentences; that one formula is
trained and scored. Clean documents' share of the loss is the sum of their sentences' rates, thus that of all of them joined; ``CLEAN`` weighs it. Only documents
carry labels. Words and beginnings are those that tell the training documents' classes apart; the trained model also says which sentences offend
(``offending_sentences``).

Defined cases: null and empty texts have one empty sentence; a sentence of more than ``MOST_WORDS`` words counts in pieces of so many; a null ``doc_id`` is not held out; repeated rows get a row each;
without usable labels, or with one class only, scores are near that class (0 without labels); an empty table gives no rows; further
columns stay out of the score, and ``keep_clean`` hands them on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.quality_crf import filter_documents, score_documents
from tidemark.llm.training import adam, labelled_sample, sigmoid

MOD, HELD_OUT, THRESHOLD = 4, 2, 0.3
VOCABULARY, LEAST_DOCS, STEPS, RIDGE = 500, 4, 300, 3e-4
SHARP, CLEAN = 12.0, 3e4
MOST_WORDS = 64
_STEMS, _MEMO_WORDS, _SLOTS = (4, 5, 6, 7, 8), 200_000, 1 << 22
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_ENDS = re.compile(r"[.!?]+(?=\s)|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_SPAN = 1 << 16


def sentences(text: str) -> list[str]:
    return [piece for s in _SENTENCE.split(text) if s.strip() for piece in pieces(s)] or [""]


def pieces(sentence: str) -> list[str]:
    """The sentence, cut before every ``MOST_WORDS``-th further word: weights add up within one."""
    if len(sentence) < 2 * MOST_WORDS:
        return [sentence]
    cuts = [m.start() for m in _WORD.finditer(sentence)][MOST_WORDS::MOST_WORDS]
    return [sentence[a:b] for a, b in zip([0, *cuts], [*cuts, None])]


def word_groups(low: str, a: int, b: int) -> Iterator[set[str]]:
    """The words of one sentence of a lower-case text, in pieces of ``MOST_WORDS``; the words of a long one are never listed whole."""
    if b - a < _SPAN:
        words = _WORD.findall(low, a, b)
        if words or not low[a:b].isspace() and a < b:
            yield from (set(words[k : k + MOST_WORDS]) for k in range(0, len(words) or 1, MOST_WORDS))
        return
    found = (m[0] for m in _WORD.finditer(low, a, b))
    first = True
    while (words := set(islice(found, MOST_WORDS))) or first:
        first = False
        yield words


def marks_of(word: str) -> list[str]:
    """The word and its proper beginnings (ending in a dash)."""
    return [word, *(word[:k] + "-" for k in _STEMS if len(word) > k)]


def words_of(sentence: str) -> set[str]:
    return {m for w in set(_WORD.findall(sentence.lower())) for m in marks_of(w)}


class WordWeights(dict):
    """Summed weights of a word's marks, remembered for a bounded number of words."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _MEMO_WORDS:
            self.clear()
        self[word] = total = sum(self.weights.get(m, 0.0) for m in marks_of(word))
        return total


def choose_marks(texts: list[str], y: np.ndarray) -> list[str]:
    """The ``VOCABULARY`` marks whose share of documents differs most between the classes, in units of its error.

    Marks are first counted by hash in arrays of fixed size, and by name only where their hash stands out: rare
    words are too many to keep.
    """
    size = np.array([(y == 0).sum(), (y == 1).sum()])

    def apart(seen):
        share = seen.sum(axis=0) / size.sum()
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / size).sum())
        return np.where(seen.sum(axis=0) >= LEAST_DOCS, np.abs(seen[1] / size[1] - seen[0] / size[0]) / error, 0)

    def marks(text):
        return {m for w in set(_WORD.findall(text.lower())) for m in marks_of(w)}

    slot = lambda m: zlib.crc32(m.encode()) & _SLOTS - 1
    seen = np.zeros((2, _SLOTS), np.int32)
    for t, label in zip(texts, y.astype(int)):
        seen[label, list({slot(m) for m in marks(t)})] += 1
    far = apart(seen)
    first = set(np.argsort(-far, kind="stable")[: 3 * VOCABULARY].tolist())
    by_name: dict[str, list[int]] = {}
    for t, label in zip(texts, y.astype(int)):
        for m in marks(t):
            if slot(m) in first:
                by_name.setdefault(m, [0, 0])[label] += 1
    names = sorted(by_name)
    far = apart(np.array([by_name[m] for m in names], np.int64).reshape(-1, 2).T)
    return [names[i] for i in np.argsort(-far, kind="stable")[:VOCABULARY] if far[i] > 0]


def rate(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, SHARP * z) / SHARP


class NoisyOr:
    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> "NoisyOr":
        self.weights, self.bias = {}, -3.0
        if not len(y) or y.min() == y.max():
            self.bias = 3.0 if len(y) and y[0] == 1 else -3.0
            return self
        place = {m: i for i, m in enumerate(choose_marks(texts, y))}
        bag, sent, word, n_sent = [], [], [], 0
        for d, t in enumerate(texts):
            # One bag as the text stands and one without ends of sentences: evidence is to add up alike in pieces of either kind.
            for k, parts in enumerate((sentences(t), pieces(_ENDS.sub(" ", t)))):
                for s in parts:
                    hits = [place[m] for m in words_of(s) if m in place]
                    bag.append(2 * d + k)
                    word += hits
                    sent += [n_sent] * len(hits)
                    n_sent += 1
        bag, sent, word = (np.array(x, np.int64) for x in (bag, sent, word))
        y, weight = np.repeat(y, 2), np.repeat(weight, 2)

        def gradient(p):
            z = p[-1] + np.bincount(sent, p[word], n_sent)
            total = np.bincount(bag, rate(z), len(y))
            push = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-12)), CLEAN) * weight  # of -log P by the sum of rates
            gz = push[bag] * sigmoid(SHARP * z) / len(y)
            g = np.append(np.bincount(word, gz[sent], len(place)), gz.sum())
            g[:-1] += RIDGE * p[:-1]
            return g

        start = np.zeros(len(place) + 1)
        start[-1] = -1.0
        p = adam(gradient, start, STEPS, 0.1)
        self.weights = {w: float(p[i]) for w, i in place.items() if abs(p[i]) > 0.02}
        self.bias = float(p[-1])
        return self

    def weight_of(self, word: str) -> float:
        if "memo" not in self.__dict__:
            self.memo = WordWeights(self.weights)
        return self.memo[word]

    def evidence(self, text: str) -> Iterator[float]:
        """``z`` of each sentence, one at a time."""
        low, a, found = text.lower(), 0, False
        for end in chain(_SENTENCE.finditer(low), (None,)):
            b = end.start() if end else len(low)
            for words in word_groups(low, a, b):
                found = True
                yield self.bias + sum(map(self.weight_of, words))
            a = end.end() if end else b
        if not found:
            yield self.bias

    def sentence_scores(self, text: str) -> np.ndarray:
        return -np.expm1(-rate(np.array([self.bias + sum(map(self.weight_of, set(_WORD.findall(s.lower())))) for s in sentences(text)])))

    def score(self, texts: list[str]) -> np.ndarray:
        """The noisy-or of each text's sentences."""
        total = np.zeros(len(texts))
        for i, text in enumerate(texts):
            z = self.evidence(text)
            while len(part := np.fromiter(islice(z, 1 << 16), np.float64)):
                total[i] += rate(part).sum()
        return -np.expm1(-total)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}


def train(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    return NoisyOr().fit(*labelled_sample(docs, labels, "toxic", MOD, HELD_OUT))


def toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    return score_documents(docs, model, MOD, HELD_OUT, THRESHOLD)


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """``doc_id, sentence_no, sentence, score`` of sentences that score ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                p = model.sentence_scores(text)
                if (p >= least).any():
                    all_of, at = sentences(text), np.flatnonzero(p >= least)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(k, 1)] * len(at)), pa.array(at, pa.int32()), pa.array([all_of[i] for i in at]), pa.array(p[at])], names=["doc_id", "sentence_no", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sentence_no int, sentence string, score double")


def keep_clean(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    return filter_documents(docs, model, lambda s: s < threshold)
