import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import quality_crf, toxicity_mil, training


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    counts = np.array([3, 0, 1, 5])
    emit, t = r.normal(size=counts.sum()), r.normal(size=(2, 2))
    weight = np.array([1.0, 9.0, 2.0, 0.5])
    gamma, pairs = quality_crf.marginals(emit, t, counts, weight)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n, w in zip(counts, weight):
        e = emit[at : at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        score = np.array([np.exp(sum(e[i] * s for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        score /= score.sum()
        want += [sum(x for x, p in zip(score, paths) if p[i]) for i in range(n)]
        for x, p in zip(score, paths):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w * x
        at += n
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs)


def test_stretches_of_one_chain_equal_plain_recursion():
    r = np.random.default_rng(4)
    counts = np.array([1, 700, 0, 3, 1500, 2])
    emit, t = r.normal(scale=3, size=counts.sum()), r.normal(size=(2, 2))
    gamma, _ = quality_crf.marginals(emit, t, counts)
    want, at = [], 0
    for n in counts:
        a, b = np.ones((n, 2)), np.ones((n, 2))
        for k in range(n):
            a[k] = (a[k - 1] @ np.exp(t) if k else np.ones(2)) * [1, np.exp(emit[at + k])]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = np.exp(t) @ (b[k + 1] * [1, np.exp(emit[at + k + 1])])
            b[k] /= b[k].sum()
        want += ((a * b)[:, 1] / (a * b).sum(axis=1)).tolist()
        at += n
    assert np.allclose(gamma, want, atol=1e-9)


ALONE = """
import resource, sys, time
import numpy as np
from tidemark.llm import quality_crf
good, bad = "A plain sentence about the sea.\\nIt goes on, calmly.", "### $$$ |||\\n12345 67890"
model = quality_crf.LineCrf().fit([good, bad] * 10, np.array([1.0, 0.0] * 10), np.ones(20))
text = sys.argv[1].replace("N", "\\n") * (2_000_000 // len(sys.argv[1]))
held, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
score = model.score([text])[0]
print(time.process_time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held) / 1024, score)
"""


@pytest.mark.parametrize("line", ["aN", "abcN", "a b cNN"])
def test_many_short_lines_cost_little(line):
    """A text of 2 MB in up to a million lines: its seconds and megabytes, in a process of its own."""
    run = subprocess.run([sys.executable, "-c", ALONE, line], env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=300)
    seconds, mb, score = map(float, run.stdout.split())
    assert seconds < 20 and mb < 500 and 0 <= score <= 1


def test_document_score_is_the_length_weighted_mean_of_enumerated_marginals():
    """Features of neighbours, emissions, path sums and weights, all by plain loops over each document."""
    good = ["A plain sentence about the sea.\nIt goes on for a while, calmly.\nAnd it ends here.", "One line only, in good order."]
    bad = ["### $$$ |||\n### $$$ |||\n12345 67890", "BUY NOW !!! <a> <b>\nBUY NOW !!! <a> <b>"]
    texts, y = good * 6 + bad * 6, np.array([1.0] * 12 + [0.0] * 12)
    model = quality_crf.LineCrf().fit(texts, y, np.ones(24))
    asked = ["First line here.\n$$$ ||| ###\n\n  \nLast words of it, said twice.\nLast words of it, said twice.", *good, *bad]
    got = model._mean_marginal(asked)
    for text, value in zip(asked, got):
        lines = [x for x in text.split("\n") if x.split()]
        rows = [quality_crf.features_of(x, x in lines[:k], lines[k - 1] if k else None) for k, x in enumerate(lines)]
        sizes = list(map(len, lines))
        n, zero = len(rows), [0.0] * len(rows[0])
        emit = []
        for k, row in enumerate(rows):
            x = [*row, *(max(v - h, 0) for hinge in model.hinges for v, h in zip(row, hinge)), *(rows[k - 1] if k else zero), *(rows[k + 1] if k + 1 < n else zero), float(k == 0), float(k == n - 1)]
            emit.append(sum(w * (v - m) / s for w, v, m, s in zip(model.w, x, model.mean, model.scale)) + model.b)
        total, of_good = 0.0, [0.0] * n
        for path in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(e for e, state in zip(emit, path) if state) + sum(model.t[a, b] for a, b in zip(path, path[1:])))
            total += weight
            of_good = [g + weight * state for g, state in zip(of_good, path)]
        p = sum(size * g / total for size, g in zip(sizes, of_good)) / sum(sizes)
        assert value == pytest.approx(math.log((p + 1e-6) / (1 - p + 1e-6)), abs=1e-6)
    assert (model.score(good) > 0.5).all() and (model.score(bad) < 0.5).all()


def held_out_accuracy(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    hit = [(r.predicted == y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    return np.mean(hit), len(hit)


def test_quality_held_out(spark):
    d, la = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_crf.score_documents(d, quality_crf.train(d, la)).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    acc, n = held_out_accuracy(rows, la, "quality")
    assert n > 40 and acc > 0.95


def test_toxicity_held_out(spark):
    d, la = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    d = d.join(la.select("doc_id"), "doc_id")
    rows = toxicity_mil.toxicity(d, toxicity_mil.train(d, la)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    acc, n = held_out_accuracy(rows, la, "toxic")
    assert n > 500 and acc > 0.95


def test_sample_never_holds_held_out_rows(spark, docs, labels):
    texts, y, w = training.labelled_sample(docs, labels, "quality", 5, 0)
    out = {r.text for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    inside = {r.text for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert set(texts) <= inside and len(texts) == len(y) == len(w) and out


def test_noisy_or_finds_the_sentence(spark):
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    make = lambda bad: " ".join(" ".join(r.choice(words, 6)) + (" vile." if bad and k == 2 else ".") for k in range(5))
    y = np.arange(200) % 2
    model = toxicity_mil.NoisyOr().fit([make(b) for b in y], y.astype(float), np.ones(200))
    assert model.score([make(1)])[0] > 0.9 > 0.1 > model.score([make(0)])[0]
    found = toxicity_mil.offending_sentences(spark.createDataFrame([(1, make(1)), (2, make(0)), (3, None)], "doc_id long, text string"), model).collect()
    assert [(f.doc_id, f.sentence_no) for f in found] == [(1, 2)] and "vile" in found[0].sentence


def brute_score(model, text):
    """1 - prod(1 - p) over all sentences, each summed by hand."""
    clean = 1.0
    for s in toxicity_mil.sentences(text):
        words = set(re.findall(r"[^\W\d_]+", s.lower()))
        z = model.bias + sum(model.weights.get(m, 0.0) for w in words for m in [w, *(w[:k] + "-" for k in (4, 5, 6, 7, 8) if len(w) > k)])
        clean *= (1 + math.exp(toxicity_mil.SHARP * z)) ** (-1 / toxicity_mil.SHARP)
    return 1 - clean


@pytest.mark.parametrize("span", [1 << 16, 8])
def test_scores_equal_a_plain_noisy_or(monkeypatch, span):
    monkeypatch.setattr(toxicity_mil, "_SPAN", span)
    r = random.Random(2)
    words = ["vile", "vilest", "trash", "garbage", "kind", "lovely", "Hateful", "ok"]
    model = toxicity_mil.NoisyOr().fit([], np.zeros(0), np.zeros(0))
    model.weights = {m: r.uniform(-2, 3) for w in words for m in toxicity_mil.marks_of(w.lower())}
    model.bias = -2.0
    texts = ["", " \n", *(" ".join(r.choice(words) + r.choice(["", "", ".", "!", "\n"]) for _ in range(r.randrange(1, 150))) for _ in range(60))]
    assert model.score(texts) == pytest.approx([brute_score(model, t) for t in texts], abs=1e-6)


def test_training_lowers_the_loss_of_the_scored_formula():
    """A step away from the trained weights in any drawn direction makes the loss of ``score`` no smaller."""
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    make = lambda bad: " ".join(" ".join(r.choice(words, 6)) + (" vile." if bad and k == 2 else ".") for k in range(5))
    y = np.arange(120) % 2
    texts = [make(b) for b in y]
    model = toxicity_mil.NoisyOr().fit(texts, y.astype(float), np.ones(120))

    def loss(weights, bias):
        other = toxicity_mil.NoisyOr()
        other.weights, other.bias = weights, bias
        p = np.concatenate([other.score(texts), other.score([toxicity_mil._ENDS.sub(" ", t) for t in texts])])
        label = np.tile(y, 2)
        return np.where(label == 1, -np.log(p + 1e-300), -toxicity_mil.CLEAN * np.log1p(-p)).mean() + toxicity_mil.RIDGE / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.bias)
    none = dict.fromkeys(model.weights, 0.0)
    assert best < loss(none, -1.0) / 5 and best < min(loss(none, b) for b in np.linspace(-6, 2, 17))
    assert best < loss({m: w / 2 for m, w in model.weights.items()}, model.bias)


def test_length_alone_is_not_toxic(spark):
    """Clean documents joined to a megabyte stay clean, with and without ends of sentences; a toxic sentence among them is found."""
    d, la = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_mil.train(d, la)
    texts = {k: [r.text for r in d.join(la.where(f"toxic = {k}"), "doc_id").orderBy("doc_id").collect()] for k in (0, 1)}
    clean = [t for t, s in zip(texts[0], model.score(texts[0])) if s < toxicity_mil.THRESHOLD]
    bad = max((s for t in texts[1] for s in toxicity_mil.sentences(t)), key=lambda s: model.sentence_scores(s)[0])
    for seed in range(8):
        order = np.random.default_rng(seed).permutation(len(clean))
        joined = "\n".join([clean[i] for i in order])[:1_000_000].rsplit("\n", 1)[0]
        assert len(joined) > 900_000
        half = joined.index("\n", len(joined) // 2)
        endless = " ".join(re.findall(r"[^\W\d_]+", joined))
        before, after, plain = model.score([joined, joined[:half] + "\n" + bad + joined[half:], endless])
        assert before < toxicity_mil.THRESHOLD and plain < toxicity_mil.THRESHOLD and after > 0.9
    assert model.score(["\n".join(clean)])[0] < toxicity_mil.THRESHOLD
    found = model.score(texts[1])
    assert np.mean(found >= toxicity_mil.THRESHOLD) > 0.9


def test_long_sentences_count_in_pieces():
    text = " ".join(f"w{chr(97 + i % 26)}, 7" for i in range(200)) + ". Short one"
    got = toxicity_mil.sentences(text)
    assert "".join(got[:-1]) + " " + got[-1] == text and got[-1] == "Short one"
    assert [len(re.findall(r"[^\W\d_]+", s)) for s in got] == [64, 64, 64, 8, 2]


def test_odd_tables(spark, odd_docs, empty_docs, labels):
    none = spark.createDataFrame([], labels.schema)
    odd_labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 0), (6, 0, 0), (7, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for la in (none, odd_labels):
        for train, apply, keep in ((quality_crf.train, quality_crf.score_documents, quality_crf.keep_good), (toxicity_mil.train, toxicity_mil.toxicity, toxicity_mil.keep_clean)):
            model = train(odd_docs, la)
            rows = apply(odd_docs, model).collect()
            assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
            kept = keep(odd_docs, model)
            good = sum(r.predicted == (keep is quality_crf.keep_good) for r in rows)
            assert kept.columns == odd_docs.columns and kept.count() == good
            assert apply(empty_docs, train(empty_docs, la)).collect() == []
            assert keep(empty_docs, model).collect() == []
