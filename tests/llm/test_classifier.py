"""Features and training of the classifier against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stratavec.llm import subword_classifier as C

MASK = (1 << 64) - 1
MIX, STEP, PAIR = (int(x) for x in (C._MIX, C._STEP, C._PAIR))


def bucket(value: int) -> int:
    value ^= value >> 29
    return (value * MIX & MASK) >> int(C._SHIFT)


def plain_features(text: str) -> Counter:
    """Words, pairs of words and character n-grams of a short text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out: Counter = Counter()
    hashes = []
    for word in words:
        value = sum((ord(c) + 1) * MIX ** (k + 1) for k, c in enumerate(word)) + len(word)
        hashes.append(value & MASK)
        out[bucket(value & MASK)] += 1
    for a, b in zip(hashes, hashes[1:]):
        out[bucket((a * STEP + b * PAIR) & MASK)] += 1
        out[0] += a == b
    padded = re.sub(r"[\x20\x09-\x0D]", " ", f" {text} ")
    for n in C.GRAMS:
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if " " not in gram[1:-1]:
                value = n
                for c in gram:
                    value = (value * STEP + ord(c) + 1) & MASK
                out[bucket(value)] += 1
    return Counter({k: v for k, v in out.items() if v})


def test_features():
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "word word", "\t", ".", "long-word"]
    for _ in range(200):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        buckets, counts = C.feature_counts(text)
        got = Counter(dict(zip(buckets.tolist(), map(int, counts.tolist()))))
        assert got == plain_features(text), repr(text)


def test_one_step_is_the_gradient(monkeypatch):
    """A first step with one example moves against the gradient of its loss."""
    monkeypatch.setattr(C, "EPOCHS", 1)
    rows = [(1, *C.feature_counts("good words here")), (0, *C.feature_counts("bad bad words"))]
    order = np.random.default_rng(C.SEED)
    table = order.uniform(-1 / C.DIMENSION, 1 / C.DIMENSION, (C.BUCKETS, C.DIMENSION)).astype(np.float32)
    layer = [[0.0] * C.DIMENSION for _ in range(2)]
    bias = [math.log(0.5)] * 2
    table = table.astype(float)
    for step, k in enumerate(order.permutation(2)):
        label, buckets, counts = rows[k]
        rate = C.RATE * (1 - step / 2)
        total = float(sum(counts))
        share = [float(c) / total for c in counts]
        mean = [sum(s * table[b][d] for s, b in zip(share, buckets)) for d in range(C.DIMENSION)]
        logits = [sum(w * m for w, m in zip(layer[c], mean)) + bias[c] for c in range(2)]
        odds = [math.exp(z - max(logits)) for z in logits]
        error = [o / sum(odds) - (c == label) for c, o in enumerate(odds)]
        back = [sum(error[c] * layer[c][d] for c in range(2)) for d in range(C.DIMENSION)]
        for c in range(2):
            layer[c] = [w - rate * error[c] * m for w, m in zip(layer[c], mean)]
            bias[c] -= 0.1 * rate * error[c]
        for s, b in zip(share, buckets):
            for d in range(C.DIMENSION):
                table[b][d] -= rate * len(counts) * s * back[d]
    model = C.train(rows)
    difference = [layer[1][d] - layer[0][d] for d in range(C.DIMENSION)]
    for _, buckets, _ in rows:
        for b in buckets:
            want = sum(table[b][d] * difference[d] for d in range(C.DIMENSION))
            assert model.contribution[b] == pytest.approx(want, abs=1e-5)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-6)


def test_score_is_the_average():
    text = "some words and some more words"
    model = C.train([(1, *C.feature_counts(text)), (0, *C.feature_counts("others entirely"))])
    features = plain_features(text)
    logit = model.bias + sum(n * float(model.contribution[b]) for b, n in features.items()) / sum(
        features.values()
    )
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_labels_that_are_no_numbers(spark, docs_of):
    docs = docs_of(["good text here", "bad text", "x"])
    labels = spark.createDataFrame([(0, "1"), (1, "none"), (2, None)], "doc_id long, quality string")
    assert len(C.classify(docs, labels).collect()) == 3
