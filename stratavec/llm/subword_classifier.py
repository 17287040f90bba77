"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words and of the character
n-grams inside them, all hashed into one table; a softmax layer turns it into
class probabilities.  Table and layer are trained by stochastic gradient descent
in numpy on at most ``SAMPLE_ROWS`` labelled documents (the documented bound;
everything else covers all rows).  Scoring needs only each vector's contribution
to the logit, so what a task receives is one number per bucket.

Features are hashed for a whole text at a time with array arithmetic over its code
points: no word is looked at in Python.  Pairs of neighbouring words are features too, and all
pairs of equal words share one more.

Defined cases: null and empty texts have no features and get the learned prior;
a label that is null or no number is not used, of repeated labels of a document the
smallest counts, and of rows with one id the one with the smallest features is learned
from; without labels every score is 0.5, with labels of one class only the prior decides.
Rows without an id are scored and count as not held out; repeated rows are scored each;
texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 3
HELD_OUT_FOLD = 1
# bound of the training sample, and of the bytes of one training text's buckets
SAMPLE_ROWS = 2000
BUCKETS = 1 << 16
DIMENSION = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 17
# characters of text hashed at once
STRETCH = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _bucket(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(29))
    return ((value * _MIX) >> _SHIFT).astype(np.int32)


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of about ``STRETCH`` characters that end with a word."""
    start = 0
    while start < len(text):
        end = min(len(text), start + STRETCH)
        if end < len(text):
            cut = text.rfind(" ", start, end)
            end = cut if cut > start else end
        yield text[start:end]
        start = end


def _hashed(part: str) -> np.ndarray:
    """Buckets of all features of one stretch, repeats included."""
    data = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    code = np.where(space, 32, data).astype(np.uint64) + np.uint64(1)
    seen = np.cumsum(space)
    out = []
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        value = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            value = value * _STEP + code[k : k + m]
        # only the first and the last character may be white space
        inner = seen[n - 2 : n - 2 + m] == seen[:m]
        out.append(_bucket(value[inner]))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(starts):
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        place = np.arange(len(data)) - np.repeat(
            np.r_[0, starts], np.diff(np.r_[0, starts, len(data)])
        )
        weight = np.cumprod(np.full(int(place.max()) + 1, _MIX), dtype=np.uint64)
        terms = np.where(space, np.uint64(0), code * weight[place])
        words = np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64)
        out.append(_bucket(words))
        out.append(_bucket(words[:-1] * _STEP + words[1:] * _PAIR))
        again = int((words[1:] == words[:-1]).sum())
        out.append(np.zeros(again, dtype=np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for part in _stretches(text):
        total += np.bincount(_hashed(part), minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets.astype(np.uint16), total[buckets].astype(np.float32)


@F.arrow_udf(T.StructType([T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType())]))
def _features(texts: pa.Array) -> pa.Array:
    rows = [feature_counts(t or "") for t in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [
            pa.array([b.tobytes() for b, _ in rows], pa.binary()),
            pa.array([c.tobytes() for _, c in rows], pa.binary()),
        ],
        names=["b", "c"],
    )


class Model:
    """What scoring needs: the logit contribution of every bucket, and the bias."""

    def __init__(self, contribution: np.ndarray, bias: float):
        self.contribution, self.bias = contribution, bias

    def score(self, text: str) -> float:
        total, count = 0.0, 0
        for part in _stretches(text):
            hashed = _hashed(part)
            total += float(self.contribution[hashed].sum(dtype=np.float64))
            count += len(hashed)
        logit = self.bias + (total / count if count else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """``rows`` of (label, buckets, counts).  Plain SGD, one document a step."""
    positive = sum(label for label, _, _ in rows)
    if not rows:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    if positive in (0, len(rows)):
        return Model(np.zeros(BUCKETS, dtype=np.float32), 4.0 if positive else -4.0)
    generator = np.random.default_rng(SEED)
    table = generator.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    table = table.astype(np.float32)
    layer = np.zeros((2, DIMENSION), dtype=np.float32)
    bias = np.log(np.array([len(rows) - positive, positive], dtype=np.float32) / len(rows))
    total_steps = EPOCHS * len(rows)
    step = 0
    for _ in range(EPOCHS):
        for k in generator.permutation(len(rows)):
            label, buckets, counts = rows[k]
            buckets = buckets.astype(np.int64)
            rate = RATE * (1 - step / total_steps)
            step += 1
            weights = counts / counts.sum() if len(counts) else counts
            vectors = table[buckets]
            mean = weights @ vectors if len(counts) else np.zeros(DIMENSION, dtype=np.float32)
            logits = layer @ mean + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
            # scaled by the number of features: an averaged vector moves as one word would
            table[buckets] = vectors - (rate * len(counts) * weights)[:, None] * back
    difference = layer[1] - layer[0]
    return Model((table @ difference).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on the labelled documents outside the held-out fold.

    Of these the ``sample_rows`` with the smallest hash of their id are taken;
    their ids are a bounded broadcast, so no text is shuffled.
    """
    usable = (
        labels.select("doc_id", F.col("quality").cast("string").try_cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.struct("label", _features(F.col("text")).alias("f")).alias("s"))
        .groupBy("doc_id")
        .agg(F.min("s").alias("s"))  # an id on many rows is one example
        .select("doc_id", "s.label", "s.f.b", "s.f.c")
        .toArrow()
    )
    order = sorted(
        range(len(rows)), key=lambda i: (rows["doc_id"][i].as_py(), rows["b"][i].as_py())
    )
    # views of the received buffers, not copies
    examples = [
        (
            rows["label"][i].as_py(),
            np.frombuffer(rows["b"][i].as_buffer(), dtype=np.uint16),
            np.frombuffer(rows["c"][i].as_buffer(), dtype=np.float32),
        )
        for i in order
    ]
    return train(examples)


def scores(model: Model):
    """Column function: probability of label 1 of a whole text."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and class of every document."""
    score = scores(fit(docs, labels))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(
    docs: DataFrame, labels: DataFrame, training: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` whose predicted class is 1, unchanged.

    The model learns from ``training``, or from ``docs`` if that is not given.
    Where earlier filters have left one class only, there is nothing to learn
    from ``docs`` themselves.
    """
    score = scores(fit(docs if training is None else training, labels))
    return docs.filter(score(F.col("text")) >= 0.5)
