"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text is a sequence of tokens: runs of letters, digits and non-ASCII characters, and runs of ASCII punctuation.
Its features are the hashes of its tokens and token pairs, and of two marks: a token equals the one before it, or
the one before that.  A feature that occurs c times weighs 1 + ln c, and a text's weights have length 1.  Scoring is
a gather of the dense weight vector at a text's features and one segmented sum, a sparse dot product.

Only the text is read.  Training takes a bounded sample of labelled rows (`rows`), so its cost doesn't grow; every
document is scored, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import frugal, give_back, labelled_sample

BITS = 18
TRAIN_ROWS = 8_000
_MARKS = K.mix(np.array([11, 12], np.uint64))


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and counts of all texts, one text after another, and the number of features of each."""
    hashes, counts = K.words(texts, kinds=K.KIND)
    text = np.repeat(np.arange(len(counts)), counts)
    keys, owners = [hashes], [text]
    if len(hashes) > 1:
        same = text[1:] == text[:-1]
        keys.append(K.mix(hashes[:-1] * np.uint64(0xF1357AEA2E62A9C5) + hashes[1:])[same])
        owners.append(text[1:][same])
        for back, mark in ((1, _MARKS[0]), (2, _MARKS[1])):
            again = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
            owners.append(text[back:][again])
            keys.append(np.full(len(owners[-1]), mark, np.uint64))
    key = np.concatenate(keys) >> np.uint64(64 - bits)
    both = (np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | key
    both, times = np.unique(both, return_counts=True)
    owner, number = (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return number, times, np.bincount(owner, minlength=len(counts))


def weighed(times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weights of features that occur so many times, for texts of so many features one after another: of length 1 for each text."""
    value = 1 + np.log(times)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return value / np.sqrt(np.bincount(owner, value * value, len(sizes)))[owner]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, bounds = K.raw(texts)
        out = np.empty(len(texts))
        for i, j in K.groups(bounds, 4 * K.BLOCK):
            number, times, sizes = features(texts.slice(i, j - i), self.bits)
            dots = np.bincount(np.repeat(np.arange(j - i), sizes), self.weights[number] * weighed(times, sizes), j - i)
            out[i:j] = 1 / (1 + np.exp(-np.clip(dots + self.bias, -35, 35)))
        return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-Proximal with a step size per coordinate, on rows of feature numbers and counts; the last coordinate is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def solved(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = np.append(rows[k][0], size - 1), np.append(weighed(rows[k][1], np.array([len(rows[k][1])])), 1.0)
            w = solved(z[at], n[at])
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    weights = solved(z, n)
    return weights[:-1].astype(np.float32), float(weights[-1])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS, bits: int = BITS) -> QualityModel:
    """Learns labels.`label` from at most `rows` labelled documents outside the held-out fold.

    Without labelled rows every score is 0.5; with one class only, it is near that class.  Several rows of a doc_id
    count once: with the greatest label and text.  Long texts count whole.
    """
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)

    @frugal
    def hashed(batches):
        for b in batches:
            number, times, sizes = features(b.column("text"), bits)
            ends = np.cumsum(sizes)
            at = [number[e - s : e].astype("<i4").tobytes() for s, e in zip(sizes, ends)]
            n = [times[e - s : e].astype("<u1" if times[e - s : e].max(initial=0) < 256 else "<u4").tobytes() for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["label", "at", "times"])

    # one partition of the sample at a time comes to the driver
    rows, found = [], []
    for row in sample.orderBy("doc_id").mapInArrow(hashed, "label int, at binary, times binary").toLocalIterator():
        rows.append((np.frombuffer(row.at, "<i4"), np.frombuffer(row.times, "<u1" if 4 * len(row.times) == len(row.at) else "<u4")))
        found.append(row.label)
    if not rows:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits)
    model = QualityModel(*ftrl(rows, np.array(found), bits), bits)
    del rows
    give_back()
    return model


def score(text: Column, model: QualityModel) -> Column:
    """Probability of label 1 for a text column, by the text alone: repeated texts get one score, a null or empty text the bias alone."""

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        scores = pa.array(model.scores(texts), pa.float64())
        give_back()
        return scores

    return quality_score(text)
