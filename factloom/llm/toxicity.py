"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed sequences of 4 to 6 characters of the lower-cased text with a space at either end, present or
absent.  Training counts in how many toxic and clean texts each occurs; the smoothed log ratio r of the two is the
feature's scale.  Features whose ratio differs from 0 by `SURE` standard errors or more, for either label, stay, however
many they are, and a logistic regression is fitted to presence times r.  Scoring hashes every position of a text, looks
the hashes up in a dense table of weight times r and sums those of the distinct features found.

Only the text is read.  Training takes a bounded sample of labelled rows (`rows`); every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import frugal, give_back, labelled_sample

BITS = 20
SIZES = (4, 5, 6)
TRAIN_ROWS = 12_000
SURE = 2.75
_CHUNK = 1 << 14


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Lower-cased texts between spaces, in blocks: characters, bounds, number of the first text.  A long text comes in parts that overlap by the longest n-gram less one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds = K.raw(texts)
    for i, j in K.groups(bounds):
        padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.utf8_lower(texts[i:j]), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, ends = K.raw(padded)
        data, ends = data[ends[0] : ends[-1]], ends - ends[0]
        if data.max() > 127:
            at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
            data, ends = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), np.searchsorted(at, ends)
        if len(data) <= 2 * K.BLOCK:
            yield data, ends, i
            continue
        for s in range(0, len(data), K.BLOCK):
            part = data[s : s + K.BLOCK + SIZES[-1] - 1]
            yield part, np.array([0, len(part)]), i


def occurrences(texts: pa.Array, table: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; table: only features where it isn't 0."""
    found = []
    for data, bounds, first in blocks(texts):
        for n in SIZES:
            hashes, at = K.grams(data, bounds, n)
            number = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            if table is not None:
                hit = np.flatnonzero(table[number])
                number, at = number[hit], at[hit]
            owner = np.searchsorted(bounds, at, "right") - 1 + first
            found.append(np.unique((owner.astype(np.int64) << bits) | number))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass(frozen=True)
class ToxicityModel:
    #: Weight times log-count ratio of each feature, 0 for most.
    table: np.ndarray
    bias: float
    bits: int = BITS

    def __reduce__(self):
        some = np.flatnonzero(self.table)  # few, so a task is sent no more
        return _filled, (some.astype("<i4"), self.table[some], self.bias, self.bits)

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, number = occurrences(texts, self.table, self.bits)
        dots = np.bincount(owner, self.table[number], len(texts))
        return 1 / (1 + np.exp(-np.clip(dots + self.bias, -35, 35)))


def _filled(some: np.ndarray, values: np.ndarray, bias: float, bits: int) -> ToxicityModel:
    table = np.zeros(1 << bits, values.dtype)
    table[some] = values
    return ToxicityModel(table, bias, bits)


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-count ratios, and how many standard errors each is from 0, below it with a minus."""
    p, q = toxic + alpha, clean + alpha
    r = np.log(p / (n_toxic + 2 * alpha)) - np.log(q / (n_clean + 2 * alpha))
    return r, r / np.sqrt(1 / p + 1 / q)


def fit(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, *, epochs: int = 8, rate: float = 0.1, l2: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features (r: their ratios), by AdaGrad; rows: feature numbers of each text."""
    w, seen, bias, seen_bias = np.zeros(len(r)), np.full(len(r), 1e-8), 0.0, 1e-8
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = rows[k]
            x = r[at]
            g = 1 / (1 + np.exp(-np.clip(bias + w[at] @ x, -35, 35))) - labels[k]
            step = g * x + l2 * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen_bias += g * g
            bias -= 0.5 * g / np.sqrt(seen_bias)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS, sure: float = SURE, bits: int = BITS) -> ToxicityModel:
    """Learns labels.`label` from at most `rows` labelled documents outside the held-out fold.

    Without labelled rows every score is 0.5; with one class only, every score is near that class.  Several rows of a
    doc_id count once: with the greatest label and text.  Long texts count whole.
    """
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)

    @frugal
    def counted(batches):
        counts, rows_of = np.zeros((2, 1 << bits), np.uint32), np.zeros(2, np.int64)
        for b in batches:
            is_toxic = b.column("label").to_numpy()
            _, bounds = K.raw(b.column("text"))
            for i, j in K.groups(bounds):
                owner, number = occurrences(b.column("text").slice(i, j - i), None, bits)
                for k in (0, 1):
                    np.add.at(counts[k], number[is_toxic[i:j][owner] == k], np.uint32(1))
            rows_of += np.bincount(is_toxic, minlength=2)
        for c in range((1 << bits) // _CHUNK):
            part = counts[:, c * _CHUNK : (c + 1) * _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array(rows_of[:1]), pa.array(rows_of[1:]), pa.array([part.tobytes()], pa.binary())], ["chunk", "clean", "toxic", "counts"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.uint32) for c in t["counts"].to_pylist())
        return pa.table({"chunk": t["chunk"][:1], "clean": [pc.sum(t["clean"]).as_py()], "toxic": [pc.sum(t["toxic"]).as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, clean long, toxic long, counts binary"
    parts = sample.mapInArrow(counted, schema).groupBy("chunk").applyInArrow(summed, schema).toArrow().sort_by("chunk")
    if not parts.num_rows or parts["clean"][0].as_py() + parts["toxic"][0].as_py() == 0:
        return ToxicityModel(np.zeros(1 << bits), 0.0, bits)
    counts = np.concatenate([np.frombuffer(c, np.uint32).reshape(2, _CHUNK) for c in parts["counts"].to_pylist()], axis=1)
    r, above = ratios(counts[1].astype(float), counts[0].astype(float), parts["toxic"][0].as_py(), parts["clean"][0].as_py())
    best = np.flatnonzero(np.abs(above) >= sure)
    chosen = np.zeros(1 << bits, np.int8)
    chosen[best] = 1
    r, kind = r[best], "<u2" if len(best) <= 1 << 16 else "<u4"
    del counts, parts, above

    @frugal
    def selected(batches):
        for b in batches:
            owner, number = occurrences(b.column("text"), chosen, bits)
            cuts, place = np.searchsorted(owner, np.arange(b.num_rows + 1)), np.searchsorted(best, number).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([place[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())], ["label", "at"])

    # one partition of the sample at a time comes to the driver
    found = [(row.label, np.frombuffer(row.at, kind)) for row in sample.orderBy("doc_id").mapInArrow(selected, "label int, at binary").toLocalIterator()]
    w, bias = fit([at for _, at in found], np.array([label for label, _ in found]), r)
    table = np.zeros(1 << bits, np.float32)
    table[best] = w * r
    del found
    give_back()
    return ToxicityModel(table, bias, bits)


def score(text: Column, model: ToxicityModel) -> Column:
    """Probability of label 1 for a text column, by the text alone: repeated texts get one score, a null or empty text the bias alone."""

    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        scores = pa.array(model.scores(texts), pa.float64())
        give_back()
        return scores

    return toxicity_score(text)
