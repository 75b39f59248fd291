"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; its words are runs of letters, with one space on either side.  An n-gram is 1 to 3 characters
of that, packed into a 64-bit number (21 bits a character), so nothing is hashed and profiles can be read.  A
language's profile is its `TOP` most frequent n-grams in order; a text's likewise.  The out-of-place distance adds, for
each n-gram of the text, the difference of its two ranks, or `TOP` where the profile lacks it; the least wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remainder, small_batches

TOP = 300
_PART = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Letters as code point + 1, and 1 for each run of anything else and either end; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_letters()[points], points + 1, 1)
    if not (codes > 1).any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate([[1], codes, [1]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 1) | (codes[:-1] > 1)
    return codes[keep].astype(np.uint64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts."""
    codes = _codes(text or "")
    all_grams, all_counts = [], []
    for s in range(0, len(codes), _PART):
        c = codes[s : s + _PART + 2]
        own = min(_PART, len(codes) - s)
        one = c[:own] << np.uint64(42)
        two = one[: len(c) - 1] | (c[1 : own + 1] << np.uint64(21))
        three = two[: max(0, len(c) - 2)] | c[2 : own + 2]
        three = three[c[1 : len(three) + 1] > 1]
        g, n = np.unique(np.concatenate([one[c[:own] > 1], two, three]), return_counts=True)
        all_grams.append(g)
        all_counts.append(n)
    if len(all_grams) < 2:
        return (all_grams[0], all_counts[0]) if all_grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return merged(all_grams, all_counts)


def merged(all_grams: list[np.ndarray], all_counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate(all_grams), return_inverse=True)
    return g, np.bincount(at, np.concatenate(all_counts), len(g)).astype(np.int64)


def spelled(gram: int) -> str:
    """The characters of a packed n-gram, a space as _."""
    parts = [(gram >> s) & 0x1FFFFF for s in (42, 21, 0)]
    return "".join("_" if p == 1 else chr(p - 1) for p in parts if p)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    known: np.ndarray
    #: Rank of each known n-gram in each language, `top` where it lacks it.
    ranks: np.ndarray
    top: int = TOP

    def predict(self, text: str | None) -> tuple[str, float]:
        g, n = grams(text)
        if not len(g) or not self.languages:
            return UNKNOWN, 0.0
        if len(g) > self.top:
            least = np.partition(n, len(n) - self.top)[len(n) - self.top]
            at = np.flatnonzero(n >= least)
            g, n = g[at], n[at]
        mine = g[np.argsort(-n, kind="stable")[: self.top]]
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        hit = self.known[at] == mine
        place = np.arange(len(mine))[hit, None]
        ranks = self.ranks[at[hit]]
        away = np.where(ranks < self.top, np.abs(ranks - place), self.top).sum(axis=0) + self.top * int((~hit).sum())
        best = int(np.argmin(away))
        return self.languages[best], 1 - float(away[best]) / (self.top * len(mine))


def profiles(docs: DataFrame, *, modulus: int = 4, held_out: int = 2, top: int = TOP) -> DataFrame:
    """lang, place (0 first), gram, n: learned from the whole texts of all documents with a lang, outside the held-out fold."""
    fold = remainder(F.col("doc_id"), modulus)
    seen = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & fold.isNotNull() & (fold != held_out))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list, list]] = {}

        def out(lang: str) -> pa.RecordBatch:
            g, n, _ = held.pop(lang)
            g, n = merged(g, n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang")):
                g, n = grams(text.as_py())
                gs, ns, size = held.setdefault(lang.as_py(), ([], [], [0]))
                gs.append(g)
                ns.append(n)
                size[0] += len(g)
                if size[0] > _PART:
                    g, n = merged(gs, ns)
                    held[lang.as_py()] = ([g], [n], [len(g)])
                    if len(g) > _PART // 2:
                        yield out(lang.as_py())
        for lang in list(held):
            yield out(lang)

    total = seen.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return total.withColumn("place", place).where(F.col("place") < top).select("lang", "place", "gram", "n")


def train(docs: DataFrame, *, modulus: int = 4, held_out: int = 2, top: int = TOP) -> LanguageModel:
    """The learned profiles, at most `top` rows a language."""
    small_batches(docs.sparkSession)
    rows = profiles(docs, modulus=modulus, held_out=held_out, top=top).toArrow()
    languages = tuple(sorted(set(rows["lang"].to_pylist())))
    gram = rows["gram"].to_numpy().view(np.uint64)
    known, at = np.unique(gram, return_inverse=True)
    ranks = np.full((len(known), len(languages)), top, np.int64)
    ranks[at, [languages.index(x) for x in rows["lang"].to_pylist()]] = rows["place"].to_numpy()
    return LanguageModel(languages, known, ranks, top)


def predict(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score); lang is `und` and score 0 for a text that is null or has no letter, or when no language was learned.  Of equally near languages the first by code point wins."""

    @F.arrow_udf("lang string, score double")
    def language(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return language(text)
