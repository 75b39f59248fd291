"""All of many patterns in a text, in one pass over its characters: an Aho-Corasick automaton as literal arrays.

The automaton is built by the driver from the patterns.  Its complete transition table (state x character class) and the
patterns that end in each state are two array literals, whatever the number of patterns, and matching is a fold over the
classes of a text's characters, so the plan has the same size for ten patterns and for ten thousand.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Automaton:
    #: The characters of the patterns; a character's class is its place from 1, and 0 is any other.
    alphabet: str
    #: next[state * (len(alphabet) + 1) + class]
    next: tuple[int, ...]
    #: Numbers of the patterns that end in a state.
    ends: tuple[tuple[int, ...], ...]


def automaton(patterns: Sequence[str]) -> Automaton:
    """The automaton of distinct, non-empty patterns; it finds overlapping and nested ones."""
    if len(set(patterns)) < len(patterns) or "" in patterns:
        raise ValueError("patterns must be distinct and not empty")
    alphabet = "".join(sorted(set("".join(patterns))))
    width = len(alphabet) + 1
    place = {c: i for i, c in enumerate(alphabet, 1)}
    rows: list[list[int]] = [[-1] * width]
    ends: list[list[int]] = [[]]
    for number, pattern in enumerate(patterns):
        state = 0
        for c in pattern:
            if rows[state][place[c]] < 0:
                rows[state][place[c]] = len(rows)
                rows.append([-1] * width)
                ends.append([])
            state = rows[state][place[c]]
        ends[state].append(number)
    # level by level, each missing transition becomes that of the longest proper suffix that is a state
    suffix, queue = [0] * len(rows), deque([0])
    while queue:
        state = queue.popleft()
        for k in range(width):
            to, other = rows[state][k], rows[suffix[state]][k] if state else 0
            if to < 0:
                rows[state][k] = other
            else:
                suffix[to] = other
                ends[to] = ends[to] + ends[other]
                queue.append(to)
    return Automaton(alphabet, tuple(x for row in rows for x in row), tuple(map(tuple, ends)))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def found(text: Column, a: Automaton) -> Column:
    """Numbers of the patterns that occur in a text, ascending; none for a null or empty text."""
    width = len(a.alphabet) + 1
    classes = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(a.alphabet), c)))
    table, ends = _literal(a.next, "array<int>"), _literal(a.ends, "array<array<int>>")
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("hits"))

    def step(acc: Column, c: Column) -> Column:
        state = F.get(table, acc["state"] * width + c)
        more = F.get(ends, state)
        return F.struct(state.alias("state"), F.when(F.size(more) > 0, F.array_union(acc["hits"], more)).otherwise(acc["hits"]).alias("hits"))

    return F.array_sort(F.aggregate(classes, start, step, lambda acc: acc["hits"]))
