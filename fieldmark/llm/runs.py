"""Periodic runs of words, in linear time over an ordered alphabet (after Ellert and Fischer, 2021).

A run is a stretch of words with a smallest period p, at least 2p long, that no neighbouring word extends. By the runs theorem each
has a root that is the longest Lyndon word at its start, in the order of words or in the reverse order. That Lyndon word ends where
the next smaller suffix starts, so both Lyndon arrays are computed: suffixes are met from left to right, a stack holds those that
have not met a smaller one, and each comparison gives an edge with the number of words that match. Words are only ever compared
with each other: there is no hash, no number and no suffix structure. What was matched is not matched again. The furthest match says
that a window repeats earlier words; two suffixes within it match as far as the two that stand there in the earlier copy, which are
an edge already, so comparing starts at the window's end. A comparison that matches moves that end on, one that does not ends an edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import map_rows, quoted, without

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def lyndon_edges(words: list, falling: bool = False) -> tuple[list[int], list[int]]:
    """For each suffix, where the next smaller one starts (the length of ``words`` if none does) and how many words the two share.

    ``words`` are any values with an order; with ``falling`` the order is reversed. The end is smaller than every word in both.
    """
    n = len(words)
    smaller, match = [n] * n, [0] * n
    before, match_before = [-1] * n, [0] * n
    # words[at:end] repeats the words ``gap`` places before.
    at = end = gap = 0
    stack: list[int] = []
    for right in range(n):
        word = words[right]
        while stack:
            left = stack[-1]
            other = words[left]
            if other != word:
                m = 0
                down = (word < other) is not falling
            else:
                m, more = 1, True
                if right < end:
                    to, of = right - gap, left - gap if left >= at else left
                    if smaller[of] == to:
                        m, more = match[of], False
                    elif before[to] == of:
                        m, more = match_before[to], False
                    if not more and m >= end - right:
                        m, more = end - right, True
                if more:
                    while right + m < n and words[left + m] == words[right + m]:
                        m += 1
                    if right + m > end:
                        at, end, gap = right, right + m, right - left
                down = right + m == n or (words[right + m] < words[left + m]) is not falling
            if not down:
                before[right], match_before[right] = left, m
                break
            smaller[left], match[left] = right, m
            stack.pop()
        stack.append(right)
    return smaller, match


def word_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs of at least ``least`` words: (start, length, period), in that order."""
    n, found = len(words), set()
    for falling in (False, True):
        smaller, match = lyndon_edges(words, falling)
        for i, m in enumerate(match):
            if not m:
                continue
            j = smaller[i]
            p, k = j - i, 2 * i - j
            # One root earlier stands the same root: the run is found there.
            if k >= 0 and smaller[k] == i and match[k] >= p:
                continue
            back, most = 0, min(p - 1, i)
            if p + most + m < least or most + m < p:
                continue
            while back < most and words[i - 1 - back] == words[j - 1 - back]:
                back += 1
            if back + m >= p and p + back + m >= least:
                found.add((i - back, p + back + m, p))
    return sorted(found)


def _kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that stand in a run after its first period."""
    out, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at:lo]
        at = max(at, hi)
    return out + words[at:] if at else words


def find_runs(docs: DataFrame, *, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period of each run of at least ``least`` words, by start, then period) and ``collapsed``
    (the text of the words left when each run is cut to its first period, joined by one space).

    Words are maximal runs of other than ASCII white space, compared byte by byte, and numbered from 0. A text that is null, empty or
    blank has no runs and collapses to the empty text. Every row is judged by itself, in a narrow map, so repeated rows, ties and frequent
    keys do not matter; a text is read whole, in memory of a few times its size. Input columns of the added names are replaced.
    """
    docs = without(docs, "runs", "collapsed")
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        runs, offsets, texts = [], [0], []
        for raw in batch.column(at).cast(pa.binary()).to_pylist():
            words = raw.split() if raw else []
            got = word_runs(words, least)
            runs += got
            offsets.append(len(runs))
            texts.append(b" ".join(_kept(words, got)))
        flat = np.array(runs, np.int64).reshape(-1, 3)
        names = [f.name for f in RUNS.elementType]
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=[pa.field(c, pa.int64(), False) for c in names])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=pa.list_(pa.field("element", structs.type, False)))
        return [*batch.columns, listed, pa.array(texts, pa.binary()).view(pa.string())]

    return map_rows(docs, make, [*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])


def longest_run(runs: Column) -> Column:
    """The run of greatest length (of those the first, then of the smallest period); null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def collapse_runs(docs: DataFrame, *, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with each text that holds a run cut to the first period of its runs; other texts, null ones too, stay as they are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(text)}"
    done = find_runs(plain, text=at, least=least)
    cut = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(quoted(at)))
    return done.withColumn(at, cut).drop("runs", "collapsed").toDF(*docs.columns)
