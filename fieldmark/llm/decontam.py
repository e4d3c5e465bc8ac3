"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words that looks at seven of them and ignores the rest. Test items and training texts
are hashed under every mask at every word; equal hashes put an item and a text on a common diagonal, on which words are then
compared one by one. With these four masks every run of 16 words with at most three substitutions, and every run of 13 with at most
two, has a hit wherever they are (tests/llm checks all cases), where plain 8-word runs would miss most of them. An item too short
for the masks is its own seed: a hash of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, fields_with, map_rows, quoted, stash, text_batches, unused, without
from .textkit import loose, mix64, span_hashes, text_blocks, word_spans

MASKS = ("1110010111", "11110111", "111000100111", "110100101101")
#: Words of the shortest mask: shorter items are looked for as a whole.
SHORTEST = min(map(len, MASKS))
#: Runs that count as a leak: so many words, of which so many may be replaced.
RUNS = ((13, 2), (16, 3))
#: Words of test items that are held in memory at once; larger benchmarks take several passes over the texts.
WORDS_A_PASS = 2_000_000
FILTER_BITS = 22
#: Word comparisons made at once.
CELLS = 1 << 22


def runs_of(words: int) -> tuple[tuple[int, int], ...]:
    """The runs that an item of so many words is searched for: those that fit, or else all its words, of which one may be replaced if
    there are eleven or more."""
    fit = tuple((n, k) for n, k in RUNS if n <= words)
    return fit or ((words, int(words >= 11)),)


def masks_of(words: int) -> tuple[str, ...]:
    return MASKS if words >= SHORTEST else ("1" * words,)


def loose_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (letters and digits, case and punctuation ignored), and each text's first word."""
    plain = loose(raw)
    starts, ends, first = word_spans(plain, offsets)
    return span_hashes(plain, starts, ends, fold=False), first


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each word from which it fits."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, x in enumerate(mask):
        if x == "1":
            out = (out ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix64(out)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Items:
    """Test items by word, with their seeds in order: of each key and item one entry, which covers ``count`` places from ``start`` on."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    masks: tuple[str, ...]
    keys: np.ndarray
    item: np.ndarray
    start: np.ndarray
    count: np.ndarray
    at: np.ndarray
    filter: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], min_words: int = 1) -> Items:
        words, first, masks = [], [0], set()
        keys, item, at = [], [], []
        for i, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w, _ = loose_words(raw, np.array([0, len(raw)]))
            words.append(w)
            first.append(first[-1] + len(w))
            if len(w) < max(1, min_words):
                continue
            for mask in masks_of(len(w)):
                masks.add(mask)
                k = seeds(w, mask)
                keys.append(k)
                item.append(np.full(len(k), i))
                at.append(np.arange(len(k)))
        none = [np.zeros(0, np.int64)]
        k, it, p = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(item or none), np.concatenate(at or none)
        order = np.lexsort((p, it, k))
        k, it, p = k[order], it[order], p[order]
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (it[1:] != it[:-1])])[: len(k)])
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[_slots(k)] = True
        return cls(np.array(ids, np.int64), np.concatenate(words or [np.zeros(0, np.uint64)]), np.array(first), tuple(sorted(masks)), k[start], it[start], start, np.diff(np.append(start, len(k))), p, seen)

    def candidates(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Of each item with a hit, the diagonals to verify: places in the text that its first word would stand on."""
        hits = []
        for mask in self.masks:
            h = seeds(words, mask)
            at = np.flatnonzero(self.filter[_slots(h)])
            lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
            n = hi - lo
            entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.any() else np.zeros(0, np.int64)
            hits.append(np.stack([entry, np.repeat(at, n)]))
        entry, at = np.concatenate(hits, 1) if hits else np.zeros((2, 0), np.int64)
        out = {}
        for i, rows in _groups(self.item[entry]):
            length, n = int(self.first[i + 1] - self.first[i]), self.count[entry[rows]]
            if n.sum() > len(words) + length:  # words that repeat: all diagonals are fewer than the hits
                out[i] = np.arange(1 - length, len(words))
            else:
                place = np.repeat(self.start[entry[rows]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                out[i] = np.unique(np.repeat(at[rows], n) - self.at[place])
        return out

    def found(self, words: np.ndarray) -> dict[int, int]:
        """Items of which ``words`` holds a run, and how many words agree on the best run's diagonal."""
        best: dict[int, int] = {}
        for i, shifts in self.candidates(words).items():
            test = self.words[self.first[i] : self.first[i + 1]]
            runs = runs_of(len(test))
            # Places beyond the text agree with nothing.
            for lo in range(0, len(shifts), max(1, CELLS // len(test))):
                place = shifts[lo : lo + max(1, CELLS // len(test)), None] + np.arange(len(test))
                inside = (place >= 0) & (place < len(words))
                same = (words[np.clip(place, 0, max(0, len(words) - 1))] == test) & inside
                run = np.concatenate([np.zeros((len(same), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
                good = np.zeros(len(same), bool)
                for n, k in runs:
                    good |= (run[:, n:] - run[:, :-n]).max(1) >= n - k
                if good.any():
                    best[i] = max(best.get(i, 0), int(run[good, -1].max()))
        return best


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value with the rows that hold it."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order])) + 1
    for rows in np.split(order, ends) if len(values) else []:
        yield int(values[rows[0]]), rows


def _search(column: pa.Array, items: Items) -> Iterator[tuple[int, list[int], int]]:
    """(row, ascending item ids, words that agree) of each text that holds an item."""
    for lo, hi, raw, offsets in text_blocks(column):
        words, first = loose_words(raw, offsets)
        for i in range(hi - lo):
            if best := items.found(words[first[i] : first[i + 1]]):
                yield lo + i, sorted(set(items.ids[list(best)].tolist())), max(best.values())


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", min_words: int = 1, names: tuple[str, str] = ("leaked_items", "leaked_words")) -> DataFrame:
    """``docs`` with ``leaked_items`` (ascending item_ids of ``benchmark(item_id, text)`` found in the text) and
    ``leaked_words`` (words that agree, of the item most of which is found; 0 if none is).

    An item is found if one of ``RUNS`` of its words, or all of them if it has fewer (:func:`runs_of`), stands in the text with at
    most so many of them replaced. Words are compared without case and punctuation. Short items, which prose may hold by chance, are found
    like others; only if ``min_words`` is given are those of fewer words left out. Null texts, and items without a word or an id,
    hold and match nothing; rows of one item_id are each searched for, and the id is listed once. Input columns of the added names are
    replaced; ``names`` are others for them.

    Items are broadcast, so texts are not shuffled. Of a benchmark of more than ``WORDS_A_PASS`` words no task holds more than that:
    each part is searched for in a pass of its own, which writes what it found by the number of the row.
    """
    docs = without(docs, *names)
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # Words as Items has them: runs of ASCII letters and digits, and of all that is not ASCII.
    total = benchmark.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    passes = max(1, -(-total // WORDS_A_PASS))
    context = docs.sparkSession.sparkContext

    def part(k: int):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        return context.broadcast(Items.of([r.item_id for r in rows], [r.text for r in rows], min_words))

    if passes == 1:
        at, shared = docs.columns.index(text), part(0)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            found, most = [[]] * len(batch), [0] * len(batch)
            for i, ids, n in _search(batch.column(at), shared.value):
                found[i], most[i] = ids, n
            return [*batch.columns, pa.array(found, pa.list_(pa.int64())), pa.array(most, pa.int64())]

        return map_rows(docs, make, fields_with(docs, **{names[0]: "longs", names[1]: "long"}))

    (row,) = unused(docs, "row")
    docs = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = None
    for k in range(passes):
        shared = part(k)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = list(_search(batch.column(1), shared.value))
                rows = batch.column(0).take(pa.array([i for i, _, _ in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([x for _, x, _ in got], pa.list_(pa.int64())), pa.array([n for *_, n in got], pa.int64())], ["row", "ids", "n"])

        got = stash(text_batches(docs.select(F.col(quoted(row)).alias("row"), F.col(quoted(text)).alias("text"))).mapInArrow(search, "row long, ids array<bigint>, n long"))
        shared.unpersist()
        hits = got if hits is None else hits.union(got)
    hits = stash(hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.max("n").alias("n")))
    # Rows and ids count: a text may hold very many items.
    rows, ids = hits.agg(F.count("*"), F.sum(F.size("ids"))).first()
    side = F.broadcast(hits) if rows + (ids or 0) <= 10 * BROADCAST_ROWS else hits
    joined = docs.alias("d").join(side.alias("h"), F.col(f"d.{quoted(row)}") == F.col("h.row"), "left")
    added = [F.coalesce("h.ids", F.array().cast("array<bigint>")).alias(names[0]), F.coalesce("h.n", F.lit(0)).alias(names[1])]
    return joined.select(*[F.col(f"d.{quoted(c)}") for c in docs.columns if c != row], *added)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a test item. Columns stay as they are, whatever their names."""
    names = tuple(unused(docs, "leaked_items", "leaked_words"))
    return find_leaks(docs, benchmark, names=names, **options).where(F.size(names[0]) == 0).select(*[F.col(quoted(c)) for c in docs.columns])
