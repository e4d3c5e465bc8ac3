"""What each filter of a chain removes, in every order of the chain, without running any order.

Documents are counted once, by part and by which filters they fail: a cell for each set of filters failed. All orders are then visited by
adjacent transpositions (plain changes): each differs from the one before by one swap of neighbours, so of its steps only the two
swapped ones are counted anew, from the cells; the others stand. A filter's Shapley sum is gathered along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import BROADCAST_ROWS, stash

#: Filters at most: all orders of more would be too many rows to look at.
MOST_FILTERS = 8

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_changes(n: int) -> Iterator[int]:
    """The place of the left neighbour in each swap of the walk through all orders of ``n`` things."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    for _ in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(inner, None)
        if swap is not None:
            # The last thing now stands at one end, and does not take part in the inner swap.
            yield swap + 1 if down else swap
        down = not down


class Walk:
    """All orders over ``cells``, an array (parts, sets of filters failed, 3) of counts: documents, good ones, toxic ones."""

    def __init__(self, cells: np.ndarray, filters: int) -> None:
        self.cells, self.filters = cells, filters
        self.masks = np.arange(1 << filters)
        self.order = list(range(filters))
        #: Of each step: documents, good and toxic ones that it removes.
        self.lost = np.zeros((len(cells), filters, 3), np.int64)
        self.failing = np.stack([cells[:, self.masks >> f & 1 == 1, 0].sum(1) for f in range(filters)], 1)
        self.unique = cells[:, [1 << f for f in range(filters)], 0]
        self.shapley = np.zeros((len(cells), filters), np.int64)

    def count(self, step: int) -> None:
        """Count a step anew: the cells that its filter fails and no earlier one does."""
        earlier = sum(1 << f for f in self.order[:step])
        self.lost[:, step] = self.cells[:, (self.masks >> self.order[step] & 1 == 1) & (self.masks & earlier == 0)].sum(1)

    def visit(self) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """Each order, and for its steps (part, step, count) the first six of ``COUNTS``."""
        for step in range(self.filters):
            self.count(step)
        yield self.seen()
        for at in plain_changes(self.filters):
            self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
            self.count(at)
            self.count(at + 1)
            yield self.seen()

    def seen(self) -> tuple[tuple[int, ...], np.ndarray]:
        removed = self.lost[:, :, 0]
        self.shapley[:, self.order] += removed
        kept = self.cells[:, :, 0].sum(1)[:, None] - removed.cumsum(1)
        steps = [kept, removed, self.failing[:, self.order] - removed, self.unique[:, self.order], self.lost[:, :, 1], self.lost[:, :, 2]]
        return tuple(self.order), np.stack(steps, 2)


def filter_cells(flags: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(part, mask, n, good, toxic): documents of ``flags(part, good, toxic, one boolean column for each filter)`` by the set of filters
    failed, bit i for the i-th filter; a null flag is no failure."""
    mask = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    return flags.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def audit_orders(cells: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """For each part, order of ``filters`` and step, from :func:`filter_cells`: part, filter_order, step and ``COUNTS``.

    A part is one row of at most two to the power of the filters cells, so parts are audited where they lie.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} filters")
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    together = max(1, (1 << 20) // (factorial(n) * n * len(COUNTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), together):
                parts = batch.column(0).slice(lo, together)
                grid = np.zeros((len(parts), 1 << n, 3), np.int64)
                for i, found in enumerate(batch.column(1).slice(lo, together).to_pylist()):
                    for c in found:
                        grid[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                walk = Walk(grid, n)
                orders, steps = zip(*[(np.array(order), steps) for order, steps in walk.visit()], strict=True)
                # Rows by part, then order, then step.
                shapley = np.stack([walk.shapley[:, order] for order in orders], 1)
                counts = np.concatenate([np.stack(steps, 1), shapley[..., None]], 3).reshape(-1, len(COUNTS))
                names = np.repeat(["".join(filters[f] for f in order) for order in orders], n)
                part = parts.take(pa.array(np.repeat(np.arange(len(parts)), len(names))))
                step = np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts) * len(orders))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(names, len(parts)).tolist(), pa.string()), pa.array(step), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], ["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with ``copied``: whether a smaller doc_id has the same digest. Ids that are null are neither.

    Smallest ids are found by a minimum that combines before the shuffle, and only those of digests with several ids go on; they are
    broadcast while few, and else joined so that Spark can split a hot digest.
    """
    spread = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("digest").alias("d"), "first")
    spread = stash(spread)
    if spread.count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    return rows.join(spread, F.col("digest") == F.col("d"), "left").withColumn("copied", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("d", "first")


def audit_filters(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], *, copies: str | None = None, part: str = "lang") -> DataFrame:
    """The audit of ``docs(doc_id, text, part, ...)`` for filters named by ``failures``, each with the condition under which a row fails
    it, and by ``copies``, a last filter that a row fails if a smaller doc_id has the same text. See :func:`audit_orders`.

    ``labels(doc_id, quality, toxic)`` say what is good (quality 1) and what is toxic (toxic 1): of an id with several labels, if any
    says so; an id without a label is neither. A part that is null counts as the empty text, a null text as the empty text, a condition
    that is null as passed. Each row counts, repeated ones too; rows of one doc_id are not copies of each other. Of each text only flags
    and a 16-byte digest are kept. An empty table gives no rows.
    """
    flags = [c.alias(f"f{i}") for i, c in enumerate(failures.values())]
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16).alias("digest")
    rows = stash(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags, digest))
    names = [f"f{i}" for i in range(len(flags))]
    if copies is not None:
        rows = later_copies(rows)
        names.append("copied")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    marked = rows.select("doc_id", "part", *names).join(stash(marks), F.col("doc_id") == F.col("labelled"), "left")
    said = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    letters = (*failures, *([copies] if copies is not None else []))
    cells = filter_cells(marked.select("part", *names, *said), tuple(names))
    return audit_orders(cells, letters)


def words_of(text: Column) -> Column:
    """The maximal runs of other than ASCII white space in ``text``, in order; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
