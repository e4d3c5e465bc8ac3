"""Toxicity by a factorization machine over hashed terms (Rendle, 2010).

Terms are words and word beginnings, hashed. A linear model can only add up weights; the machine also gives every term a short
vector, and the products of the vectors of terms that stand together raise or lower the score, so that a mild insult beside the
mention of a group weighs more than the sum of the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fields_with, map_rows, text_batches, without
from .sampling import fold, one_row, stratified
from .textkit import loose, span_hashes, text_blocks, word_spans

SPACE = 1 << 18
STEMS = (4, 5, 6)  # word beginnings, in bytes


def terms(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, the distinct hashed terms of its words; a term that stands there twice or more is also a second term."""
    plain = loose(raw)
    starts, ends, first = word_spans(plain, offsets)
    kinds = [span_hashes(plain, starts, ends, fold=False)]
    kinds += [span_hashes(plain, starts, np.minimum(ends, starts + n), fold=False) + np.uint64(n) for n in STEMS]
    ids = np.stack([(k >> np.uint64(20)) & np.uint64(SPACE - 1) for k in kinds], 1).astype(np.int64)
    for j, n in enumerate(STEMS):
        ids[ends - starts <= n, j + 1] = -1  # a short word is its own beginning
    for a, b in zip(first[:-1], first[1:], strict=True):
        once, n = np.unique(ids[a:b], return_counts=True)
        once, n = once[once >= 0], n[once >= 0]
        yield np.concatenate([once, (once[n > 1] * 0x9E3779B1 + 1) % SPACE])


@dataclass(frozen=True)
class Machine:
    """slot: for each hashed term its place among those learned, or -1."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw_score(self, ids: np.ndarray) -> float:
        at = self.slot[ids]
        at = np.unique(at[at >= 0])
        v = self.factors[at]
        total = v.sum(0)
        return self.bias + float(self.linear[at].sum()) + 0.5 * float((total * total - (v * v).sum(0)).sum())


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_machine(rows: list[np.ndarray], y: np.ndarray, *, rank: int = 6, most_terms: int = 2048, steps: int = 800, rate: float = 0.3, decay: float = 1e-5) -> Machine:
    """Fit by AdaGrad on the logistic loss over all rows. Terms are presences; those learned are the ``most_terms`` that tell
    the labels apart most surely (beyond what the largest of so many chance
    deviations would reach), so that the length of a text adds nothing."""
    count = np.zeros((2, SPACE))
    for r, label in zip(rows, y, strict=True):
        count[int(label), np.unique(r)] += 1
    n = np.array([np.sum(y == 0), np.sum(y == 1)], float)[:, None]
    rate_all = count.sum(0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.stack([count * np.log(count / (n * rate_all)), (n - count) * np.log((n - count) / (n * (1 - rate_all)))])
    # Root of the likelihood ratio: also sound for terms that one label never has.
    z = np.sqrt(np.maximum(2 * np.nan_to_num(parts).sum((0, 1)), 0))
    top = np.argsort(-z, kind="stable")[:most_terms]
    top = top[z[top] >= 0.9 * np.sqrt(2 * np.log(max(2, (count.sum(0) > 1).sum())))]
    slot = np.full(SPACE, -1, np.int32)
    slot[top] = np.arange(len(top))
    x = np.zeros((len(rows), len(top)), np.float32)
    for i, r in enumerate(rows):
        at = slot[r]
        x[i, at[at >= 0]] = 1
    rng = np.random.default_rng(11)
    # Both labels weigh the same, however rare one is.
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    bias, w, v = 0.0, np.zeros(len(top), np.float32), rng.normal(0, 0.02, (len(top), rank)).astype(np.float32)
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    for _ in range(steps):
        xv = x @ v
        s = bias + x @ w + 0.5 * (xv * xv - x @ (v * v)).sum(1)
        e = ((_sigmoid(s) - y) * weight).astype(np.float32)
        xe = x.T @ e
        dw = xe + decay * w
        dv = x.T @ (e[:, None] * xv) - v * xe[:, None] + decay * v
        db = float(e.sum())
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        v -= 0.1 * rate * dv / np.sqrt(gv)
        bias -= rate * db / np.sqrt(gb)
    return Machine(slot, float(bias), w, v)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in text_blocks(batch.column(1)):
            rows = [t.astype(np.int32).tobytes() for t in terms(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["toxic", "ids"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 6000, **options) -> Machine | None:
    """A machine for ``docs(doc_id, text)`` by ``labels(doc_id, toxic)``; None without rows of both labels.

    It is fitted on a bounded sample of about ``fit_rows`` labelled rows, up to half of them of each label. The ids sampled are
    few enough to broadcast, so texts are not shuffled.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    sample = stratified(known, "doc_id", "toxic", counts, {0: fit_rows / 2, 1: fit_rows / 2})
    # One row of each id, always the same one, so that an id with very many rows does not swell the sample.
    rows = one_row(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", "text").select("toxic", "text")
    got = sorted((r.toxic, bytes(r.ids)) for r in text_batches(rows).mapInArrow(_ids, "toxic int, ids binary").collect())
    y = np.array([t for t, _ in got])
    if len(set(y.tolist())) < 2:
        return None
    return fit_machine([np.frombuffer(b, np.int32) for _, b in got], y, **options)


def score_toxicity(docs: DataFrame, machine: Machine | None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; null and empty texts get that of a text without any learned term) and ``predicted``.

    Without a machine all scores are 0. Input columns of the added names are replaced.
    """
    docs = without(docs, "score", "predicted")
    if machine is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m, s = shared.value, np.zeros(len(batch))
        for lo, _, raw, offsets in text_blocks(batch.column(at)):
            for i, ids in enumerate(terms(raw, offsets)):
                s[lo + i] = m.raw_score(ids)
        score = _sigmoid(s)
        return [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return map_rows(docs, make, fields_with(docs, score="double", predicted="int"))


def rate_documents(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted; labels of held-out documents are not learned from."""
    machine = fit_toxicity(docs, labels.where(fold(F.col("doc_id"), folds) != held), **options)
    return score_toxicity(docs.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "text"), machine).drop("text")
