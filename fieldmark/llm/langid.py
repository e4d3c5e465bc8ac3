"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams (2 to 4 bytes, the blended spectrum) present in both, over the root of the
product of how many each has. Nyström landmarks give every text a short feature vector, on which one ridge regression is fitted
for each language against the rest. As a score is linear in the kernels with the landmarks, and these in the n-grams present, the
landmarks and the regression fold into one weight for each n-gram and language: a batch of texts is scored by one matrix product
of its presence matrix with those weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fields_with, map_rows, quoted, text_batches, unused, without
from .sampling import fold, smallest_hashes
from .textkit import loose, text_blocks

GRAMS = (2, 3, 4)
SPACE_BITS = 16
UNIVERSE = 1 << SPACE_BITS
ROWS = 32  # texts scored by one product


def letters_only(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with everything but letters as single spaces, and a space before each; bytes and offsets."""
    c = loose(raw)
    c[(c >= 48) & (c <= 57)] = 32
    c = np.insert(c, offsets[:-1], 32)
    offsets = offsets + np.arange(len(offsets))
    c = np.append(c, np.uint8(32))
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[offsets]


def presence(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Presence matrices of the hashed n-grams, for ``ROWS`` texts at a time: (first text, rows x UNIVERSE of 0 and 1)."""
    c, off = letters_only(raw, offsets)
    ids = []
    for n in GRAMS:
        m = max(0, len(c) - n + 1)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ids.append((h & np.uint32(UNIVERSE - 1)).astype(np.int32))
    texts = len(off) - 1
    for lo in range(0, texts, ROWS):
        hi = min(texts, lo + ROWS)
        p = np.zeros((hi - lo, UNIVERSE), np.float32)
        for i in range(lo, hi):
            for n, h in zip(GRAMS, ids, strict=True):
                p[i - lo, h[off[i] : max(off[i], off[i + 1] - n + 1)]] = 1
        yield lo, p


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # UNIVERSE x (languages + 1); the last column counts n-grams

    def scores(self, p: np.ndarray) -> np.ndarray:
        s = p @ self.weights
        return s[:, :-1] / np.sqrt(np.maximum(s[:, -1:], 1))


def fit(bits: np.ndarray, labels: list[str], *, landmarks: int, ridge: float) -> LanguageModel:
    """Fit on packed presence rows. Landmarks are taken from the languages in turn."""
    languages = tuple(sorted(set(labels)))
    number = {x: i for i, x in enumerate(languages)}
    ys = np.array([number[x] for x in labels])
    order, place = np.argsort(ys, kind="stable"), np.zeros(len(ys), np.int64)
    place[order] = np.arange(len(ys)) - np.searchsorted(ys[order], ys[order])
    turn = np.lexsort((ys, place))[:landmarks]

    def rows(ix: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits[ix], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = rows(turn)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    to_features = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([rows(np.arange(i, min(i + 64, len(ys)))) @ marks.T for i in range(0, len(ys), 64)])
    phi = kernel @ to_features
    y = np.where(ys[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(ys) / len(languages) * np.eye(phi.shape[1]), phi.T @ y)
    grams = marks.T @ (to_features @ w).astype(np.float32)
    return LanguageModel(languages, np.concatenate([grams, np.ones((UNIVERSE, 1), np.float32)], 1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in text_blocks(batch.column(1)):
            packed = [np.packbits(p.astype(np.uint8), axis=1) for _, p in presence(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for block in packed for x in block], pa.binary())], ["lang", "bits"])


def fit_languages(docs: DataFrame, *, fit_rows: int = 1200, landmarks: int = 128, ridge: float = 1e-3) -> LanguageModel | None:
    """A model of all languages of ``docs(doc_id, text, lang)``, any number of them; None if no row has a label and a letter.

    It is fitted on a bounded sample: about ``fit_rows`` rows in all, shared equally by the languages, and six of each, or all that hold a
    letter if there are fewer; and with ``landmarks`` landmarks, or one for each language if that is more. The model takes a quarter of a
    megabyte a language.
    """
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # Labels are counted without the texts, so only the sample's own pass reads them.
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(6, fit_rows // len(counts))
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))

    def drawn(of: dict) -> list[tuple[str, bytes]]:
        sample = smallest_hashes(lettered, "doc_id", "lang", of, each)
        return [(r.lang, bytes(r.bits)) for r in text_batches(sample.select("lang", "text")).mapInArrow(_pack, "lang string, bits binary").collect()]

    got = drawn(counts)
    # Where few of many rows hold a letter the share drawn may miss them: such languages are looked for in all rows.
    found = Counter(x for x, _ in got)
    missed = [x for x, n in counts.items() if found[x] < each and n > 4 * each + 64]
    if missed:
        # Counted as none, a language's share is all of its rows; the others are not asked for.
        again = drawn(dict.fromkeys(missed, 0))
        got = [g for g in got if g[0] not in set(missed)] + again
    got.sort()
    if not got:
        return None
    return fit(np.stack([np.frombuffer(b, np.uint8) for _, b in got]), [x for x, _ in got], landmarks=max(landmarks, len(counts)), ridge=ridge)


def predict_languages(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "margin")) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``margin`` (by how much the best language's regression leads the next
    one's; infinite if there is no other). Null texts, and texts without a letter, are ``und`` with score and margin 0.

    Input columns of the added names are replaced; ``names`` are others for them.
    """
    docs = without(docs, *names)
    if model is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0), names[2]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, last = docs.columns.index(text), len(docs.columns)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m, has = shared.value, batch.column(last).to_numpy(zero_copy_only=False)
        best, score, margin = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
        for lo, hi, raw, offsets in text_blocks(batch.column(at)):
            for first, p in presence(raw, offsets):
                s = m.scores(p).astype(np.float64)
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                rows = slice(lo + first, lo + first + len(p))
                best[rows], score[rows] = s.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
                two = np.sort(s, 1)[:, -2:]
                margin[rows] = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.inf
        pred = np.where(has, np.array(m.languages, object)[best], "und")
        return [*batch.columns[:last], pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, margin, 0.0))]

    has_letter = F.coalesce(F.col(quoted(text)).rlike(r"\p{L}"), F.lit(False))
    return map_rows(docs.withColumn(unused(docs, "has_letter")[0], has_letter), make, fields_with(docs, **{names[0]: "string", names[1]: "double", names[2]: "double"}))


def identify_languages(docs: DataFrame, *, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, margin; rows held out are not learned from."""
    out = F.col("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out")
    model = fit_languages(docs.where(fold(F.col("doc_id"), folds) != held), **options)
    return predict_languages(docs.select(*out, "text"), model).drop("text")


def keep_identified(docs: DataFrame, *, languages: tuple[str, ...] | None = None, min_margin: float = 0.0, **options) -> DataFrame:
    """``docs`` whose language is told (those that are null or hold no letter go), and is one of ``languages`` if these are given. A
    ``min_margin`` over the next language, which means the same for any number of them, leaves out texts that mix languages too.
    Columns stay as they are, whatever their names."""
    pred, score, margin = unused(docs, "lang_pred", "score", "margin")
    judged = predict_languages(docs, fit_languages(docs.where(fold(F.col("doc_id"), 4) != 2), **options), names=(pred, score, margin))
    good = (F.col(pred) != "und") & (F.col(margin) >= min_margin)
    if languages:
        good &= F.col(pred).isin(*languages)
    return judged.where(good).select(*[F.col(quoted(c)) for c in docs.columns])
