"""The nearest rows to many candidates by matrix products: exactly what :func:`fieldmark.operators.nearest.closest` gives, at a small part of its time.

Rows and candidates are dealt into groups, by a key if there is one, of bounded numbers of either. A group is one matrix product in a task, and only each
candidate's nearest leave it, so pairs are never rows of a plan. Where vectors have no structure the work is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .nearest import closest, first_copies

#: Candidates from which on Python is worth its start.
PRODUCTS = 256
#: Rows of a group at most, and bytes of them as doubles; candidates of a group at least (if there are as many) and at most.
ROWS, BYTES, FEWEST, MOST = 65_536, 32 << 20, 4096, 16_384
#: Keys that are counted one by one: with more, each has few rows.
KEYS = 10_000
#: Cosines that a task holds at a time; by how much sums in order may differ where they are rounded to nine places.
CELLS, MARGIN = 1 << 22, 2e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(v: Column) -> Column:
    """Whether a vector has a cosine."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def narrow(df: DataFrame, v: str) -> Column:
    return F.col(v) if df.schema[v].dataType.simpleString() == "array<float>" else F.col(v).cast("array<double>")


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def kth(near: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best of each row, of at least as many."""
    return np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]


def _best_of(at: np.ndarray, s: np.ndarray, k: int, margin: float) -> np.ndarray:
    """In order of candidate and then of similarity, which are not below the ``k``-th best of their candidate."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff([*starts, len(at)])
    least = np.where(sizes >= k, s[np.minimum(starts + k, starts + sizes) - 1], -np.inf)
    return s >= np.repeat(least, sizes) - margin


def nearest_of(asked: pa.Table, rows: pa.Table, id: str, k: int) -> pa.Table:
    """(candidate_id, id, similarity) of a group: each candidate's ``k`` nearest rows, and what is as near to nine places. Candidates for these are found by products of
    single precision, whose error is bounded; their cosines are sums in order of the numbers, as those of :func:`fieldmark.functions.vector.cosine`."""
    found = [pa.table({"candidate_id": asked["candidate_id"][:0], id: rows[id][:0], "similarity": np.zeros(0)})]
    if len(asked) and len(rows):
        rows = rows.sort_by(id)
        q, e = numbers(asked["__v"]), numbers(rows["__e"])
        uq, ue = unit(q).astype(np.float32), unit(e).astype(np.float32).T.copy()
        q, e = q.T.copy(), e.T.copy()
        qn, en = (np.sqrt(sum((x * x for x in v), np.zeros(v.shape[1]))) for v in (q, e))
        # Sums of d products of single precision, twice: of what is compared, and of what it is compared with.
        error = 2 * (len(q) + 4) * 2.0**-23
        every = max(1, min(16, len(rows) // (4 * k)))
        for i in range(0, len(uq), step := max(1, CELLS // len(rows))):
            near = uq[i : i + step] @ ue
            # The k-th best of some rows is no better than that of all.
            least = kth(near[:, ::every], k)[:, None] - error if len(rows) >= 4 * k else -2.0
            at, of = np.nonzero(near >= least)
            s = near[at, of]
            order = np.lexsort((-s, at))
            at, of, s = at[order], of[order], s[order]
            chosen = _best_of(at, s, k, error)
            at, of = at[chosen] + i, of[chosen]
            with np.errstate(all="ignore"):
                s = sum((x[at] * y[of] for x, y in zip(q, e, strict=True)), np.zeros(len(at))) / (en[of] * qn[at])
            at, of, s = (x[np.isfinite(s)] for x in (at, of, s))
            order = np.lexsort((of, -s, at))
            at, of, s = at[order], of[order], s[order]
            if len(at):
                # Of rows with one cosine those of smallest id stay.
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1])])
                first = (np.arange(len(at)) - np.repeat(new, np.diff([*new, len(at)])) < k) & _best_of(at, s, k, MARGIN)
                found.append(pa.table({"candidate_id": asked["candidate_id"].take(pa.array(at[first])), id: rows[id].take(pa.array(of[first])), "similarity": s[first]}))
    return pa.concat_tables(found)


def by_products(candidates: DataFrame, rows: DataFrame, *, id: str, k: int, key: tuple[str, str] | None = None) -> DataFrame:
    """:func:`fieldmark.operators.nearest.closest` of many ``candidates(candidate_id, __v, ...)``, whose ids are their own, among ``rows(id, __e, ...)``. Vectors that hold a
    number that is not finite are left out too."""
    spark, other = candidates.sparkSession, rows.schema[id]
    own = lambda v, c: F.struct(F.size(v).alias("d"), *([F.col(c).alias("key")] if c else [])).alias("__key")
    c = candidates.where(usable(F.col("__v"))).select("candidate_id", narrow(candidates, "__v").alias("__v"), own("__v", key and key[0]))
    r = rows.where(usable(F.col("__e"))).select(id, narrow(rows, "__e").alias("__e"), own("__e", key and key[1]))
    if key:
        c, r = c.where("__key.key is not null"), r.where("__key.key is not null")
    counted = c.groupBy("__key").agg(F.count("*").alias("asked")).join(r.groupBy("__key").agg(F.count("*").alias("held")), "__key")
    counts = counted.limit(KEYS + 1).collect()
    if len(counts) > KEYS:
        return closest(candidates, rows, id=id, k=k, key=key)
    asked, held = sum(x.asked for x in counts), sum(x.held for x in counts)
    longest = max((x["__key"]["d"] for x in counts), default=1)
    most_rows = max(1, min(ROWS, BYTES // (8 * longest), max(FEWEST, held // 8)))
    most_asked = max(1, min(MOST, BYTES // (8 * longest), max(FEWEST, asked // 64)))
    plan, first = [], 0
    for x in counts:
        parts = -(-x.held // most_rows)
        plan.append((x["__key"], first, parts, -(-x.asked // most_asked)))
        first += parts
    groups = F.broadcast(spark.createDataFrame(plan, StructType([counted.schema["__key"], *spark.createDataFrame([], "first int, rows int, parts int").schema])))
    r = first_copies(r, by=["__key", "__e"], id=id, k=k)
    if not key:
        # Rows of one vector are compared as one. The first of its ids stands for them.
        copies = r.groupBy("__key", "__e").agg(F.array_sort(F.collect_list(id)).alias("__ids")).select(F.col("__ids")[0].alias(id), "__key", "__e", "__ids")
        r = copies.drop("__ids")
    dealt = lambda df: df.repartition(tasks, "__group", "__part").groupBy("__group", "__part")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1000, sum(x[2] * x[3] for x in plan)))
    part = lambda name, n: F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit("group")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = c.join(groups, "__key").select("candidate_id", "__v", part("candidate_id", "parts").alias("__part"), "first", each("rows").alias("__n")).select("candidate_id", "__v", "__part", (F.col("first") + F.col("__n")).alias("__group"))
    r = r.join(groups, "__key").select(id, "__e", (F.col("first") + part(id, "rows")).alias("__group"), each("parts").alias("__part"))
    met = dealt(c).cogroup(dealt(r)).applyInArrow(lambda a, b: nearest_of(a, b, id, k), StructType([candidates.schema["candidate_id"], other, StructField("similarity", DoubleType())]))
    near = met.withColumn("similarity", F.round("similarity", 9))
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("similarity"), id))
    best = near.withColumn("position", place).where(F.col("position") <= k)
    if key:
        return best
    each_copy = best.join(copies.select(id, "__ids"), id).select("candidate_id", F.explode("__ids").alias(id), "similarity")
    return each_copy.withColumn("position", place).where(F.col("position") <= k)
