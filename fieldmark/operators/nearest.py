"""The nearest rows of a table of vectors to each of a set of candidates, by cosine, exactly.

Candidates meet rows by an equal key (an asset, say), or, where there is none, in blocks that are broadcast: rows stream past each
block, and no product is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vector import dot, norm

#: Candidates up to which they are broadcast at once.
FEW = 10_000
#: Candidates from which on a first look at a few rows, and code for each number of a vector, are worth their while.
MANY = 64
#: Longest vectors whose product is written out: longer ones make methods that the JVM does not compile.
UNROLLED = 96


def beside(df: DataFrame, few: bool) -> DataFrame:
    """``df`` marked for broadcast if it is known to be small."""
    return F.broadcast(df) if few else df


def blocks(df: DataFrame, n: int, id: str) -> list[DataFrame]:
    """``df`` of ``n`` rows in parts of about ``FEW`` rows, for a join without a key."""
    parts = max(1, -(-n // FEW))
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(id, F.lit("block")), F.lit(parts)) == i) for i in range(parts)]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_copies(rows: DataFrame, *, by: list[str], id: str, k: int) -> DataFrame:
    """Of ``rows`` that are equal in the columns ``by``, a vector among them, the ``k`` of smallest ``id``. Rows of one vector are equally similar to any
    query and ties go by id, so no other can be among its ``k`` nearest. They are limited before the shuffle."""
    return rows.withColumn("__copy", F.row_number().over(W.partitionBy(*by).orderBy(id))).where(F.col("__copy") <= k).drop("__copy")


def asked_once(queries: DataFrame, *, id: str) -> tuple[DataFrame, DataFrame]:
    """``queries(id, ...)`` without those that ask just what one of a smaller id asks, and (id, asked as): as which of them each is asked."""
    what = F.struct(*[c for c in queries.columns if c != id])
    once = queries.groupBy(what.alias("__what")).agg(F.min(id).alias("__as"))
    # A struct is equal to another in its nulls too.
    members = queries.select(id, what.alias("__of")).join(once, F.col("__of") == F.col("__what")).select(id, "__as")
    return once.select(F.col("__as").alias(id), "__what.*"), members


@dataclass(frozen=True)
class Size:
    """How many candidates there are, and the length of their vectors, or 0 if it is not the same for all."""

    n: int
    length: int

    @classmethod
    def of(cls, candidates: DataFrame, vector: str) -> Size:
        r = candidates.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
        return cls(r.n, r.lo if r.lo is not None and r.lo == r.hi and r.lo > 0 else 0)


def closest(candidates: DataFrame, rows: DataFrame, *, id: str, k: int, key: tuple[str, str] | None = None, unless: Column | None = None, size: Size | None = None, least: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(candidate_id, id, similarity, position from 1): the ``k`` rows most similar to each of ``candidates(candidate_id, __v, ...)`` among
    ``rows(id, __e, ...)``; only those with an equal ``key`` (candidates' column, rows' column) if that is given, and without pairs for
    which ``unless`` holds. Ties go by id. Vectors that are null, zero, hold a null or differ in length have no similarity.

    ``least``: a similarity, of candidates' columns, below which no row is wanted. ``size`` says what is known of the candidates; else they are counted. Norms are computed once a row. Of many candidates, the k-th
    best of a few rows is no better than that of all, so pairs below it are dropped before they are rounded and ranked. If their vectors
    are of one length, up to ``UNROLLED``, they are compared number by number in generated code.
    """
    spark = candidates.sparkSession
    size = size or Size.of(candidates, "__v")
    d, few = size.length if size.n >= MANY and size.length <= UNROLLED else 0, size.n <= FEW

    def ready(df: DataFrame, v: str) -> DataFrame:
        x = F.col(v).cast("array<double>")
        df = df.withColumns({v: x, f"{v}n": F.coalesce(norm(x), F.lit(0.0))})
        if not d:
            return df
        # Columns that cannot be null; a vector that is null, holds a null or has another length has no cosine with any.
        df = df.where((F.size(v) == d) & ~F.exists(v, lambda y: y.isNull()) & (F.col(f"{v}n") != 0))
        return df.select("*", *[F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)).alias(f"{v}{i}") for i in range(d)]).drop(v)

    product = reduce(add, [F.col(f"__e{i}") * F.col(f"__v{i}") for i in range(d)], F.lit(0.0)) if d else F.when(F.size("__e") == F.size("__v"), dot(F.col("__e"), F.col("__v")))
    score = F.try_divide(product, F.col("__en") * F.col("__vn"))
    # By hash: a small file would be one task with all pairs. A join that shuffles by the key deals rows itself.
    rows = ready(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), id) if size.n >= MANY and (few or not key) else rows, "__e")
    shown = None if vectors is None else F.broadcast(ready(vectors.select(F.col("candidate_id").alias("__q"), "__v"), "__v"))
    candidates = ready(candidates, "__v") if shown is None else candidates.drop("__v")
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("similarity"), id))

    def ranked(c: DataFrame, r: DataFrame) -> DataFrame:
        if key:
            pairs = r.join(beside(c, few), r[key[1]] == c[key[0]])
            pairs = pairs if shown is None else pairs.join(shown, F.col("candidate_id").eqNullSafe(F.col("__q")))
        else:
            pairs = union([r.crossJoin(F.broadcast(part)) for part in blocks(c, size.n, "candidate_id")])
        pairs = pairs.where(score >= F.col("__least") - 1e-9)
        pairs = pairs.where(~unless) if unless is not None else pairs
        return pairs.select("candidate_id", id, F.round(score, 9).alias("similarity")).withColumn("position", place).where(F.col("position") <= k)

    if least is not None or size.n < MANY:
        return ranked(candidates.withColumn("__least", F.lit(-2.0) if least is None else least), rows)
    some = ranked(candidates.withColumn("__least", F.lit(-2.0)), rows.where(F.pmod(F.xxhash64(id), F.lit(64)) == 0))
    least = some.groupBy("candidate_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("__least"))
    return ranked(candidates.join(least, "candidate_id", "left").withColumn("__least", F.coalesce("__least", F.lit(-2.0))), rows)
