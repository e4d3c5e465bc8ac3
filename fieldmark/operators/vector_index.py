"""A persistent inverted-list index of vectors, for the nearest rows by cosine without comparing with every row.

Rows lie in lists by the nearest of some centroids, in files sorted by list, so a search reads the lists that it probes and no others; filters
are applied inside the lists. How many lists are probed is measured when the index is built: as many as it takes to find a share
``recall`` of the true neighbours of some sampled rows among the sample. An exact search then goes on to every list that the
triangle inequality cannot exclude, given the k-th best row so far; how many that are is a matter of the data.

Many queries meet rows in groups: neighbouring lists together, a large list in parts. A group's rows and the queries that look into it are
compared by one matrix product, and only what may be among the nearest leaves it. Groups are bounded, so are tasks, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.scratch import exists
from .nearest import FEW, Size, closest, first_copies
from .products import KEYS, PRODUCTS, by_products, kth, narrow, numbers, unit, usable
from .retrieval import vector_topk

#: Bytes of centroids at most: they are broadcast, and kept by the driver.
LISTS_BYTES = 32 << 20
#: Rows, and bytes of them, on which centroids are fitted at most.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Rows of a group, and queries that meet them at once, at most, and bytes of either; a table makes so many groups before they are filled.
GROUP_ROWS, GROUP_BYTES, GROUPS = 16_384, 8 << 20, 32
#: Cosines that a task holds at a time, and by how much those of a matrix product may miss what is rounded to nine places.
PRODUCT, MARGIN = 1 << 21, 2e-9


def _fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length 1 of unit vectors, by alternating assignment and mean; one that loses all rows starts anew at another row."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        lost = np.bincount(at, minlength=k) == 0
        sums[lost] = x[rng.choice(len(x), int(lost.sum()), replace=False)]
        c = unit(sums)
    return c


def _probes(x: np.ndarray, c: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """How many of a row's nearest lists hold a share ``recall`` of its ``k`` nearest rows, over sampled rows. Rows of the whole table are
    nearer than those of a sample, and so lie in no later lists."""
    q = x[:: max(1, len(x) // asked)][:asked]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // asked))[: len(q)]] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    lists = (x @ c.T).argmax(1)
    places = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    at = np.sort(np.take_along_axis(places, lists[best], 1).ravel())
    return int(at[min(len(at) - 1, ceil(recall * len(at)) - 1)]) + 1


@dataclass(frozen=True)
class Lists:
    """What is known of an index's lists: unit centroids, the widest angle of a row in each, how many rows each holds, how many
    are probed at first, and the length of their vectors."""

    centroids: np.ndarray
    widest: np.ndarray
    rows: np.ndarray
    probes: int

    def order(self, vectors: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with centroids, and the ``probes`` nearest lists, of unit vectors."""
        near = vectors @ self.centroids.T
        return near, np.argsort(-near, axis=1, kind="stable")[:, :probes]

    def open(self, near: np.ndarray, probed: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which lists not yet probed could hold a row of cosine ``least``: a row is no nearer than the centroid's angle less the list's."""
        bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - self.widest - 1e-7))
        could = (bound >= least[:, None] - 1e-8) & (self.rows > 0)
        np.put_along_axis(could, probed, False, 1)
        return could


@dataclass(frozen=True)
class Groups:
    """Rows that are compared at once: those of neighbouring lists, a cell, whose large ones are cut into parts. ``order`` has the lists cell by cell,
    ``starts`` where each cell begins, ``parts`` in how many groups it lies; groups are numbered cell by cell. ``others``: the groups of
    lists of another length."""

    order: np.ndarray
    starts: np.ndarray
    parts: np.ndarray
    others: dict[int, list[int]]

    @classmethod
    def of(cls, lists: Lists, others: dict[int, int], rows: int) -> Groups:
        """Groups of up to ``rows`` rows: lists are halved across the direction in which they differ most, until they are few enough or one."""
        cells, left = [], [np.arange(len(lists.rows))] if len(lists.rows) else []
        while left:
            own = left.pop()
            if len(own) == 1 or lists.rows[own].sum() <= rows:
                cells.append(own)
                continue
            x = lists.centroids[own] - lists.centroids[own].mean(0)
            own = own[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
            held = lists.rows[own].cumsum()
            at = int(np.clip(np.searchsorted(held, held[-1] / 2), 1, len(own) - 1))
            left += [own[at:], own[:at]]
        parts = np.array([max(1, -(-int(lists.rows[own].sum()) // rows)) for own in cells], int)
        ends, beyond = int(parts.sum()), {}
        for i, n in sorted(others.items()):
            beyond[i] = list(range(ends, ends + -(-n // rows)))
            ends += len(beyond[i])
        return cls(np.concatenate(cells) if cells else np.zeros(0, int), np.cumsum([0, *[len(own) for own in cells]])[:-1], parts, beyond)

    def __len__(self) -> int:
        return int(self.parts.sum()) + sum(map(len, self.others.values()))

    def by_list(self) -> list[tuple[int, int, int]]:
        """(list, its first group, in how many groups it lies)."""
        sizes = np.diff([*self.starts, len(self.order)])
        own = zip(self.order, np.repeat(np.cumsum(self.parts) - self.parts, sizes), np.repeat(self.parts, sizes), strict=True)
        return [(int(i), int(a), int(n)) for i, a, n in own] + [(i, g[0], len(g)) for i, g in self.others.items()]

    def holding(self, lists: np.ndarray) -> np.ndarray:
        """For each row of ``lists``, which lists are wanted: which groups hold them, of those not in ``others``."""
        return np.repeat(np.logical_or.reduceat(lists[:, self.order], self.starts, axis=1), self.parts, axis=1)


def _products(asked: pa.Table, rows: pa.Table):
    """From which query on, and the cosines of some queries with all rows, of a group."""
    q, e = unit(numbers(asked["__v"])), unit(numbers(rows["__e"])).T
    for i in range(0, len(q), step := max(1, PRODUCT // len(rows))):
        yield i, q[i : i + step] @ e


def _bounds(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The queries of a group, each with its ``k``-th best cosine there, or -2."""
    enough = len(asked) and len(rows) >= k
    least = np.concatenate([kth(near, k) for _, near in _products(asked, rows)]) if enough else np.full(len(asked), -2.0)
    return asked.select(["candidate_id", "__v", "__part"]).append_column("__least", pa.array(least))


def _nearest(asked: pa.Table, rows: pa.Table, id: str, k: int) -> pa.Table:
    """What of a group may be among the ``k`` nearest of each query: rows not below its bound, nor below its ``k``-th best here. Cosines are sums in
    order of the numbers, as those of :func:`fieldmark.functions.vector.cosine`; of rows with one cosine those of smallest id stay."""
    found = [pa.table({"candidate_id": asked["candidate_id"][:0], id: rows[id][:0], "similarity": np.zeros(0)})]
    if len(asked) and len(rows):
        rows = rows.sort_by(id)
        q, e, bound = numbers(asked["__v"]).T.copy(), numbers(rows["__e"]).T.copy(), asked["__least"].to_numpy() - MARGIN
        qn, en = (np.sqrt(sum((x * x for x in v), np.zeros(v.shape[1]))) for v in (q, e))
        for i, near in _products(asked, rows):
            wanted = near >= bound[i : i + len(near), None]
            if len(rows) > k and len(many := np.flatnonzero(wanted.sum(1) > 4 * k)):
                wanted[many] &= near[many] >= kth(near[many], k)[:, None] - MARGIN
            at, of = np.nonzero(wanted)
            at += i
            with np.errstate(all="ignore"):
                s = sum((x[at] * y[of] for x, y in zip(q, e, strict=True)), np.zeros(len(at))) / (en[of] * qn[at])
            at, of, s = (x[np.isfinite(s)] for x in (at, of, s))
            order = np.lexsort((of, -s, at))
            at, of, s = at[order], of[order], s[order]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1])][: len(at)])
            first = np.arange(len(at)) - np.repeat(new, np.diff([*new, len(at)])) < k
            found.append(pa.table({"candidate_id": asked["candidate_id"].take(pa.array(at[first])), id: rows[id].take(pa.array(of[first])), "similarity": s[first]}))
    return pa.concat_tables(found)


def _matrix(vectors: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of ``length`` among ``vectors``, and at which places they are."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == length]
    x = np.array([np.asarray(vectors.iloc[i], dtype=float) for i in good]).reshape(len(good), length)
    fine = np.isfinite(x).all(1) & (np.abs(x) > 0).any(1)
    return unit(x[fine]), np.array(good, int)[fine]


class VectorIndex:
    """An index under ``path``, built by :meth:`build`.

    Vectors of the length that most rows have are in lists 0 and up; those of another length n lie together in list -n, which queries of
    that length probe. Vectors that are null or zero, or hold a null or a number that is not finite, have no cosine and are left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        held = sorted(spark.read.parquet(f"{self.path}/lists").collect(), key=lambda r: r["list"])
        own = [r for r in held if r["list"] >= 0]
        self.length = len(own[0]["centroid"]) if own else 0
        self.id = self.rows().columns[2]
        self.others = {r["list"]: r["n"] for r in held if r["list"] < 0}
        self.lists = Lists(np.array([r["centroid"] for r in own]).reshape(len(own), self.length), np.array([r["widest"] for r in own]), np.array([r["n"] for r in own], int), own[0]["probes"] if own else 0)

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id: str = "id", vector: str = "embedding", recall: float = 0.98, lists: int | None = None) -> VectorIndex:
        """Index ``rows(id, vector, ...)``, whose other columns are kept for filters and results. About the root of their number of
        lists; centroids are fitted on at most ``SAMPLE_ROWS`` sampled rows."""
        spark, v = rows.sparkSession, F.col(vector)
        sizes = {r["d"]: r["n"] for r in rows.where(usable(v)).groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).collect()}
        length = max(sizes, key=lambda d: (sizes[d], d), default=1)
        n = sizes.get(length, 0)
        fit = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * length))
        drawn = rows.where(usable(v) & (F.size(v) == length) & (F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit("sample")), F.lit(1 << 20)) <= (1 << 20) * min(1.0, fit / max(1, n))))
        x = unit(np.array([list(r[0]) for r in drawn.select(v.cast("array<double>")).limit(2 * fit).collect()], float).reshape(-1, length))
        k = min(lists or isqrt(n) + 1, LISTS_BYTES // (8 * length), len(x))
        centroids = _fit(x, k) if k else np.zeros((0, length))
        probes = min(k, _probes(x, centroids, recall)) if k else 0
        shared = spark.sparkContext.broadcast(centroids)

        @F.pandas_udf("list int, angle double")
        def place(vectors: pd.Series) -> pd.DataFrame:
            c = shared.value
            out = pd.DataFrame({"list": [-len(x) for x in vectors], "angle": 0.0})
            unit, at = _matrix(vectors, c.shape[1])
            near = unit @ c.T
            out.loc[at, "list"], out.loc[at, "angle"] = near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1))
            return out

        placed = rows.where(usable(v)).withColumn("__p", place(v.cast("array<double>"))).select(F.col("__p.list").alias("list"), F.col("__p.angle").alias("angle"), id, *[F.col(c) for c in rows.columns if c != id])
        # By ranges of list and id, so that a large list is several files.
        dealt = placed.repartitionByRange(F.col("list"), F.col(id)).sortWithinPartitions("list", id) if sizes else placed.coalesce(1)
        dealt.write.mode("overwrite").parquet(f"{path}/rows")
        counts = spark.read.parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        about = known.join(counts, "list", "full").select("list", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("widest", F.lit(0.0)).alias("widest"), F.lit(probes).alias("probes"))
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        return cls(spark, path)

    @classmethod
    def kept(cls, spark: SparkSession, path: str, make, **options) -> VectorIndex:
        """The index under ``path``, built from ``make()`` if it is not there yet. Its lists are written last."""
        return cls(spark, path) if exists(spark, f"{path}/lists/_SUCCESS") else cls.build(make(), path, **options)

    def rows(self) -> DataFrame:
        """All rows: ``list``, ``angle`` (to their list's centroid), id, and what else was indexed."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def __len__(self) -> int:
        return int(self.lists.rows.sum()) + sum(self.others.values())

    def share(self, lists: list[int]) -> float:
        """The share of all rows that some lists hold."""
        return sum(int(self.lists.rows[i]) if i >= 0 else self.others.get(i, 0) for i in lists) / max(1, len(self))

    def probed(self, vector: list[float], probes: int | None = None) -> list[int]:
        """The lists that one vector probes at first."""
        unit, at = _matrix(pd.Series([vector]), self.length)
        if not len(at):
            return [-len(vector)]
        return self.lists.order(unit, min(len(self.lists.rows), probes or self.lists.probes))[1][0].tolist()

    def beyond(self, vector: list[float], least: float, probes: int | None = None) -> list[int]:
        """The lists that could still hold a row of cosine ``least``."""
        unit, at = _matrix(pd.Series([vector]), self.length)
        if not len(at):
            return []
        near, probed = self.lists.order(unit, min(len(self.lists.rows), probes or self.lists.probes))
        return np.flatnonzero(self.lists.open(near, probed, np.array([least]))[0]).tolist()

    def top(self, vector: list[float], *, k: int, where: Column | None = None, exact: bool = True, probes: int | None = None) -> DataFrame:
        """The ``k`` rows most similar to one vector among those that pass ``where``, as :func:`fieldmark.operators.retrieval.vector_topk`
        gives them; without ``exact`` only from the lists probed at first, if these hold as many."""
        first = self.probed(vector, probes)
        found = vector_topk(self.rows().where(F.col("list").isin(first)), vector, k=k, where=where, id=self.id)
        scores = [r.score for r in found.select("score").collect()]
        if not exact and len(scores) == k:
            return found
        more = self.beyond(vector, min(scores) if len(scores) == k else -2.0, probes)
        return vector_topk(self.rows().where(F.col("list").isin(first + more)), vector, k=k, where=where, id=self.id) if more else found

    def _lists_of(self, exploded: DataFrame, least: str | None, probes: int | None) -> DataFrame:
        """``exploded(__v)`` with a row for each list to look into: those probed at first, or, given the column ``least``, those left open."""
        held = self.spark.sparkContext.broadcast((self.lists, self.length))
        p = min(len(self.lists.rows), probes or self.lists.probes)

        @F.pandas_udf("array<int>")
        def first(vectors: pd.Series) -> pd.Series:
            lists, length = held.value
            out = [[-len(v)] if v is not None else [] for v in vectors]
            unit, at = _matrix(vectors, length)
            for i, own in zip(at, lists.order(unit, p)[1], strict=True):
                out[i] = own.tolist()
            return pd.Series(out, dtype=object)

        @F.pandas_udf("array<int>")
        def rest(vectors: pd.Series, at_least: pd.Series) -> pd.Series:
            lists, length = held.value
            out: list = [[]] * len(vectors)
            unit, at = _matrix(vectors, length)
            near, probed = lists.order(unit, p)
            for i, own in zip(at, lists.open(near, probed, at_least.to_numpy(float)[at]), strict=True):
                out[i] = np.flatnonzero(own).tolist()
            return pd.Series(out, dtype=object)

        v = F.col("__v").cast("array<double>")
        return exploded.withColumn("list", F.explode(first(v) if least is None else rest(v, F.col(least))))

    def _into(self, queries: DataFrame, groups: Groups, k: int, which: str, probes: int | None = None) -> DataFrame:
        """``queries(__v, __least)`` with a row for each ``__group`` to look into: one that holds the ``nearest`` list, those with the lists ``probed`` at first
        (and more if these hold fewer than ``k`` rows), or those with a list that is left ``open`` by ``__least``."""
        held = self.spark.sparkContext.broadcast((self.lists, self.length, groups))
        p = min(len(self.lists.rows), probes or self.lists.probes)

        def wanted(lists: Lists, near: np.ndarray, least: np.ndarray) -> np.ndarray:
            if which == "open":
                return lists.open(near, np.zeros((len(near), 0), int), least)
            order = np.argsort(-np.where(lists.rows > 0, near, -2), axis=1, kind="stable")
            few = lists.rows[order].cumsum(1) < k
            among = np.arange(len(lists.rows)) < (1 if which == "nearest" else np.maximum(p, few.sum(1) + 1)[:, None])
            could = np.zeros(near.shape, bool)
            np.put_along_axis(could, order, np.broadcast_to(among, near.shape), 1)
            return could

        @F.pandas_udf("array<int>")
        def into(vectors: pd.Series, least: pd.Series) -> pd.Series:
            lists, length, groups = held.value
            out: list = [groups.others.get(-len(v), []) for v in vectors]
            unit, at = _matrix(vectors, length)
            for i in range(0, len(at), step := max(1, PRODUCT // max(1, len(lists.rows)))):
                near, own = unit[i : i + step] @ lists.centroids.T, at[i : i + step]
                for j, chosen in zip(own, groups.holding(wanted(lists, near, least.to_numpy(float)[own])), strict=True):
                    out[j] = np.flatnonzero(chosen).tolist()
            return pd.Series([x[:1] for x in out] if which == "nearest" else out, dtype=object)

        return queries.withColumn("__group", F.explode(into(F.col("__v").cast("array<double>"), "__least")))

    def _search_groups(self, queries: DataFrame, rows: DataFrame, *, k: int, exact: bool, probes: int | None) -> DataFrame:
        """:meth:`search` without a key. First each query's ``k``-th best in one group near it bounds what it looks for; then it meets every group that may
        hold better. Either side of a group is at most ``GROUP_ROWS`` vectors, so memory is bounded; where vectors have no structure no group is
        excluded, and the work is that of all pairs, by matrix products."""
        size = Size.of(queries, "__v")
        most = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, self.length, *[-i for i in self.others]))))
        groups = Groups.of(self.lists, self.others, max(1, min(most, max(1024, len(self) // GROUPS))))
        parts = max(1, -(-size.n // most))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(1000, len(groups) * parts))
        lists = self.spark.createDataFrame(groups.by_list(), "list int, first int, parts int")
        # Queries are dealt into parts, and rows go to each.
        asked = queries.where(usable(F.col("__v"))).select("candidate_id", narrow(queries, "__v").alias("__v"), F.pmod(F.xxhash64(F.col("candidate_id").cast("string")), F.lit(parts)).cast("int").alias("__part"), F.lit(-2.0).alias("__least"))
        placed = first_copies(rows, by=["__e"], id=self.id, k=k).join(F.broadcast(lists), "list")
        group = (F.col("first") + F.pmod(F.xxhash64(F.col(self.id).cast("string"), F.lit("group")), F.col("parts"))).cast("int").alias("__group")
        placed = placed.select(self.id, narrow(rows, "__e").alias("__e"), group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
        dealt = lambda df: df.repartition(tasks, "__group", "__part").groupBy("__group", "__part")
        id, own, other = self.id, queries.schema["candidate_id"], rows.schema[self.id]
        if exact and len(groups) > 1:
            near = dealt(self._into(asked, groups, k, "nearest")).cogroup(dealt(placed))
            asked = near.applyInArrow(lambda a, r: _bounds(a, r, k), asked.schema)
        met = dealt(self._into(asked, groups, k, "open" if exact else "probed", probes)).cogroup(dealt(placed))
        near = met.applyInArrow(lambda a, r: _nearest(a, r, id, k), StructType([own, other, StructField("similarity", DoubleType())]))
        place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("similarity"), id))
        return near.withColumn("similarity", F.round("similarity", 9)).withColumn("position", place).where(F.col("position") <= k)

    def _search_cells(self, queries: DataFrame, rows: DataFrame, *, k: int, key: tuple[str, str] | None, probes: int | None) -> DataFrame | None:
        """:meth:`search` of the lists that many queries probe at first, within a key or under a filter: neighbouring lists are a cell, so large that a key's rows of one are
        worth a matrix product, and a query is compared with its key's rows in the cells that its lists lie in. If these are fewer than ``k``, it looks into all cells.
        None if there is but one cell, or if there are too many keys to count their rows."""
        by = key[1] if key else None
        keys = rows.select(by).distinct().limit(KEYS + 1).count() if by else 1
        groups = Groups.of(self.lists, self.others, max(1, min(len(self), GROUP_ROWS * max(1, keys))))
        # Cells, not their parts: those are made of what each key has in them.
        cells = len(groups.starts) + len(groups.others)
        if cells < 2 or keys * cells > KEYS:
            return None
        cell_of = np.zeros(len(self.lists.rows), int)
        cell_of[groups.order] = np.repeat(np.arange(len(groups.starts)), np.diff([*groups.starts, len(groups.order)]))
        beyond = {i: len(groups.starts) + j for j, i in enumerate(groups.others)}
        lists = self.spark.createDataFrame([*((i, int(c)) for i, c in enumerate(cell_of)), *beyond.items()], "list int, __cell int")
        rows = rows.join(F.broadcast(lists), "list")
        counts = rows.groupBy(*([by] if by else []), "__cell").agg(F.count("*").alias("n")).collect()
        held: dict = {}
        for r in counts:
            held.setdefault(r[by] if by else None, np.zeros(cells, int))[r["__cell"]] = r["n"]
        shared = self.spark.sparkContext.broadcast((self.lists, self.length, cell_of, beyond, held))
        p = min(len(self.lists.rows), probes or self.lists.probes)

        @F.pandas_udf("array<int>")
        def into(vectors: pd.Series, own: pd.Series) -> pd.Series:
            lists, length, cell_of, beyond, held = shared.value
            out: list = [[beyond[-len(v)]] if v is not None and -len(v) in beyond else [] for v in vectors]
            x, at = _matrix(vectors, length)
            for i in range(0, len(at), step := max(1, PRODUCT // max(1, len(lists.rows)))):
                for j, probed in zip(at[i : i + step], lists.order(x[i : i + step], p)[1], strict=True):
                    n, chosen = held.get(own.iloc[j]), np.unique(cell_of[probed])
                    if n is not None:
                        out[j] = (chosen if n[chosen].sum() >= k else np.flatnonzero(n)).tolist()
            return pd.Series(out, dtype=object)

        one = F.lit(None).cast("string")
        asked = queries.withColumn("__cell", F.explode(into(F.col("__v").cast("array<double>"), F.col(key[0]) if key else one)))
        at = lambda df, own: df.withColumn("__at", F.struct(F.col("__cell").alias("cell"), *([F.col(own).alias("key")] if own else [])))
        asked, rows = at(asked, key and key[0]), at(rows, by)
        if key:
            asked, rows = (df.where(F.col(own).isNotNull()) for df, own in ((asked, key[0]), (rows, by)))
        return by_products(asked, rows, id=self.id, k=k, key=("__at", "__at"))

    def search(self, queries: DataFrame, *, k: int, key: tuple[str, str] | None = None, where: Column | None = None, unless: Column | None = None, exact: bool = True, probes: int | None = None) -> DataFrame:
        """(candidate_id, id, similarity, position) for ``queries(candidate_id, __v, ...)``, as :func:`fieldmark.operators.nearest.closest`
        gives them over all rows that pass ``where``; with ``key`` (queries' column, rows' column) only those with an equal one. Queries have ids of their own.

        Without a key, groups of rows are compared by matrix products; so are those of a key, or what a filter leaves, if queries are many. Few queries meet
        the rows of their lists by an equi-join on the list (and key), whose large lists Spark can split; they send ids to
        their lists, and their vectors are broadcast. Without
        ``exact`` only queries that find fewer than ``k`` rows in the lists probed at first look further.
        """
        rows = self.rows().where(where) if where is not None else self.rows()
        rows = rows.withColumnRenamed("embedding", "__e")
        if key is None and unless is None and (exact or where is None):
            return self._search_groups(queries, rows, k=k, exact=exact, probes=probes)
        size = Size.of(queries, "__v")
        if unless is None and size.n >= PRODUCTS:
            found = None if exact else self._search_cells(queries, rows, k=k, key=key, probes=probes)
            return found if found is not None else by_products(queries, rows, id=self.id, k=k, key=key)

        def at(df: DataFrame, own: str | None) -> DataFrame:
            return df.withColumn("__at", F.struct(F.col("list").alias("list"), *([F.col(own).alias("key")] if own else [])))

        rows = at(rows, key and key[1]).select("__at", self.id, "__e", *([key[1]] if key else []))
        p = min(len(self.lists.rows), probes or self.lists.probes)
        vectors = queries if size.n <= FEW and size.n * max(size.length, self.length) * 8 <= LISTS_BYTES else None

        def found(df: DataFrame, n: int, least: Column | None) -> DataFrame:
            return closest(at(df, key and key[0]).drop("list"), rows, id=self.id, k=k, key=("__at", "__at"), unless=unless, size=Size(n, size.length), least=least, vectors=vectors)

        first = found(self._lists_of(queries, None, probes), size.n * p, None)
        if p == len(self.lists.rows):
            return first
        least = first.groupBy("candidate_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("__most"))
        left = queries.join(least, "candidate_id", "left").withColumn("__most", F.coalesce("__most", F.lit(-2.0)))
        left = left if exact else left.where(F.col("__most") == -2.0)
        more = found(self._lists_of(left, "__most", probes), size.n * max(1, len(self.lists.rows) - p), F.col("__most"))
        place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("similarity"), self.id))
        return first.drop("position").unionByName(more.drop("position")).withColumn("position", place).where(F.col("position") <= k)
