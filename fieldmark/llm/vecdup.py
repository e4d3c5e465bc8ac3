"""Near-duplicate embeddings by product quantisation.

Vectors are dealt to coarse inverted lists, and the residual of each is coded by one byte for each subspace. A query probes the
lists that could hold a partner by a bound on distances to centroids, scores their members by table look-ups (asymmetric distances), and ranks the promising ones by the exact
cosine of the full vectors in double precision.

Copies come in large groups, in which all are linked with all. Vectors within half of the link angle of a leader are therefore
gathered in a ball first: any two of them are linked, by the triangle inequality, without being compared. Only leaders are searched
for, at an angle widened by both radii; two balls are then linked in full, or not at all, or compared vector by vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, cos

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, quoted, settled, small, stash

#: Vectors that one task holds of one list or ball.
BLOCK = 2048
SLACK = 1e-7  # radians by which bounds are narrowed, for rounding


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from distinct rows; an empty cluster keeps its place."""
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, at)
        n = np.bincount(near, minlength=len(at))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(at)) for j in range(x.shape[1])], 1)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ at.T * -2 + (at * at).sum(1)).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids, and for each subspace the code words of residuals. ``error``: what table look-ups miss of a cosine."""

    coarse: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]
    error: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 5) -> Quantiser:
        coarse = kmeans(x, lists, 8, seed)
        rest = x - coarse[nearest(x, coarse)]
        cuts = np.linspace(0, x.shape[1], min(8, x.shape[1]) + 1).astype(int)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        books = [kmeans(rest[:, a:b], 256, 6, seed + 1 + i) for i, (a, b) in enumerate(spans)]
        made = cls(coarse, books, spans, 0.0)
        near = nearest(x, coarse)
        again = coarse[near] + made.decode(made.encode(x, near))
        # Queries near a vector meet its error along themselves: the worst of the sample, and half as much again.
        return cls(coarse, books, spans, 1.5 * float(np.abs(1 - (x * again).sum(1)).max(initial=0.0)) + 0.02)

    def encode(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[near]
        return np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(self.spans, self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.books)], 1)

    def reachable(self, queries: np.ndarray, near: np.ndarray, angles: np.ndarray, width: float) -> np.ndarray:
        """Whether a vector within its angle of each query (rows; ``near``: its own list) could be nearer to each centroid (columns)
        than to the own one.

        A partner at angle t is cos(t) of the query and sin(t) of a direction across. How far that direction leads from one centroid
        to the other is bounded by ``width`` standard deviations of random directions. From a width of sqrt(dimensions - 1) on this is the
        exact bound of the bisecting plane.
        """
        n2, own = (self.coarse * self.coarse).sum(1), self.coarse[near]
        along = queries @ self.coarse.T - (queries * own).sum(1)[:, None]
        apart = n2 + n2[near][:, None] - 2 * own @ self.coarse.T
        share = min(1.0, width / max(1, queries.shape[1] - 1) ** 0.5)
        across = 2 * share * np.sqrt(np.maximum(apart - along * along, 0))
        # The angle, up to the given one, that leads nearest to the other centroid.
        t = np.minimum(angles[:, None], np.arctan2(across, 2 * along))
        out = n2 - n2[near][:, None] - 2 * along * np.cos(t) - across * np.sin(t) <= SLACK
        out[np.arange(len(queries)), near] = True
        return out

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries (rows) and coded vectors of one list (columns)."""
        out = np.repeat((queries @ self.coarse[cell])[:, None], len(codes), 1)
        for i, ((a, b), c) in enumerate(zip(self.spans, self.books, strict=True)):
            out += (queries[:, a:b] @ c.T)[:, codes[:, i]]
        return out


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def gather_balls(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row its leader's row and the angle to it: rows in turn lead, and take all that no one leads within ``radius``."""
    lead, angle = np.full(len(x), -1), np.zeros(len(x))
    for i in range(len(x)):
        if lead[i] < 0:
            free = np.flatnonzero(lead[i:] < 0) + i
            a = _angles(x[free] @ x[i])
            a[0] = 0.0
            won = a <= radius
            lead[free[won]], angle[free[won]] = i, a[won]
    return lead, angle


def _beside(df: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """``df`` with the row of ``counts`` of its ``keys``; counts are written first, and broadcast if they are few."""
    counts = stash(counts)
    return df.join(small(counts, counts.count()), keys)


def _blocked(df: DataFrame, keys: list[str], name: str, spread: Column) -> DataFrame:
    """``df`` with ``name``: a block number in each group of ``keys``, of about ``BLOCK`` rows each."""
    n = df.groupBy(*keys).agg((F.ceil(F.count("*") / BLOCK)).cast("int").alias("__n"))
    return _beside(df, keys, n).withColumn(name, F.pmod(spread, F.col("__n")).cast("int")).drop("__n")


def group_of(vector: str, label: str) -> Column:
    """What two vectors must have in common to be compared."""
    return F.concat_ws(":", F.col(label).cast("string"), F.size(vector).cast("string"))


def hash_of(vector: str) -> Column:
    return F.xxhash64(F.col(vector).cast("array<double>"))


class VectorLinks:
    """Links of vectors with equal labels whose cosine is at least ``least``.

    ``vectors(id, vector, label)``; vectors that are null, zero, or hold a null or a number that is not finite, and those
    without a label or id, are linked with nothing, and lengths must agree. Rows alike in all three are one vector; of one id with
    several vectors or labels each is a vector of its own, under a ``key`` of its own.

    There are about ``rows_a_list`` vectors in a list, or in large tables as many as keep lists and their members in step:
    the number of lists grows with the square root of the table, and with it the sample that places lists and code words,
    ``fit_rows`` vectors of each length or four for each list, up to ``most_fit_rows``; all vectors are indexed. A query probes every list that
    :meth:`Quantiser.reachable` cannot exclude at ``width``, so in a large group of near copies all lists of the group; and its nearest
    ``probes`` lists, four times as many if it leads a ball, in any case. A pair is found if either probes the other's list.
    Vectors of floats travel as floats; cosines are always computed in double precision.
    """

    def __init__(self, vectors: DataFrame, *, least: float = 0.93, fit_rows: int = 20_000, most_fit_rows: int = 262_144, rows_a_list: int = 512, probes: int = 6, width: float = 2.5) -> None:
        self.angle = acos(least)
        self.least = least
        finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        nonzero = F.exists("vector", lambda v: v != 0)
        self.kind = "array<float>" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
        rows = vectors.select("id", F.col("vector").cast(self.kind).alias("vector"), group_of("vector", "label").alias("group"), hash_of("vector").alias("hash"), "label")
        rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & nonzero).drop("label")
        self.rows = stash(rows.withColumn("key", F.col("id")))
        # Only where ids repeat, which is counted without the vectors, is the table dealt anew and keyed by number.
        if self.rows.groupBy("id").count().where("count > 1").limit(1).count():
            self.rows = settled(lambda rows=self.rows: rows.dropDuplicates(["id", "group", "hash"]).withColumn("key", F.monotonically_increasing_id()), self.rows)
        self.quantisers = {}
        for d, total in self.rows.groupBy(F.size("vector")).count().collect():
            lists = int(max(1, min(total // rows_a_list, 4096 + 2 * total**0.5)))
            wanted = max(fit_rows, min(most_fit_rows, 4 * lists))
            sample = self.rows.where(F.size("vector") == d).where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / total)))
            x = sample.select("id", "hash", "vector").limit(2 * wanted).toPandas().sort_values(["id", "hash"])["vector"]
            x = _unit(x) if len(x) else np.eye(1, d)
            self.quantisers[d] = Quantiser.fit(x, min(lists, len(x)))
        self.probes, self.width = probes, width
        self.shared = vectors.sparkSession.sparkContext.broadcast(self.quantisers)

    def placed(self) -> DataFrame:
        """(key, id, vector, group, cell): every vector in its list."""
        shared = self.shared

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cell = np.zeros(len(b), np.int64)
                sizes = b["vector"].map(len).to_numpy()
                for d in set(sizes.tolist()):
                    at = np.flatnonzero(sizes == d)
                    cell[at] = nearest(_unit(b["vector"].iloc[at]), shared.value[d].coarse)
                yield b[["key", "id", "vector", "group"]].assign(cell=cell)

        return self.rows.select("key", "id", "vector", "group").mapInPandas(place, f"key long, id long, vector {self.kind}, group string, cell long")

    def balls(self) -> DataFrame:
        """(key, id, vector, group, leader, radius): each vector with its leader's key and the angle to it."""
        half = self.angle / 2 - SLACK

        def gather(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["id", "key"], kind="stable")
            lead, angle = gather_balls(_unit(b["vector"]), half)
            return b[["key", "id", "vector", "group"]].assign(leader=b["key"].to_numpy()[lead], radius=angle)

        placed = _blocked(stash(self.placed()), ["group", "cell"], "block", F.xxhash64("key"))
        # Dealt by block: what is dealt by list would keep all blocks of a large list in one task.
        return placed.repartition("group", "cell", "block").groupBy("group", "cell", "block").applyInPandas(gather, f"key long, id long, vector {self.kind}, group string, leader long, radius double")

    def leader_pairs(self, leaders: DataFrame) -> DataFrame:
        """(a, b, angle) of leaders whose balls could hold linked vectors; each pair once, a < b. By probes, look-ups and rerank."""
        shared, probes, width, link = self.shared, self.probes, self.width, self.angle

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b["vector"]
                sizes = x.map(len).to_numpy()
                cells: list = [None] * len(b)
                code: list = [None] * len(b)
                for d in set(sizes.tolist()):
                    at = np.flatnonzero(sizes == d)
                    pq, radius = shared.value[d], b["radius"].to_numpy()[at]
                    u = _unit(x.iloc[at])
                    for lo in range(0, len(at), 256):
                        part, r = u[lo : lo + 256], radius[lo : lo + 256]
                        order = np.argsort((pq.coarse * pq.coarse).sum(1) - 2 * part @ pq.coarse.T, axis=1, kind="stable")
                        # Of two balls the one of the larger radius reaches the other's leader.
                        reach = pq.reachable(part, order[:, 0], np.minimum(link + 2 * r + SLACK, np.pi), width)
                        for i, o, n, ok, c in zip(at[lo : lo + 256], order, np.where(r == 0, probes, 4 * probes), reach, pq.encode(part, order[:, 0]), strict=True):
                            ok[o[:n]] = True
                            cells[i], code[i] = o[ok[o]].astype(np.int64), c.tobytes()
                yield b[["key", "vector", "group", "radius"]].assign(cells=cells, code=code)

        probed = stash(leaders.select("key", "vector", "group", "radius").mapInPandas(probe, f"key long, vector {self.kind}, group string, radius double, cells array<bigint>, code binary"))
        stored = _blocked(probed.select("key", "vector", "group", "radius", "code", F.element_at("cells", 1).alias("cell")), ["group", "cell"], "block", F.xxhash64("key"))
        asked = _blocked(probed.select("key", "vector", "group", "radius", F.explode("cells").alias("cell")), ["group", "cell"], "turn", F.xxhash64("key"))
        blocks = stored.groupBy("group", "cell").agg(F.max("block").alias("__b"))
        turns = asked.groupBy("group", "cell").agg(F.max("turn").alias("__t"))
        # Every block of a list meets every block of its queries, in a task of its own.
        asked = _beside(asked, ["group", "cell"], blocks).withColumn("block", F.explode(F.sequence(F.lit(0), "__b"))).drop("__b")
        stored = _beside(stored, ["group", "cell"], turns).withColumn("turn", F.explode(F.sequence(F.lit(0), "__t"))).drop("__t")
        stored = stored.select(*[F.col(c).alias(c) for c in stored.columns])  # names of its own, beside those of ``asked``

        def match(key: tuple, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "angle": np.zeros(0)})
            if not len(queries) or not len(members):
                return none
            q, m = _unit(queries["vector"]), _unit(members["vector"])
            pq, cell = shared.value[q.shape[1]], int(key[1])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in members["code"]])
            out = [none]
            qr, mr = queries["radius"].to_numpy(), members["radius"].to_numpy()
            qi, mi = queries["key"].to_numpy(), members["key"].to_numpy()
            for lo in range(0, len(q), 256):
                hi = min(len(q), lo + 256)
                reach = np.minimum(link + qr[lo:hi, None] + mr[None, :] + SLACK, np.pi)
                i, j = np.nonzero(pq.scores(q[lo:hi], cell, codes) >= np.cos(reach) - pq.error)
                angle = _angles((q[lo:hi][i] * m[j]).sum(1))
                good = (angle <= reach[i, j]) & (qi[lo:hi][i] != mi[j])
                a, b = qi[lo:hi][i[good]], mi[j[good]]
                out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "angle": angle[good]}))
            return pd.concat(out)

        keys = ["group", "cell", "turn", "block"]
        found = asked.repartition(*keys).groupBy(*keys).cogroup(stored.repartition(*keys).groupBy(*keys)).applyInPandas(match, "a long, b long, angle double")
        return found.groupBy("a", "b").agg(F.min("angle").alias("angle"))

    def mixed_links(self, mixed: DataFrame, balls: DataFrame) -> DataFrame:
        """(key, other, n): for pairs of balls that neither link nor miss each other in full, how many of the other ball each vector
        is linked with (if any); compared block by block."""
        least = self.least

        def pack(b: pd.DataFrame) -> pd.DataFrame:
            x = _unit(b["vector"])
            return pd.DataFrame({"leader": [b["leader"].iloc[0]], "ids": [b["key"].to_numpy()], "dims": [x.shape[1]], "flat": [x.ravel()]})

        need = mixed.select(F.col("a").alias("leader")).union(mixed.select("b")).distinct()
        own = _blocked(balls.join(need, "leader", "left_semi"), ["leader"], "block", F.xxhash64("key"))
        packed = stash(own.repartition("leader", "block").groupBy("leader", "block").applyInPandas(pack, "leader long, ids array<bigint>, dims int, flat array<double>"))
        pairs = mixed.join(packed.select(F.col("leader").alias("a"), F.col("ids").alias("x"), F.col("flat").alias("xv"), "dims"), "a").join(packed.select(F.col("leader").alias("b"), F.col("ids").alias("y"), F.col("flat").alias("yv")), "b")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    x, y = np.asarray(r.xv).reshape(-1, r.dims), np.asarray(r.yv).reshape(-1, r.dims)
                    near = x @ y.T >= least
                    for ids, n, other in ((r.x, near.sum(1), r.b), (r.y, near.sum(0), r.a)):
                        yield pd.DataFrame({"key": np.asarray(ids)[n > 0], "other": other, "n": n[n > 0]})

        return pairs.select("a", "b", "x", "y", "xv", "yv", "dims").mapInPandas(compare, "key long, other long, n long")

    def result(self) -> DataFrame:
        """(id, group, hash, n_links, component) of each vector that can be linked."""
        balls = settled(self.balls)
        sizes = balls.groupBy("leader").agg(F.count("*").alias("size"), F.max("radius").alias("radius"), F.min("id").alias("first"))
        leaders = stash(balls.where("key = leader").drop("radius", "leader", "id").join(sizes.withColumnRenamed("leader", "key"), "key"))
        r = leaders.select("key", "radius", "size")
        pairs = settled(lambda: self.leader_pairs(leaders).join(r.select(F.col("key").alias("a"), F.col("radius").alias("ra"), F.col("size").alias("sa")), "a").join(r.select(F.col("key").alias("b"), F.col("radius").alias("rb"), F.col("size").alias("sb")), "b"))
        alone = (F.col("sa") == 1) & (F.col("sb") == 1)
        full = F.when(alone, F.col("angle") <= self.angle).otherwise(F.col("angle") + F.col("ra") + F.col("rb") <= self.angle - SLACK)
        whole = pairs.where(full)
        mixed = settled(lambda: self.mixed_links(stash(pairs.where(~full & ~alone).select("a", "b")), balls))
        other = whole.select(F.col("a").alias("leader"), F.col("sb").alias("n")).union(whole.select("b", "sa")).groupBy("leader").agg(F.sum("n").alias("others"))
        some = mixed.groupBy("key").agg(F.sum("n").alias("some"))
        edges = whole.select("a", "b").union(mixed.join(balls.select("key", "leader"), "key").select(F.col("leader").alias("a"), F.col("other").alias("b")).distinct())
        labels = components(edges).withColumnRenamed("id", "leader")
        # Components are named by leaders so far, not by their smallest member.
        named = leaders.select(F.col("key").alias("leader"), "size", "first").join(labels, "leader", "left").withColumn("comp", F.coalesce("comp", "leader"))
        named = stash(named.join(named.groupBy("comp").agg(F.min("first").alias("component")), "comp").join(other, "leader", "left").select("leader", "component", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n")))
        counted = balls.select("key", "leader").join(named, "leader").join(some, "key", "left").select("key", (F.col("n") + F.coalesce("some", F.lit(0))).alias("n_links"), "component")
        return self.rows.select("key", "id", "group", "hash").join(counted, "key").drop("key")


def near_duplicate_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable,
    itself included), kept (whether that is its own). See :class:`VectorLinks`. Rows without an id are kept and linked with nothing;
    repeated rows are one vector, which each of them returns; rows of one id with several vectors each return those of their own."""
    rows = vectors.select(F.col(quoted(id)).cast("long").alias("id"), F.col(quoted(vector)).alias("vector"), F.col(quoted(label)).alias("label"))
    found = VectorLinks(rows, **options)
    links = found.result().alias("f")
    every = rows.select("id", group_of("vector", "label").alias("group"), hash_of("vector").alias("hash"), F.col("label").isNotNull().alias("labelled")).alias("r")
    same = (F.col("r.id") == F.col("f.id")) & (F.col("r.group") == F.col("f.group")) & (F.col("r.hash") == F.col("f.hash")) & F.col("r.labelled")
    component = F.coalesce("f.component", "r.id")
    return every.join(links, same, "left").select(F.col("r.id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("r.id") == component, F.lit(True)).alias("kept"))
