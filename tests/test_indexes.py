"""Indexes against the plain paths: the same rows, or a measured share of them, from fewer rows read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import gate, nearest, retrieval, vector_index
from fieldmark.operators.evaluate import fleet_neighbours, verdict_history
from fieldmark.operators.term_index import TermIndex
from fieldmark.operators.vector_index import VectorIndex
from fieldmark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# Vectors


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """6,000 vectors around 60 centres, a third of all around one of them; some that have no cosine, some of another length."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    which = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 60, 6000))
    v = (centres[which] + rng.normal(size=(6000, 24)) * 0.4).round(4).tolist()
    v[5], v[45], v[65], v[100], v[101] = None, [0.0] * 24, [None] * 24, [1.0, 2.0], [2.0, 1.0]
    rows = spark.createDataFrame([(f"m{i:05}", f"a{i % 3}", i, x) for i, x in enumerate(v)], "memory_id string, asset_id string, n int, embedding array<double>").repartition(4).persist()
    return rows, VectorIndex.build(rows, str(tmp_path_factory.mktemp("index")), id="memory_id")


def found(df):
    return {(r.candidate_id, r.position): (r.memory_id, r.similarity) for r in df.collect()}


def test_an_exact_search_of_lists_is_a_search_of_all(spark, fleet):
    rows, index = fleet
    asked = rows.where("n % 20 = 0")
    got = fleet_neighbours(asked, rows, index=index)
    assert found(got) == found(fleet_neighbours(asked, rows))
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)


def test_a_near_search_finds_nearly_all_from_few_lists(spark, fleet):
    rows, index = fleet
    asked = rows.where("n % 20 = 0")
    want = {(c, m) for (c, _), (m, _) in found(fleet_neighbours(asked, rows)).items()}
    got = {(c, m) for (c, _), (m, _) in found(fleet_neighbours(asked, rows, index=index, exact=False)).items()}
    shares = [index.share(index.probed(list(r.embedding))) for r in asked.where("n between 200 and 2000").collect()]
    assert len(want & got) >= 0.95 * len(want) and np.mean(shares) < 0.5


def test_one_vector_reads_its_lists(spark, fleet):
    """The rows read, by the scan's own count, are those of the lists probed."""
    rows, index = fleet
    vector = list(rows.where("n = 40").first().embedding)
    where = F.col("asset_id") == "a1"
    assert index.top(vector, k=9, where=where).collect() == retrieval.vector_topk(index.rows(), vector, k=9, where=where, id="memory_id").collect()
    near = index.top(vector, k=9, where=where, exact=False)
    near.collect()
    assert index.share(index.probed(vector)) < 0.6 and len(near.collect()) == 9


def test_searches_within_a_key(spark, fleet):
    rows, index = fleet
    asked = rows.where("n % 50 = 0").select(F.col("memory_id").alias("candidate_id"), F.col("embedding").alias("__v"), F.col("asset_id").alias("scope"))
    got = {(r.candidate_id, r.position): r.memory_id for r in index.search(asked, k=4, key=("scope", "asset_id")).collect()}
    for i in (0, 50, 100, 2000):
        one = rows.where(F.col("n") == i).first()
        want = retrieval.vector_topk(rows.where(F.col("asset_id") == one.asset_id), list(one.embedding), k=4, id="memory_id").collect()
        assert [got.get((one.memory_id, p)) for p in range(1, 5)] == [r.memory_id for r in want] + [None] * (4 - len(want))


def most_rows(df):
    """The most rows that a step of the plan made, by its own count, once ``df`` was collected."""
    def below(node):
        counted = node.metrics().get("numOutputRows")
        own = counted.get().value() if counted.isDefined() else 0
        kind = node.getClass().getSimpleName()
        more = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return max([own, *map(below, more)])

    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("exact", [True, False])
def test_pairs_are_not_rows(spark, fleet, exact):
    """300 queries among 6,000 vectors: pairs stay in matrix products, and only the best of a group leave it."""
    rows, index = fleet
    got = fleet_neighbours(rows.where("n % 20 = 0"), rows, index=index, exact=exact)
    assert len(got.collect()) > 1700 and most_rows(got) < 50_000


@pytest.mark.parametrize("group", [90, 700])
def test_groups_of_any_size_find_the_same(spark, fleet, tmp_path, monkeypatch, group):
    """Also of vectors with hundreds of copies, of multiples that tie but for their ids, of other lengths, and of none that can be compared."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 6)).round(3).tolist()
    v[100:400] = [v[100]] * 300
    v[400:700] = [[x * f for x in v[400]] for f in rng.uniform(0.5, 9, 300).tolist()]
    v[20:26], v[40], v[60], v[80] = [[1.0, 2.0]] * 6, [3.0], None, [0.0] * 6
    v[700:760] = [[1.0, float(i)] for i in range(60)]
    names = rng.permutation(1500)
    rows = spark.createDataFrame([(f"m{names[i]}", i, x) for i, x in enumerate(v)], "memory_id string, n int, embedding array<double>").repartition(3).persist()
    index = VectorIndex.build(rows, str(tmp_path), id="memory_id")
    monkeypatch.setattr(vector_index, "GROUP_ROWS", group)
    asked = rows.where("n % 20 = 0 or n between 100 and 130 or n between 400 and 430")
    got, want = found(fleet_neighbours(asked, rows, index=index)), found(fleet_neighbours(asked, rows))
    assert got == want and len(got) > 600
    near = found(fleet_neighbours(asked, rows, index=index, exact=False))
    assert len(near) == len(got) and len({(c, m) for (c, _), (m, _) in near.items()} & {(c, m) for (c, _), (m, _) in got.items()}) >= 0.9 * len(got)
    one = rows.where("n = 0").select(F.col("memory_id").alias("candidate_id"), F.array(F.lit(float("nan")), *[F.lit(1.0)] * 5).alias("__v"))
    assert index.search(one, k=3).count() == 0
    some = index.search(asked.select(F.col("memory_id").alias("candidate_id"), F.col("embedding").alias("__v")), k=3, where=F.col("n") % 7 == 0)
    plain = nearest.closest(asked.select(F.col("memory_id").alias("candidate_id"), F.col("embedding").alias("__v")), rows.where("n % 7 = 0").withColumnRenamed("embedding", "__e"), id="memory_id", k=3)
    assert found(some) == found(plain)


def test_groups_hold_each_row_once_and_are_bounded(fleet):
    _, index = fleet
    for most in (1, 100, 1024, 10_000):
        groups = vector_index.Groups.of(index.lists, index.others, most)
        by_list = groups.by_list()
        assert sorted(i for i, _, _ in by_list) == sorted([*range(len(index.lists.rows)), *index.others])
        held = {}
        for i, first, parts in by_list:
            held[first, parts] = held.get((first, parts), 0) + (int(index.lists.rows[i]) if i >= 0 else index.others[i])
        assert all(n <= most * parts for (_, parts), n in held.items()) and sum(held.values()) == len(index)
        assert sorted(g for first, parts in held for g in range(first, first + parts)) == list(range(len(groups)))


def test_an_index_of_nothing_and_of_one(spark, tmp_path):
    schema = "memory_id string, embedding array<double>"
    none = VectorIndex.build(spark.createDataFrame([], schema), str(tmp_path / "none"), id="memory_id")
    assert none.top([1.0, 0.0], k=3).count() == 0 and len(none) == 0
    one = spark.createDataFrame([("a", [3.0, 4.0])], schema)
    index = VectorIndex.build(one, str(tmp_path / "one"), id="memory_id")
    assert [tuple(r) for r in index.top([3.0, 4.0], k=3).select("memory_id", "score").collect()] == [("a", 1.0)]


def test_kept_indexes_are_found_again(spark):
    first = catalog.kept_index(spark, SF, "embeddings", "memory_id", "embeddings")
    assert catalog.kept_index(spark, SF, "embeddings", "memory_id", "embeddings").path == first.path


@pytest.mark.parametrize(("name", "plain", "key"), [("fleet_knn_indexed", "fleet_knn", "memory_id"), ("fleet_documents_indexed", "fleet_documents", "id"), ("hybrid_retrieval_indexed", "hybrid_retrieval", "id"), ("vector_topk_indexed", "vector_topk", None)])
def test_indexed_queries_find_what_the_plain_ones_do(spark, name, plain, key):
    """On vectors without any structure, where lists help least."""
    near, all_ = catalog.queries()[name](spark, SF), catalog.queries()[plain](spark, SF)
    ids = lambda df: {tuple(map(str, r)) for r in df.collect()}
    if key is None:
        got, want = ids(near.select("memory_id")), ids(all_.select("vec_id"))
    else:
        own = "query_id" if plain == "hybrid_retrieval" else "candidate_id"
        got, want = ids(near.select(own, key)), ids(all_.select(own, key))
    assert len(got & want) >= 0.9 * len(want)


# Terms


def chunks(spark, rng, n):
    words = [f"w{i}" for i in range(60)] + ["Pump", "pumps", "naïve", "x·y", "ERR-4012", "err", "40", "4012", "PN/607", "e"]
    rows = [(f"c{i:05}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) if i % 11 else None, [f"K-{i % 40}", None, "two words"] if i % 7 else None, f"a{i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, content string, keywords array<string>, asset_id string")


def test_terms_looked_up_are_terms_looked_for(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = chunks(spark, rng, 700).persist()
    parts = ["w1", "W1", "ump", "err 4012", "K-3", "two", "x·", "ï", "e", "ERR-4012", "zzz", "w1 zzz", "-", "words k", "na"]
    queries = [(i, [rng.choice(parts) for _ in range(rng.randrange(0, 3))]) for i in range(150)]
    asked = spark.createDataFrame(queries, "query_id int, terms array<string>").withColumn("vector", F.array(F.lit(1.0)))
    monkeypatch.setattr(retrieval, "ASKED_AT_ONCE", 1000)
    want = sorted(map(tuple, retrieval.keyword_leg(asked, rows, per_leg=12).collect()))
    monkeypatch.setattr(retrieval, "ASKED_AT_ONCE", 0)
    index = TermIndex.build(rows, str(tmp_path))
    assert len(want) > 300
    for terms in (None, index):
        assert sorted(map(tuple, retrieval.keyword_leg(asked, rows, per_leg=12, terms=terms).collect())) == want
    empty = rows.limit(0)
    assert retrieval.keyword_leg(asked, empty, per_leg=12).count() == 0


def test_many_unscoped_questions_meet_postings_by_equi_joins(spark, tmp_path):
    """20,000 questions: no nested loop, and few candidates beside the product."""
    rng = random.Random(2)
    rows = chunks(spark, rng, 500)
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.concat(F.lit("K-"), (F.col("id") % 60).cast("string"))).alias("terms"), F.array(F.lit(1.0)).alias("vector"))
    leg = retrieval.keyword_leg(asked, rows, per_leg=12, terms=TermIndex.build(rows, str(tmp_path)))
    assert "NestedLoop" not in plan(leg) and "CartesianProduct" not in plan(leg)
    assert leg.select("query_id").distinct().count() > 10_000


# Verdicts and conflicts


def test_history_as_of_is_what_was_known_then(spark):
    """Several verdicts a memory, ties, days without any, nulls, and one asset with most of them."""
    rng = random.Random(6)
    time = lambda: f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 5):02}T0{rng.randrange(3)}:00:00Z"
    memories = [(f"m{i:02}", rng.choice(["hot", "hot", "a", "b", None]), rng.choice([time(), time(), None])) for i in range(60)]
    verdicts = [(f"v{i:03}", rng.choice(memories)[0], rng.choice(["validated", "rejected", None]), f"why {i}", rng.choice([time(), time(), time(), None])) for i in range(160)]
    m = spark.createDataFrame(memories, "memory_id string, asset_id string, updated_at string")
    v = spark.createDataFrame(verdicts, "verdict_id string, memory_id string, verdict string, rationale string, evaluated_at string")
    asset = {i: a for i, a, _ in memories}
    for as_of in (None, "updated_at"):
        got = sorted(map(tuple, verdict_history(m, v, m, as_of=as_of).collect()), key=str)
        want = []
        for i, a, t in memories:
            if a is None or as_of and t is None:
                continue
            known = [x for x in verdicts if asset[x[1]] == a and (as_of is None or x[4] is not None and x[4] <= t)]
            known.sort(key=lambda x: (x[1], x[0]))
            known.sort(key=lambda x: x[4] or "", reverse=True)
            want += [(i, *x[:4], p + 1) for p, x in enumerate(known[:4]) if x[1] != i]
        assert got == sorted(want, key=str)


def test_earlier_decisions_stay(spark):
    schema = "conflict_id string, status string, jev_recommendation struct<verdict: string, rationale: string>, recommended_by_verdict string, resolution string, resolved_by string, resolution_winner string, resolved_at string"
    rows = spark.createDataFrame([("done", "resolved", ("validated", "seen"), "v1", "kept", "ann", "edge", "2024"), ("told", "open", ("rejected", "worn"), "v2", "", "", None, None), ("new", "open", ("validated", "fresh"), None, "", "", None, None)], schema)
    told = gate.recommend(rows, spark.createDataFrame([("new", "validated", "look", "v9"), ("done", "rejected", "late", "v8")], "conflict_id string, verdict string, rationale string, verdict_id string"))
    decided = gate.confirm(told, spark.createDataFrame([("told", "cloud", "theirs", "bob"), ("done", "cloud", "again", "eve")], "conflict_id string, winner string, resolution string, resolved_by string"), now="2025")
    got = {r.conflict_id: (r.status, r.recommended_by_verdict, r.resolution_winner, r.resolved_at, r.resolved_by) for r in decided.collect()}
    assert got == {"done": ("resolved", "v1", "edge", "2024", "ann"), "told": ("resolved", "v2", "cloud", "2025", "bob"), "new": ("open", "v9", None, None, "")}
