"""What grows with the tables: texts stay where they are, postings are not stored, and pairs of vectors are compared by products."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import evaluate, products, retrieval, vector_index
from fieldmark.operators.evaluate import fleet_neighbours
from fieldmark.operators.nearest import closest, first_copies
from fieldmark.operators.term_index import TermIndex
from fieldmark.operators.vector_index import VectorIndex
from fieldmark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffled(df):
    """The columns that some exchange of the plan carries."""
    return {c for part in plan(df).split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip()) for c in re.findall(r"(\w+)#", part.split("Input")[1].split("\n")[0])}


def test_an_index_of_words_stores_no_postings(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.lit("pump valve filter " * 20).alias("content"), F.array(F.lit("err-4012")).alias("keywords"))
    TermIndex.build(rows, str(tmp_path))
    assert os.listdir(tmp_path) == ["words"] and spark.read.parquet(str(tmp_path / "words")).count() == 5


@pytest.mark.parametrize("name", ["keyword_leg", "hybrid_retrieval", "fallback_unfiltered", "answer_citations", "fleet_documents"])
def test_texts_are_not_shuffled_to_be_searched(spark, name):
    """Nor broadcast with their vectors, whatever a planner holds for small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert not {"text", "content", "__c"} & shuffled(catalog.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("bound", [0, 1000])
def test_equal_terms_are_asked_once(spark, tmp_path, monkeypatch, scoped, bound):
    """Marks in and beside words, ids that come twice, and scopes; with few words that are broadcast, and with postings that are shuffled."""
    from fieldmark.operators import term_index

    rng = random.Random(4)
    words = ["err-4012", "ERR 4012,", "(pump)", "a/b", "x·y", "Ünit7", "4012.", "'note'", "z"]
    texts = [(f"c{i // 2 if i > 380 else i:03}", " ".join(rng.choice(words) for _ in range(4)) if i % 9 else None, ["PN-607", None] if i % 3 else None, f"a{i % 3}") for i in range(400)]
    rows = spark.createDataFrame(texts, "id string, content string, keywords array<string>, asset_id string").persist()
    sets = [["ERR-4012"], ["4012", "pump"], ["nit7"], ["PN-607"], ["x·y"], ["a/b"], ["none"], []]
    asked = spark.createDataFrame([(i, rng.choice(sets), rng.choice(["a0", "a1", "none", None])) for i in range(300)], "query_id int, terms array<string>, scope string").withColumn("vector", F.array(F.lit(1.0)))
    leg = lambda terms=None: sorted(map(tuple, retrieval.keyword_leg(asked, rows, per_leg=7, scoped=scoped, terms=terms).collect()))
    monkeypatch.setattr(retrieval, "ASKED_AT_ONCE", 1000)
    want = leg()
    assert len(want) > 500
    monkeypatch.setattr(retrieval, "ASKED_AT_ONCE", 64)
    monkeypatch.setattr(term_index, "WORDS", bound)
    monkeypatch.setattr(term_index, "TERMS", bound)
    assert leg() == leg(TermIndex.build(rows, str(tmp_path))) == want


@pytest.mark.parametrize("key", [None, ("asset", "asset_id")])
@pytest.mark.parametrize("group", [50, 65_536])
def test_products_find_the_nearest(spark, monkeypatch, key, group):
    """Copies, multiples that tie but for their ids, other lengths, nearly equal ones, and vectors without a cosine."""
    monkeypatch.setattr(products, "ROWS", group)
    monkeypatch.setattr(products, "MOST", group)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1200, 6)).round(3).tolist()
    v[100:200] = [v[100]] * 100
    v[200:300] = [[x * f for x in v[200]] for f in rng.uniform(0.5, 9, 100).tolist()]
    v[300:400] = [[x + 1e-6 * i for x in v[300]] for i in range(100)]
    v[20:26], v[40], v[60], v[80] = [[1.0, 2.0]] * 6, [3.0], None, [0.0] * 6
    names = rng.permutation(1200)
    rows = spark.createDataFrame([(f"m{names[i]:04}", f"a{i % 3}" if i % 50 else None, i, x) for i, x in enumerate(v)], "memory_id string, asset_id string, n int, __e array<double>").repartition(3).persist()
    asked = rows.where("n % 4 = 0").select(F.col("memory_id").alias("candidate_id"), F.col("asset_id").alias("asset"), F.col("__e").alias("__v"))
    found = lambda df: {(r.candidate_id, r.position): (r.memory_id, r.similarity) for r in df.collect()}
    got, want = found(products.by_products(asked, rows, id="memory_id", k=5, key=key)), found(closest(asked, rows, id="memory_id", k=5, key=key))
    assert got == want and len(got) > 1000
    assert "FlatMapCoGroupsInArrow" in plan(products.by_products(asked, rows, id="memory_id", k=5, key=key))


@pytest.mark.parametrize("name", ["fleet_documents", "hybrid_retrieval", "fallback_unfiltered"])
def test_many_queries_are_compared_by_products(spark, monkeypatch, name):
    want = sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(retrieval, "PRODUCTS", 1)
    df = catalog.queries()[name](spark, SF)
    assert "FlatMapCoGroupsInArrow" in plan(df) and sorted(map(str, df.collect())) == want


@pytest.mark.parametrize("group", [10, 60])
def test_many_queries_search_lists_within_a_key_by_cells(spark, tmp_path, monkeypatch, group):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8))
    v = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8)) * 0.3).round(3).tolist()
    v[7], v[9], v[11] = None, [1.0, 2.0], [2.0, 1.0]
    rows = spark.createDataFrame([(f"m{i:04}", f"a{i % 4}" if i > 3 else "rare", i, x) for i, x in enumerate(v)], "id string, asset_id string, n int, embedding array<double>").repartition(2).persist()
    index = VectorIndex.build(rows, str(tmp_path))
    monkeypatch.setattr(vector_index, "GROUP_ROWS", group)
    asked = rows.where("n % 4 < 2 or n < 20").select(F.col("id").alias("candidate_id"), F.col("asset_id").alias("scope"), F.col("embedding").alias("__v"))
    where = F.col("n") % 7 != 0
    near = index.search(asked, k=4, key=("scope", "asset_id"), where=where, exact=False)
    assert "FlatMapCoGroupsInArrow" in plan(near)
    got = {(r.candidate_id, r.id) for r in near.collect()}
    want = {(r.candidate_id, r.id) for r in closest(asked, rows.where(where).withColumnRenamed("embedding", "__e"), id="id", k=4, key=("scope", "asset_id")).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want) > 2500
    exact = index.search(asked, k=4, key=("scope", "asset_id"), where=where)
    assert {(r.candidate_id, r.id) for r in exact.collect()} == want


def test_one_memory_stands_for_those_of_its_vector(spark, tmp_path):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(60, 5)).round(2).tolist()
    rows = spark.createDataFrame([(f"m{i:04}", v[i % 60] if i % 7 else v[3]) for i in range(900)], "memory_id string, embedding array<double>").persist()
    held = rows.groupBy("embedding").agg(F.min("memory_id").alias("stands_for"))
    index = VectorIndex.build(held.select(F.col("stands_for").alias("memory_id"), "embedding"), str(tmp_path), id="memory_id")
    copies = first_copies(rows, by=["embedding"], id="memory_id", k=7).join(held, "embedding").select("stands_for", "memory_id")
    asked = rows.where("memory_id like '%0' or memory_id < 'm0040'")
    same = lambda **o: {(r.candidate_id, r.position): (r.memory_id, r.similarity) for r in fleet_neighbours(asked, rows, **o).collect()}
    assert same(index=index, copies=copies) == same() and len(index) == 60


def test_the_edge_does_not_search_the_fleet(spark):
    """Its judge is shown documents only."""
    assert "observations" not in catalog._context(spark, SF, "edge").columns and "fleet-vectors" not in plan(catalog.queries()["edge_evaluation"](spark, SF))


@pytest.mark.parametrize("side", [3, 8192])
@pytest.mark.parametrize("name", ["edge_evaluation", "judge_prompts"])
def test_texts_go_to_the_candidates_of_their_asset_once(spark, monkeypatch, name, side):
    """Not once for each candidate that found them; the same prompts."""
    want = sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(evaluate, "PRODUCTS", 1)
    monkeypatch.setattr(evaluate, "SIDE_BY_SIDE", side)
    df = catalog.queries()[name](spark, SF)
    assert "REPARTITION_BY_NUM" in plan(df) and sorted(map(str, df.collect())) == want and len(want) == 50
