"""The shape of plans: what must be pushed down, limited early or kept out of Python."""

import re

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import nearest, retrieval
from fieldmark.plans import catalog

SF = "/root/testdata/sf0.001"
#: Those that find the lists of vectors by matrix products.
LISTS = {"fleet_knn", "fleet_knn_indexed", "fleet_documents_indexed", "hybrid_retrieval_indexed", "judge_prompts"}


def plan(spark, name):
    df = catalog.queries()[name](spark, SF)
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"edge_evaluation", "cloud_evaluation", "answer_question", "embed_batches"} - LISTS))
def test_no_python_and_no_product(spark, name):
    p = plan(spark, name)
    assert not re.search("EvalPython|InPandas|InArrow|PythonUDF", p), name
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["validate_memory", "fingerprint", "sync_eligible", "route_memory", "edge_coerce", "identifier_tokens", "chunk_text", "delete_by_document"])
def test_narrow_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_filtered", "select_knowledge", "list_memories", "scroll_filtered", "open_conflicts", "open_reviews", "audit_trail", "package_items"])
def test_top_k_is_not_a_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("few", [10_000, 5_000])
def test_many_scoped_queries_meet_chunks_by_an_equi_join(spark, monkeypatch, few):
    """20,000 queries, more than are broadcast: no product, neither whole nor by blocks."""
    for module in (nearest, retrieval):
        monkeypatch.setattr(module, "FEW", few)
    vector = F.array(*[F.rand(i) for i in range(8)])
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), vector.alias("vector"), F.array(F.lit("E-11")).alias("terms"), F.concat(F.lit("a"), F.col("id") % 50).alias("scope"))
    chunks = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("document_id"), F.lit("1").alias("version"), F.lit("see e-11").alias("content"), F.concat(F.lit("a"), F.col("id") % 50).alias("asset_id"), F.lit("pump").alias("component"), F.lit("s").alias("source"), F.lit("m").alias("equipment_model"), F.lit("t").alias("doc_type"), F.array(F.lit("k")).alias("keywords"), vector.alias("embedding"))
    for found in (retrieval.retrieve(queries, chunks, scoped=True), retrieval.retrieve_or_widen(queries, chunks)):
        p = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert retrieval.retrieve(queries.limit(30), chunks, scoped=True).count() == 120


def test_unscoped_queries_are_broadcast_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "FEW", 20)
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("__e"))
    asked = spark.range(100).select(F.col("id").alias("candidate_id"), F.array(F.rand(3), F.rand(4)).alias("__v"))
    found = nearest.closest(asked, rows, id="id", k=2)
    p = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" in p and found.count() == 200


def test_ranks_of_a_query_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "fleet_knn")


def test_only_needed_columns_are_read(spark):
    for name, banned in (("scroll_filtered", "text"), ("sync_eligible", "props"), ("vector_topk", "label")):
        for schema in re.findall(r"ReadSchema: (\S+)", plan(spark, name)):
            assert f"{banned}:" not in schema, (name, schema)


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*(role|IsNotNull)", plan(spark, "session_last_context"))


@pytest.mark.parametrize("name", ["fleet_knn", "fleet_knn_indexed", "keyword_leg"])
def test_searches_by_indexes_have_no_nested_loop(spark, name):
    assert "CartesianProduct" not in plan(spark, name) and "NestedLoop" not in plan(spark, name)
