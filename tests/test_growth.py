"""What keeps the work of a query in proportion to its input: nothing dear is computed more often than it is needed."""

import math
import re

from pyspark.sql import functions as F

from fieldmark.functions import text as X
from fieldmark.functions.vector import cosine, hash_embed
from fieldmark.operators import nearest
from fieldmark.operators.evaluate import fleet_neighbours
from fieldmark.operators.term_index import TermIndex
from fieldmark.plans import catalog

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def slow_embed(text):
    counts = [0] * 32
    for t in re.findall("[a-z0-9]+", text):
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) % (1 << 32)
        counts[h % 32] += 1
    n = math.sqrt(sum(x * x for x in counts))
    return [x / n if n else 0.0 for x in counts]


def test_a_text_is_embedded_once(spark):
    texts = ["pump valve pump", "", "...", "a" * 40 + " z9" * 30 + " 2019-11 err4012", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.v for r in df.select("i", hash_embed(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [slow_embed(t) for t in texts] and got[len(texts)] is None
    assert optimized(df.select(cosine(hash_embed(F.col("t")), hash_embed(F.col("t"))))).count("lower(t#") == 2
    assert optimized(catalog.queries()["hash_embed"](spark, SF)).count("lower(text#") == 1


def test_texts_are_not_chunked_to_tell_which_documents_are_replaced(spark):
    odd = ["a", " ", "", None, " \n\t \r\n", " ", "\x0b\x1c", "a\n\n\nb", "\u0085", "\n\n.\n"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert df.where(X.has_chunks(F.col("t")) != F.coalesce(F.size(X.chunk_text(F.col("t"))) > 0, F.lit(False))).count() == 0
    assert optimized(catalog.queries()["ingest_chunks"](spark, SF)).count("Generate explode") == 2


def test_an_index_of_words_is_never_broadcast(spark, tmp_path):
    """Its files are far smaller than its rows in memory, so a broadcast by their size fills the driver."""
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("pump "), F.col("id").cast("string")).alias("content"), F.array(F.lit("err-4012")).alias("keywords"))
    index = TermIndex.build(rows, str(tmp_path))
    queries = spark.createDataFrame([(1, ["err", "19"]), (2, ["pump", "7"]), (3, ["none"])], "query_id int, tokens array<string>")
    for few in (True, False):
        found = index.candidates(queries, few)
        assert {(r.query_id, r.id) for r in found.collect()} == {(1, str(i)) for i in range(200) if "19" in str(i)} | {(2, str(i)) for i in range(200) if "7" in str(i)}
    # Each join with a table of the index says that the other side travels.
    assert optimized(index.candidates(queries)).count("strategy=") >= 3


def test_equal_queries_and_vectors_are_compared_once(spark):
    """3,000 candidates of three vectors among 3,000 memories: results as before, each from a few rows."""
    vector = F.array((F.col("id") % 3 + 1).cast("double"), F.lit(1.0))
    rows = spark.range(3000).select(F.format_string("m%05d", "id").alias("memory_id"), vector.alias("embedding"))
    near = fleet_neighbours(rows, rows, k=2)
    got = {(r.candidate_id, r.position): r.memory_id for r in near.collect()}
    assert len(got) == 6000
    assert (got["m00003", 1], got["m00003", 2]) == ("m00000", "m00006") and (got["m00000", 1], got["m00000", 2]) == ("m00003", "m00006")
    once, members = nearest.asked_once(rows.withColumn("scope", F.lit(None).cast("string")), id="memory_id")
    assert once.count() == 3 and members.count() == 3000
    assert nearest.first_copies(rows, by=["embedding"], id="memory_id", k=3).count() == 9
