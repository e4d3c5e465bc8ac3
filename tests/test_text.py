import pytest
from pyspark.sql import functions as F

from fieldmark.functions import text as X
from fieldmark.functions.vector import cosine, hash_embed


def on(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_paragraphs_are_hard_boundaries(spark):
    text = "\n\n".join(f"{name}: " + "word " * 25 + "end." for name in "ABCDE")
    chunks = on(spark, text, lambda c: X.chunk_text(c, 160, 0))
    assert [c[0] for c in chunks] == list("ABCDE") and all(len(c) <= 160 for c in chunks)


def test_packing_keeps_bound_and_overlap_comes_from_before(spark):
    text = " ".join(f"Sentence {i} is short." for i in range(30))
    plain, over = on(spark, text, lambda c: X.chunk_text(c, 200, 0)), on(spark, text, lambda c: X.chunk_text(c, 200, 80))
    assert len(plain) == len(over) > 1 and all(len(c) <= 200 for c in plain)
    for before, chunk, own in zip(plain, over[1:], plain[1:], strict=False):
        assert chunk.endswith(own) and chunk[: -len(own)].strip() in before


def test_long_words_are_cut_and_nothing_is_lost(spark):
    text = "Start here now. " + "x" * 500 + " then more. Also no. 2 filter at 45.5 bar. Done."
    chunks = on(spark, text, lambda c: X.chunk_text(c, 150, 0))
    assert all(len(c) <= 150 for c in chunks)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


def test_line_ends_and_single_newlines(spark):
    assert len(on(spark, "one " * 20 + "\r\n\r\n" + "two " * 20 + "\r\n\r\n" + "three " * 10, lambda c: X.chunk_text(c, 100, 0))) == 3
    assert on(spark, "a b\nc d\ne f", lambda c: X.chunk_text(c, 200, 0)) == ["a b c d e f"]
    assert on(spark, "   ", lambda c: X.chunk_text(c, 200, 0)) == []
    assert on(spark, "a \t\r\nb \r\n", X.normalize_text) == "a\nb\n"


@pytest.mark.parametrize("args", [(10, 0), (200, 200), (200, -1), ("200", 0)])
def test_bad_chunk_sizes(spark, args):
    with pytest.raises(ValueError):
        X.chunk_text(F.lit("x"), *args)


def test_exact_terms(spark):
    assert on(spark, "Error ERR-4212 on PN ZX-99Q, see 8842B.", X.exact_terms) == ["ERR-4212", "ZX-99Q", "8842B"]
    assert on(spark, "fault 42 in part of the pump", X.exact_terms) == ["42"]
    assert on(spark, "why does the pump leak", X.exact_terms) == []


def test_session_phrases(spark):
    assert on(spark, "aircraft msn 4453 again", X.asset_of) == "MSN4453"
    assert on(spark, "on unit id TX-9", X.asset_of) == "TX-9"
    assert on(spark, "part ZX-99 leaks", X.asset_of) is None
    assert on(spark, "The Hydraulics leak at the valve", X.subsystem_of) == "hydraulic"
    assert on(spark, "we already replaced the old filter and reset the breaker", X.actions_in) == ["replaced the old", "reset the breaker"]
    assert [on(spark, t, X.is_context_dependent) for t in ("and now?", "what about the other torque value for the left bolt here", "Which torque applies to the B-nut on aircraft MSN4453 main line")] == [True, True, False]


def test_expansion_adds_only_what_is_missing(spark):
    row = spark.createDataFrame([("does the pump leak?", "pump", "MSN4453"), ("and MSN4453 pump?", "pump", "MSN4453"), ("why?", None, None)], "q string, c string, a string")
    got = [r[0] for r in row.select(X.expand_query(F.col("q"), F.col("c"), F.col("a"))).collect()]
    assert got == ["does the pump leak? (MSN4453)", "and MSN4453 pump?", "why?"]


def test_hash_embedding_is_unit_length_and_cosine_handles_zero(spark):
    df = spark.createDataFrame([("pump valve pump",), ("",)], "t string").withColumn("v", hash_embed(F.col("t")))
    (v,), (zero,) = [(r.v,) for r in df.collect()]
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and set(zero) == {0.0}
    assert df.select(cosine(F.col("v"), F.col("v")).alias("s")).collect()[1].s is None
