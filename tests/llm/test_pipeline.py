"""The corpus pipeline over made documents, stage by stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    kinds = {"xx": "ba be bi bo bu da de du".split(), "yy": "kra kre kri lom lum nam".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    item = make("xx", 30)
    base = make("xx", 120).split()
    near = [*base[:60], "other", *base[61:]]
    rows = [(i, make(("xx", "yy")[i % 2], 60), ("xx", "yy")[i % 2], f"s{i % 4}") for i in range(120)]
    rows += [(500, " ".join(base), "xx", "s0"), (501, " ".join(near), "xx", "s1"), (502, "123 456", "xx", "s0"), (503, None, "xx", "s0"), (504, make("xx", 20) + " " + item, "xx", "s2"), (505, "", None, None)]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    every = {r[0] for r in rows}
    assert seen["language ID"] == every - {502, 503, 505}
    assert seen["MinHash near-dedup"] == seen["language ID"] - {501}
    assert seen["benchmark decontamination"] == seen["MinHash near-dedup"] - {504}
    assert seen["sharding"] == seen["mixing sources"] <= seen["benchmark decontamination"]
    out = P.run(spark, d)
    assert {"shard", "slot", "grown_shard", "text"} <= set(out.columns)
    counts = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == r.slots == r["last"] + 1 for r in counts)


def test_pipeline_of_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0


def test_clashing_extra_columns_go_through_untouched(spark, tmp_path):
    rng = random.Random(2)
    d = str(tmp_path)
    rows = [(i, " ".join(rng.choice("ba be bi bo bu".split()) + rng.choice("la le li".split()) for _ in range(40)), "xx" if i % 2 else "yy", f"s{i % 3}", 1) for i in range(60)]
    extra = ("a.b", "shard", "slot", "__h", "h", "row", "copies", "score", "leaked_items", "text_hash")
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        mine = [c for c in extra if name != P.STAGES[-1][0] or c not in ("shard", "slot")]
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in mine), name
