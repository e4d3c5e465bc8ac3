"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import nearest
from fieldmark.operators.evaluate import fleet_neighbours
from fieldmark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return "nan" if math.isnan(value) else repr(round(float(value), 6) + 0.0)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = duck.sql(catalog.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(list(sql.columns), sql.fetchall())


def test_every_query_has_sql_but_searches_of_the_nearest_lists():
    assert {q for q in set(catalog.queries()) - set(catalog.oracle_sql()) if not q.endswith("_indexed")} == set() and set(catalog.oracle_sql()) < set(catalog.queries())


@pytest.mark.parametrize("name", ["judge_prompts", "edge_evaluation", "cloud_evaluation"])
def test_evaluations_ask_of_every_id_divisible_by_20(spark, duck, name):
    want = {f"mem-{n:09}" for (n,) in duck.sql("select event_id from events where event_id % 20 = 0").fetchall()}
    got = [r.memory_id for r in catalog.queries()[name](spark, SF).select("memory_id").collect()]
    assert len(want) > 10 and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("key", [None, ("asset", "asset_id")])
@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("few", [10_000, 20])
def test_searches_equal_brute_force(spark, monkeypatch, several, few, key):
    """More rows than the few that bound the rest; ties, and vectors that are null, zero or of another length; candidates in one block, and
    in several."""
    monkeypatch.setattr(nearest, "FEW", few)
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in rng.normal(size=(1500, 4)).round(1)]
    v[3], v[5], v[7], v[20], v[40] = None, [0.0] * 4, [1.0, 2.0], None, [2.0, 1.0]
    rows = [(f"m{i:04}", f"a{i % 3}", x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "memory_id string, asset_id string, embedding array<float>")
    asked = df.where(F.substring("memory_id", 2, 4).cast("int") % 20 == 0).where(F.lit(several) | (F.size("embedding") != 2))
    if key is None:
        found = fleet_neighbours(asked, df)
    else:
        found = nearest.closest(asked.select(F.col("memory_id").alias("candidate_id"), F.col("asset_id").alias("asset"), F.col("embedding").alias("__v")), df.withColumnRenamed("embedding", "__e"), id="memory_id", k=6, key=key)
    got = {(r.candidate_id, r.position): r.memory_id for r in found.collect()}

    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return round(sum(a * b) / (sum(a * a) ** 0.5 * sum(b * b) ** 0.5), 9)

    want = {}
    for r in rows[::20]:
        if r[2] is not None and any(r[2]) and (several or len(r[2]) == 4):
            others = [o for o in rows if (o[0] != r[0] if key is None else o[1] == r[1]) and o[2] is not None and len(o[2]) == len(r[2]) and any(o[2])]
            want |= {(r[0], i + 1): m for i, (_, m) in enumerate(sorted((-cos(r[2], o[2]), o[0]) for o in others)[:6])}
    assert got == want
