"""What must hold at any number of labels, sources and words, and for rows in any order."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import decontam, langid, mixing, neardup, sampling, sharding
from fieldmark.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# Near-duplicates


def group(n, rng, common):
    """A text and ``n`` copies with up to a tenth of their words changed, most to words that other copies have too; and one as far off
    as can be linked."""
    words = [f"w{i}" for i in range(220)]
    rows = [words]
    for i in range(n):
        copy = list(words)
        for at in rng.sample(range(220), rng.choice([1, 2, 10, 11, 12])):
            copy[at] = rng.choice(common)
        rows.append(copy)
    return [" ".join(w) for w in rows]


def opened(spark, texts, ids):
    found = neardup.NearDuplicates(docs(spark, [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]), ngram=2, percent=80)
    entries = found.shared_keys()
    links = found.confirm(found.hub_pairs(entries))
    return found.open_pairs(entries, components(links)).count()


def test_work_on_a_large_group_does_not_depend_on_the_order_of_ids(spark):
    rng = random.Random(4)
    texts = group(250, rng, [f"c{i}" for i in range(12)])
    n = len(texts)
    shuffled = list(range(n))
    rng.shuffle(shuffled)
    made = [opened(spark, texts, ids) for ids in (range(n), range(n - 1, -1, -1), shuffled)]
    assert max(made) <= 3 * max(min(made), n // 10)


# Language identification


def test_any_number_of_languages(spark):
    """Every label with six lettered rows is learned, also where most rows of it hold no letter."""
    labels = 2000
    rows = [(i * 6 + k, f"word{i} {k} x{i % 17}", f"l{i:04}", "s", 0) for i in range(labels) for k in range(6)]
    rows += [(100_000 + k, str(k), "l0007", "s", 0) for k in range(400)]
    model = langid.fit_languages(docs(spark, rows))
    assert len(model.languages) == labels


def test_smallest_hashes(spark):
    """As many rows of each value as are asked for, the same ones in any order."""
    rows = [(i, f"t{i}", f"l{i % 3}", "s", 0) for i in range(3000)] + [(5000, "rare", "r", "s", 0)] * 3
    counts = {f"l{i}": 1000 for i in range(3)} | {"r": 3}
    picked = [sorted(map(tuple, sampling.smallest_hashes(docs(spark, rows).repartition(p), "doc_id", "lang", counts, 20).select("doc_id", "lang").collect())) for p in (2, 7)]
    assert picked[0] == picked[1] and len(picked[0]) == 61


# Decontamination


def test_words_of_a_pass_are_counted_as_they_are_compared(spark, monkeypatch):
    """Words parted by commas only are many: no pass holds more than it may."""
    held = []
    of = decontam.Items.of
    monkeypatch.setattr(decontam, "WORDS_A_PASS", 100)
    monkeypatch.setattr(decontam.Items, "of", lambda ids, texts, least: (held.append(sum(len(t.split(",")) for t in texts)), of(ids, texts, least))[1])
    items = [(i, ",".join(f"q{i}x{k}" for k in range(20))) for i in range(30)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(docs(spark, [(1, "say " + items[7][1].replace(",", " ") + " end", "en", "s", 0), (2, "nothing here", "en", "s", 0)]), table)
    assert {r.doc_id: r.leaked_items for r in got.collect()} == {1: [7], 2: []}
    assert sum(held) == 600 and len(held) >= 6 and max(held) <= 200


# Mixing


def slow_targets(sizes, weights, cap):
    """Shares by weight, with what is above a cap shared again, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        left, open_ = total - sum(held.values()), [s for s in names if s not in held]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}
        if len(held) == len(names):
            return held


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000])
def test_targets_of_many_sources(spark, n):
    rng = random.Random(n)
    sizes = {f"host{rng.random()}": rng.choice([0, 1, 5, 900, 100_000]) for _ in range(n)} | ({None: 40} if n else {})
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(table, (5, 2, 1), 3.0).collect()}
    assert got == pytest.approx(slow_targets(sizes, (5, 2, 1), 3.0) if n else {}, rel=1e-9)


def test_sources_are_ranked_in_many_tasks(spark):
    table = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 1000 + 1000, F.lit("-"), F.col("id")).alias("source"), F.lit(1).cast("long").alias("source_size"))
    done = mixing.ranked(table)
    got = [r.source for r in done.orderBy("rank").collect()]
    assert got == sorted(got) and [r.rank for r in done.orderBy("rank").collect()] == list(range(2000))
    assert "SinglePartition" not in done.select("source", "rank")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


# Sharding


def test_rows_of_one_key_are_ranked_in_many_buckets(spark, tmp_path):
    """A key with all rows: their slots come from many buckets, and are gapless."""
    df = spark.range(3000).select(F.lit(7).alias("key"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sharding.write_shards(df, "key", 4, f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").select("shard", "slot").collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))
    content = F.xxhash64("key", "text")
    order = sharding.key_hash(F.concat_ws("|", F.col("key").cast("string"), content.cast("string")), 16)
    assert df.select((F.shiftright(order, 30) * 1000 / F.lit(1 << 30)).cast("int").alias("b")).distinct().count() > 500
