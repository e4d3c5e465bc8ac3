"""Periodic runs, exact duplicates and the audit of filter orders against brute force, and on the cases that tend to break them."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldmark.llm import exactdup, filteraudit, queries, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# Runs


def slow_runs(words, least):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 4)), max_size=8), st.sampled_from([2, 5, 12]))
def test_runs_are_those_of_brute_force(parts, least):
    words = [str(x) for root, times in parts for x in root * times]
    assert runs.word_runs(words, least) == slow_runs(words, least)


class Compared:
    """A value with an order and no hash, that counts how often it is compared."""

    times = 0
    __hash__ = None

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Compared.times += 1
        return self.value == other.value

    def __ne__(self, other):
        Compared.times += 1
        return self.value != other.value

    def __lt__(self, other):
        Compared.times += 1
        return self.value < other.value


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def zimin(letters):
    word = ""
    for c in letters:
        word = word + c + word
    return word


@pytest.mark.parametrize("word", ["a" * 20_000, "ab" * 10_000, fibonacci(20_000), ("a" * 140 + "b") * 140, ("b" * 140 + "a") * 140, zimin("abcdefghijklmn"), zimin("nmlkjihgfedcba"), "".join("a" * i + "b" for i in range(200)), "".join("b" * i + "a" for i in range(200, 0, -1))])
def test_comparisons_are_linear(word):
    """Words that repeat at every scale: some comparisons a word, and values that have no hash."""
    values = [Compared(c) for c in word]
    for falling in (False, True):
        Compared.times = 0
        runs.lyndon_edges(values, falling)
        assert Compared.times <= 8 * len(word)
    Compared.times = 0
    runs.word_runs(values, 2)
    assert Compared.times <= 20 * len(word)


def test_run_columns(spark):
    """Null, empty, blank and long texts, repeated rows, clashing and odd columns."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 6), (4, "a b " * 6), (5, "x " + "la " * 12 + "y z \x0by"), (6, "a b c " * 4 + "d " * 12), (7, " ".join(f"w{i}" for i in range(60_000))), (None, "no run here")]
    df = docs(spark, rows).withColumn("runs", F.lit("mine")).withColumn("a.`b", F.lit(1))
    got = {(r.doc_id, r.text): r for r in runs.find_runs(df).collect()}
    assert {k[0]: [tuple(x) for x in r.runs] for k, r in got.items() if k[0] != 7} == {1: [], 2: [], 3: [], 4: [(0, 12, 2)], 5: [(1, 12, 1)], 6: [(0, 12, 3), (12, 12, 1)], None: []}
    assert {k[0]: r.collapsed for k, r in got.items() if k[0] != 7} == {1: "", 2: "", 3: "", 4: "a b", 5: "x la y z y", 6: "a b c d", None: "no run here"}
    assert got[7, rows[7][1]].collapsed == rows[7][1] and "a.`b" in df.columns
    assert runs.find_runs(df).where("doc_id = 4").count() == 2
    assert runs.find_runs(df.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in runs.collapse_runs(df).collect()}
    assert cut[1] is None and cut[3] == " \t\n" and cut[4] == "a b" and runs.collapse_runs(df).columns == df.columns


def test_longest_run_ties(spark):
    df = spark.createDataFrame([(1, [(9, 20, 3), (2, 20, 4), (2, 20, 1)]), (2, [])], "id int, runs array<struct<start:long,length:long,period:long>>")
    got = {r.id: r.top and tuple(r.top) for r in df.select("id", runs.longest_run(F.col("runs")).alias("top")).collect()}
    assert got[1] == (2, 20, 1) and set(got[2]) == {None}


def test_op11_on_periodic_texts(spark, tmp_path):
    """The query against its contract written down plainly."""
    import zlib

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90)))) for i in range(150)] + [(1000, None), (1007, "  x  ")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    made = 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            made += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        want = slow_runs(words, 12)
        gone = {j for s, length, q in want for j in range(s + q, s + length)}
        r = got[i]
        assert r.n_runs == len(want)
        top = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
    assert made > 5


def test_op11_on_texts_without_words_that_are_drawn(spark, tmp_path):
    """A text to be made periodic may have no word; with ANSI rules a remainder by its number of words is an error."""
    import zlib

    drawn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, ("", " \t\n", None, "one")[k % 4]) for k, i in enumerate(drawn)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) > 8
    for i, text in rows:
        assert (got[i].n_runs, got[i].start) == (0, None)
        assert got[i].collapsed_sha256 == hashlib.sha256((text or "").strip().encode()).hexdigest()


# Exact duplicates


def slow_groups(rows, same=lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")):
    groups = {}
    for i, t in rows:
        groups.setdefault(same(t), []).append(i)
    return groups


@pytest.mark.parametrize("narrow", [True, False])
def test_exact_duplicates(spark, monkeypatch, narrow):
    """Groups by brute force; texts that differ only late, only in white space, only in length; null and empty; a third of all in one group."""
    if not narrow:
        monkeypatch.setattr(exactdup, "BROADCAST_KEYS", 0)
    rng = random.Random(3)
    head = "h" * 200
    texts = [head + c for c in "abca"] + ["", None, " ", "\t \n", "x y", "x y", "x\x0cy", "x  y", head] + ["hot"] * 40 + ["".join(rng.choice("ab ") for _ in range(rng.randrange(6))) for _ in range(80)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = docs(spark, rows).repartition(5)
    got = {r.doc_id: r for r in exactdup.exact_duplicates(df).collect()}
    groups = slow_groups(rows)
    assert len(got) == len(rows) == sum(map(len, groups.values()))
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(members), len(members), i == min(members))
    kept = exactdup.drop_exact_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values())) and kept.columns == df.columns


def test_exact_duplicates_reads_whole_texts_of_survivors_only(spark):
    """Only rows whose length and beginning recur are hashed whole."""
    rows = [(0, "short"), (1, "abcde"), (2, "a" * 100), (3, "a" * 99 + "b"), (4, "a" * 100), (5, "b" * 100), (6, "longest of them all")]
    got = {r.doc_id: r.whole for r in exactdup.exact_duplicates(docs(spark, rows)).collect()}
    assert {i for i, w in got.items() if w is not None} == {2, 3, 4}


def test_exact_duplicates_repeated_rows_null_ids_and_odd_columns(spark):
    df = docs(spark, [(1, "a  b"), (1, "a b"), (1, "a b"), (None, "a b"), (None, "n"), (None, "n"), (2, "other")]).withColumn("kept", F.lit("c")).withColumn("a.`b", F.lit(1)).withColumn("text_", F.lit(None))
    got = exactdup.exact_duplicates(df, carry=("a.`b",)).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert sorted((r.doc_id is None, r.keep_id is None, r.group_size) for r in got) == [(False, False, 1)] + [(False, False, 4)] * 3 + [(True, False, 4)] + [(True, True, 2)] * 2
    kept = exactdup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    assert exactdup.exact_duplicates(df.limit(0)).count() == 0 and exactdup.drop_exact_duplicates(df.limit(0)).count() == 0


# Audit of filters


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_plain_changes_visit_every_order_by_single_swaps(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in filteraudit.plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n))) and len(list(filteraudit.plain_changes(n))) == len(seen) - 1


def test_each_swap_counts_two_steps():
    walk = filteraudit.Walk(np.ones((2, 32, 3), np.int64), 5)
    counted = []
    count = walk.count
    walk.count = lambda step: (counted.append(step), count(step))
    assert len(list(walk.visit())) == 120 and len(counted) == 5 + 2 * 119


def slow_audit(rows, marks, filters):
    """rows: (part, filters failed as a set, id)."""
    out = {}
    for order in itertools.permutations(filters):
        for part in {p for p, _, _ in rows}:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, failing = [r for r in left if f in r[1]], [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                lost = [sum(bool(marks.get(r[2], (0, 0))[k]) for r in gone) for k in (0, 1)]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), *lost]
    for part, order, step in list(out):
        out[part, order, step].append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1] and len(v) in (6, 7)))
    return out


@pytest.mark.parametrize("narrow", [True, False])
def test_audit_is_that_of_every_order_run(spark, monkeypatch, narrow):
    """Every order run by brute force: nulls in every column, repeated rows, several labels of an id, copies across parts, clashing names."""
    if not narrow:
        monkeypatch.setattr(filteraudit, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    table = [(i, rng.choice([None, "", "a", "ab", "abc", "b", "ca", "long " * 30]), rng.choice([None, "", "en", "de"])) for i in range(120)]
    table += table[:5] + [(None, "abc", "en"), (None, "abc", "en"), (500, "abc", "de")]
    df = spark.createDataFrame([(i, t, p, 1, 2, 3) for i, t, p in table], "doc_id long, text string, lang string, part int, digest int, copied int")
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    text = F.coalesce("text", F.lit(""))
    got = filteraudit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"A": F.length(text) < 2, "B": F.col("text").contains("b"), "C": text.startswith("a")}, copies="E")
    marks = {}
    for i, q, t in labels:
        if i is not None:
            good, bad = marks.get(i, (False, False))
            marks[i] = (good or q == 1, bad or t == 1)
    first = {}
    for i, t, _ in table:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, p in table:
        s = t or ""
        bad = {f for f, fails in zip("ABCE", (len(s) < 2, "b" in s, s.startswith("a"), i is not None and i > first[s]), strict=True) if fails}
        rows.append((p or "", bad, i))
    found = {(r.part, r.filter_order, r.step): [r[c] for c in filteraudit.COUNTS] for r in got.collect()}
    assert found == slow_audit(rows, marks, "ABCE") and len(found) == 3 * 24 * 4


def test_audit_of_empty_tables(spark):
    df, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit_filters(df, labels, {"A": F.col("text").isNull()}, copies="E").count() == 0
    one = docs(spark, [(1, None)])
    assert [r.removed for r in filteraudit.audit_filters(one, labels, {"A": F.col("text").isNull()}).collect()] == [1]
    with pytest.raises(ValueError):
        filteraudit.audit_filters(one, labels, {})
