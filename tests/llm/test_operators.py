"""Each training-data operator against brute force and on the cases that tend to break it."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from fieldmark.llm import chat, common, decontam, langid, linededup, mixing, neardup, queries, sampling, sharding, textkit, toxicity, urlrules, vecdup
from fieldmark.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, *texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# Shared text and graph code


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t.Z\x00", max_size=30), min_size=1, max_size=8))
def test_word_hashes_are_those_of_the_words(texts):
    """Equal words, and only those, have equal hashes, wherever they stand."""
    column = pa.array(texts)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold)) for t in texts]
    for block in (1, 1 << 20):
        got = []
        for _, _, raw, offsets in textkit.text_blocks(column, block):
            h, first = textkit.word_hashes(raw, offsets)
            got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert [len(g) for g in got] == [len(w) for w in want]
        seen = {}
        for w, g in zip(itertools.chain(*want), itertools.chain(*got), strict=True):
            assert seen.setdefault(w, g) == g
        assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 4 and got[139] == 100 and got[240] == 200 and 10 not in got


@pytest.mark.parametrize("shape", ["shuffled", "two ends", "star"])
def test_components_of_long_chains_and_a_star(spark, shape, monkeypatch):
    """Few rounds, no bound on them, whatever the order of the ids."""
    nodes = list(range(1000))
    random.Random(4).shuffle(nodes)
    two = [*range(0, 1000, 2), *range(999, 0, -2)]
    edges = {"shuffled": list(zip(nodes, nodes[1:])), "two ends": list(zip(two, two[1:])), "star": [(70_000, i) for i in range(100_000)]}[shape]
    rounds, settled = [], common.settled
    monkeypatch.setattr(common, "settled", lambda *a: rounds.append(1) or settled(*a))
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.id for r in got}) == (100_000 if shape == "star" else 1000) and {r.comp for r in got} == {0}
    assert len(rounds) < 25


def test_scratch_tables_go_with_their_step(spark):
    before = len(common._tables)

    def make():
        return common.stash(common.stash(spark.range(5)).where("id > 1"))

    kept = common.settled(make)
    assert kept.count() == 3 and len(common._tables) == before + 1
    more = common.settled(lambda: kept.where("id > 2"), kept)
    assert more.count() == 2 and len(common._tables) == before + 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


#: Columns that operators use inside, or add, and a name that has to be quoted.
ODD = ("a.b", "h", "__h", "id", "row", "doc", "text_hash", "order", "bucket", "has_letter", "copies", "comp", "shard", "slot", "score", "lang_pred", "margin", "leaked_items", "leaked_words", "group", "key")


def with_odd(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD])


def own_odd(rows, but=()):
    return all(r[c] == f"own {c}" for r in rows for c in ODD if c not in but)


# 1 Line dedup


def brute_lines(texts, n=3, long=50):
    seen, out = set(), []
    for t in texts:
        lines = [x.strip(" \t\r\x0b\x0c").translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)) for x in (t or "").split("\n")]
        at = [i for i, x in enumerate(lines) if x]
        windows = [at[k : k + n] for k in range(len(at) - n + 1)] if len(at) >= n else [at] if at else []
        gone = set()
        for own, kind in [(w, len(w)) for w in windows] + [([i], "long") for i in at if lines[i].count(" ") >= long]:
            key = (kind, *[lines[i] for i in own])
            gone |= set(own) if key in seen else set()
            seen.add(key)
        out.append(sorted(gone))
    return out


@pytest.mark.parametrize(("lines", "ids"), [(10**6, 10**6), (0, 10**6), (0, 0)])
def test_lines_equal_brute_force(spark, monkeypatch, lines, ids):
    """With removed lines broadcast, with their ids broadcast, and with nothing broadcast."""
    monkeypatch.setattr(linededup, "BROADCAST_LINES", lines)
    monkeypatch.setattr(linededup, "BROADCAST_IDS", ids)
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = ["\n".join(rng.choice("abcdE ") + " " * rng.randrange(2) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, "a\nb", "x\n\n \ny\nz", "q\n" * 500]
    texts += ["One\nline " + passage + "\nx1\nx2", "y1\ny2\nLINE " + passage, "only\nthese", " only\n\nThese", "only", "one " * 40, "one " * 40, "w " * 70_000 + "\n" + "z\n" * 9]
    df = docs(spark, *texts).withColumn("removed_lines", F.lit("clash")).withColumn("h", F.lit("own"))
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert [got[i].removed_lines for i in range(len(texts))] == brute_lines(texts)
    assert got[61].text is None and got[60].text == "" and got[63].text == texts[63] and {r.h for r in got.values()} == {"own"}
    assert all(got[i].n_lines == (0 if t is None else t.count("\n") + 1) for i, t in enumerate(texts))
    assert got[66].text == "y1\ny2" and got[68].text == "" and got[71].text == "" and got[70].text == texts[70]


def test_lines_of_repeated_rows_and_empty_table(spark):
    one = docs(spark, "a\nb\nc")
    assert [r.removed_lines for r in linededup.dedup_lines(one.union(one)).collect()] == [[], []]
    assert linededup.dedup_lines(one.limit(0)).count() == 0
    none = one.withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.removed_lines for r in linededup.dedup_lines(none.union(one)).collect()] == [[], []]
    again = one.withColumn("text", F.lit("a\nb\nc\nd"))
    assert sorted(r.removed_lines for r in linededup.dedup_lines(one.union(again)).collect()) in ([[], [0, 1, 2]], [[], [0, 1, 2]])


# 2 Toxicity


def test_toxicity_learns_pairs(spark):
    """Either word alone is harmless; together they are toxic: no linear score can tell."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(WORDS) for _ in range(12)] + ["fool"] * a + ["groupies"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.rate_documents(df.drop("toxic"), df.select("doc_id", "toxic"), rank=4).join(df, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_edges(spark):
    df = docs(spark, "", None, "x " * 50_000, "fine")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.rate_documents(df, labels).collect()] == [0.0] * 4  # one label only: nothing to learn
    m = toxicity.fit_machine([np.array([1]), np.array([2])] * 40, np.array([0, 1] * 40))
    got = toxicity.score_toxicity(df.withColumn("score", F.lit("clash")), m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got) and got[0].score == got[1].score


def test_machine_equals_the_double_sum_over_pairs():
    """The score is a sum over all pairs of terms; the fit is plain gradient descent on it, with AdaGrad's steps."""
    rng = np.random.default_rng(3)
    rows = [rng.choice(9, size=rng.integers(1, 6), replace=False) for _ in range(60)]
    y = np.array([int(0 in r or (1 in r and 2 in r)) for r in rows])
    m = toxicity.fit_machine(rows, y, rank=3, steps=25)
    learned = np.flatnonzero(m.slot >= 0)
    assert len(learned) and m.linear.shape == (len(learned),)

    def slow(ids, bias, w, v):
        at = sorted({int(m.slot[i]) for i in ids if m.slot[i] >= 0})
        return bias + sum(w[i] for i in at) + sum(v[i] @ v[j] for i, j in itertools.combinations(at, 2))

    for r in rows:
        assert m.raw_score(r) == pytest.approx(slow(r, m.bias, m.linear, m.factors), abs=1e-5)
    n, rate, decay = len(learned), 0.3, 1e-5
    bias, w, v = 0.0, np.zeros(n), np.random.default_rng(11).normal(0, 0.02, (n, 3))
    gb, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, 3), 1e-6)
    share = [0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y == 1).sum())]
    for _ in range(25):
        db, dw, dv = 0.0, decay * w, decay * v
        for r, label in zip(rows, y, strict=True):
            e = (1 / (1 + np.exp(-slow(r, bias, w, v))) - label) * share[label]
            at = sorted({int(m.slot[i]) for i in r if m.slot[i] >= 0})
            db += e
            for i in at:
                dw[i] += e
                for j in at:
                    if j != i:
                        dv[i] += e * v[j]
        gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
        bias, w, v = bias - rate * db / gb**0.5, w - rate * dw / gw**0.5, v - 0.1 * rate * dv / gv**0.5
    assert m.bias == pytest.approx(bias, abs=1e-3) and np.allclose(m.linear, w, atol=1e-3) and np.allclose(m.factors, v, atol=1e-3)


def test_toxicity_of_nothing_and_of_repeated_ids(spark):
    df = docs(spark, *["fool " * (i % 3) + f"calm words {i}" for i in range(60)])
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 2).cast("int").alias("toxic"))
    assert toxicity.rate_documents(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.rate_documents(df, labels.limit(0)).collect()} == {0.0}
    twice = df.union(df.withColumn("text", F.concat("text", F.lit(" again")))).union(df.limit(5))
    first, again = (sorted(map(str, toxicity.rate_documents(d, labels).collect())) for d in (twice, twice.repartition(7).orderBy(F.rand(1))))
    assert first == again and len(first) == 125


def test_one_row_of_each_id_is_always_the_same(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    got = [sorted(map(str, sampling.one_row(rows.repartition(n), "doc_id", "text").collect())) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3


# 3 URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.net", "", "allow"), ("b.net", "/x/y", "block")]


def brute_url(url, rules=RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "ROWS_A_RANGE", 20)
    rng = random.Random(1)
    hosts = ["net", "example.net", "WWW.example.NET", "xexample.net", "a.b.net", "c.a.b.net", "b.net", "example.com", "m.example.com", "fr.org", "org", "", "net.", ".net", "a..net", "x:80"]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/?q=/en/", "?x=/de/", "#/en/", "/x/y/z", "/x"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)] + ["http://net/hot"] * 300 + [None, "", "nothing", "://", "a://b://net/", "http://net/\n/en/", "https://exámple.net/en/"]
    pages = spark.createDataFrame([(i, u, "host?") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlrules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    kept = urlrules.filter_urls(pages, rules)
    assert {r.page_id for r in kept.collect()} == {i for i, u in enumerate(urls) if brute_url(u)[3] == "allow"} and kept.columns == pages.columns


def test_rows_are_filtered_by_their_own_url(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://net/"), (1, "http://fine/"), (None, "http://net/x"), (None, "http://fine/"), (2, None), (3, "http://fine/"), (3, "http://fine/"), (4, "http://fine/" + "p" * 100_000), (5, "http://net/" + "p" * 100_000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("NET", "/", "allow"), ("net", "/x", "block"), ("net", "/x", "block")], "host string, path string, verdict string")
    for rows in (20_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        kept = urlrules.filter_urls(pages.withColumn("a.b", F.lit(1)), rules)
        assert sorted((r.page_id or 0, r.url is None) for r in kept.collect()) == [(0, False), (1, False), (2, True), (3, False), (3, False), (4, False)]
    assert urlrules.filter_urls(pages, rules, default="block").count() == 0
    # One rule stated with both verdicts blocks.
    assert {r.verdict for r in urlrules.judge_urls(pages.where("page_id = 5"), rules).collect()} == {"block"}


# 4 Near-duplicates


def brute_near(texts, ngram, percent):
    fold = str.maketrans(urlrules.UPPER, urlrules.LOWER)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("ngram", [2, 5])
def test_near_duplicates_equal_brute_force(spark, ngram):
    rng = random.Random(ngram)
    texts = ["", None, "  \t", "One", "one", "one two", "ONE  two\n", "x " * 3000]
    for _ in range(12):
        base = prose(rng, rng.choice([30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, *texts), ngram=ngram).collect()}
    sizes, comp = brute_near(texts, ngram, 80)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert all(got[i].kept == (comp[i] == i) for i in range(len(texts)))
    kept = neardup.drop_near_duplicates(docs(spark, *texts), ngram=ngram)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(comp) if c == i}


def test_pigeonhole_finds_all_within_the_distance():
    """Signatures that differ in any 17 of the 63 positions share a key."""
    rng = random.Random(2)
    for _ in range(300):
        chunks = [0] * neardup.CHUNKS
        for p in rng.sample(range(neardup.SYMBOLS), 17):
            chunks[p // neardup.WIDTH] += 1
        assert min(chunks) <= 1


def test_near_duplicates_odd_rows(spark):
    none = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(none, ngram=2).collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert neardup.near_duplicates(none.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(with_odd(none.withColumn("text", F.concat("text", F.lit(" d")))), ngram=2).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 7, 7] and own_odd(kept)


def test_rows_of_one_id_are_compared_by_their_own_texts(spark):
    rng = random.Random(12)
    a, b = prose(rng, 40), prose(rng, 40)
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " x"), (9, b + " x"), (3, b), (8, "w " * 80_000 + a), (8, "w " * 80_000 + a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, ngram=2).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (8, 5, False), (8, 5, False), (9, 3, False)]  # a set holds "w w" once
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(df, ngram=2).collect()) == [3, 5]


def test_a_long_chain_of_near_duplicates_is_one_component(spark):
    """Each text is like the next, none like the one after; ids in no order."""
    rng = random.Random(13)
    words = [f"{rng.choice(WORDS)}{i}" for i in range(50 + 4 * 400)]
    ids = list(range(400))
    rng.shuffle(ids)
    df = spark.createDataFrame([(n, " ".join(words[4 * i : 4 * i + 50])) for i, n in enumerate(ids)], "doc_id long, text string")
    got = neardup.near_duplicates(df, ngram=2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


# 5 Chat formatting


def brute_repair(turns):
    """The least cost over all choices of role, merging and insertion, tried one by one."""
    best = None

    def legal(out):
        core = out[1:] if out and out[0] == "system" else out
        return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(core)) and len(core) % 2 == 0 and (bool(core) or not out)

    def go(i, out, cost):
        nonlocal best
        if best is not None and cost >= best or len(out) > 2 * len(turns) + 3:
            return
        if i == len(turns):
            if legal(out):
                best = cost
            for r in ("user", "assistant"):
                go(i, [*out, r], cost + chat.INSERT)
            return
        for to in chat.ROLES:
            wrong = chat.RELABEL * (to != turns[i])
            if out and out[-1] == to:
                go(i + 1, out, cost + chat.MERGE + wrong)
            go(i + 1, [*out, to], cost + wrong)
        for r in ("user", "assistant"):
            go(i, [*out, r], cost + chat.INSERT)

    go(0, [], 0)
    return best


def test_repair_is_cheapest_and_legal():
    for n in range(4):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            cost, out, _ = chat.repair([(r, r) for r in roles])
            assert cost == brute_repair(list(roles)), roles
            core = [r for r, _ in out][out[:1] != [] and out[0][0] == "system" :]
            assert core == ["user", "assistant"] * (len(core) // 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(chat.ROLES), st.text(alphabet="a\\<|>\nend", max_size=12)), max_size=5))
def test_rendering_round_trip(turns):
    assert chat.parse(chat.render(turns)) == turns


def test_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "Human", "a"), (1, 0, "Human", "a"), (2, 0, "user", None), (2, 1, "user", "x"), (3, None, None, "?"), (None, 0, "user", "n")] + [(4, 0, "user", str(i)) for i in range(50)] + [(5, i, ("user", "assistant")[i % 2], "t") for i in range(25)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")), part_turns=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert by[1][0].roles == "user,assistant" and by[1][0].n_turns == 2 and by[1][0].cost == 0
    assert by[2][0].roles == "user,assistant" and by[2][0].merges == 1 and by[None][0].inserts == 1 and by[3][0].relabels == 1
    assert sum(r.n_turns for r in by[4]) == 50 and len(by[4]) > 1 and len(by[5]) == 3 and by[5][0].cost == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_chats_are_repaired_as_a_whole(spark):
    """Parts add up to the cheapest repair of the conversation, whether turns differ in number, or only in role and text."""
    rng = random.Random(3)
    rows = [(1, 0, "system", "s")] + [(1, i, ("assistant", "user")[i % 2], f"t{i}") for i in range(1, 41)]
    for conv in (2, 3, None):
        rows += [(conv, i, rng.choice(["user", "user", "assistant", "system", "tool", None]), f"{conv}\\<|{i}") for i in range(90)]
    rows += [(4, 7, rng.choice(["user", "assistant"]), f"{i:03}") for i in range(60)] + [(5, i, "user", f"u{i}") for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part_turns in (1, 7):
        got = chat.format_chats(df, part_turns=part_turns).orderBy("conv_id", "part").collect()
        for conv in (1, 2, 3, 4, 5, None):
            own = [r for r in got if r.conv_id == conv]
            turns = [r[2:] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3]))]
            cost, legal, edits = chat.repair(turns)
            assert [r.part for r in own] == list(range(-(-len(turns) // part_turns))) and max(r.n_turns for r in own) == part_turns
            assert (sum(r.cost for r in own), {k: sum(r[k] for r in own) for k in edits}) == (cost, edits), conv
            told = chat.parse("".join(r.rendered for r in own))
            assert ",".join(r.roles for r in own if r.roles) == ",".join(r for r, _ in told) and sum(r.n_rendered for r in own) == len(told) == len(legal)
            assert [r for r, _ in told if r != "system"] == ["user", "assistant"] * (len(told) // 2) and "system" not in [r for r, _ in told[1:]]
            assert [t for _, text in told for t in text.split("\n\n") if t] == [t for _, t in turns]
            assert conv != 1 or cost == 0


def test_chats_of_the_tables_equal_repair_of_each(spark):
    """The query over a whole table against one conversation at a time."""
    d = "/root/testdata/sf0.001"
    by = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").distinct().collect():
        by.setdefault(r.conv_id, []).append((r.turn is not None, r.turn, r.role is not None, r.role, r.text is not None, r.text))
    got = {r.conv_id: r for r in queries.queries()["op5_chat_role_repair"](spark, d).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        cost, legal, edits = chat.repair([(t[3], t[5] or "") for t in sorted(turns, key=lambda t: tuple((x is not None, x) for x in t))])
        r = got[conv]
        assert (r.cost, r.rendered, r.n_turns, {k: r[k] for k in edits}) == (cost, chat.render(legal), len(turns), edits)


def test_a_legal_chat_of_many_turns_costs_nothing(spark):
    rows = [(1, i, ("assistant", "user")[i % 2], "t") for i in range(1, 2101)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3 and sum(r.cost for r in got) == 0 and sum(r.n_rendered for r in got) == 2100


# 6 Embeddings


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.2]), int(g % 3)))
    x = np.array([r[0] for r in rows])
    data = [(i, [float(v) for v in r[0]], r[1], "e") for i, r in enumerate(rows)]
    n = len(data)
    data += [(n, None, 0, "e"), (n + 1, [0.0] * 16, 0, "e"), (n + 2, [float("nan")] * 16, 0, "e"), (n + 3, [None] * 16, 0, "e"), (n + 4, data[0][1], None, "e"), (n + 5, data[0][1][:8], 0, "e"), (n + 6, [], 0, "e"), (None, data[0][1], 0, "e")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in vecdup.near_duplicate_vectors(df, rows_a_list=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array([r[1] for r in rows])[:, None] == np.array([r[1] for r in rows])[None])
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(n))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(n))
    assert near.sum() > 100 and all(got[i].n_links == 0 and got[i].kept for i in [*range(n, n + 7), None])
    comp = list(range(n))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((comp[i], comp[j]))
        comp = [a if c == b else c for c in comp]
    assert np.mean([got[i].component_id == comp[i] for i in range(n)]) >= 0.9


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    """Repeated rows are one vector; several vectors of one id are not mixed up, and no link is below the bound."""
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [a + 0.05 for a in v]
    rows = [(5, x, 0), (5, y, 0), (7, near(x), 0), (9, near(y), 0), (11, x, 0), (11, x, 0), (4, x, 1), (4, x, 0)]
    got = sorted(map(tuple, vecdup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == sorted([(5, 3, 4, False), (5, 1, 5, True), (7, 3, 4, False), (9, 1, 5, False), (11, 3, 4, False), (11, 3, 4, False), (4, 0, 4, True), (4, 3, 4, True)])


def test_a_chain_of_drifting_vectors_is_one_component(spark):
    angle = 0.3  # its cosine is 0.955; that of two steps 0.825
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    rows = [(n, [float(np.cos(angle * i / 7) * (i % 7 != 9)), float(np.sin(angle * i / 7)), float(i) * 0.0], i // 150) for i, n in enumerate(ids)]
    got = vecdup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows_a_list=16).collect()
    least = {0: min(ids[:150]), 1: min(ids[150:])}
    label = {n: i // 150 for i, n in enumerate(ids)}
    assert all(r.component_id == least[label[r.vec_id]] for r in got)


def test_lengths_are_sampled_on_their_own(spark):
    """A length with few rows among many of another finds its links too."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(600)]
    base = rng.normal(size=(4, 5))
    rows += [(1000 + i, (base[i % 4] + rng.normal(size=5) * 0.02).tolist(), 0) for i in range(12)]
    got = {r.vec_id: r for r in vecdup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), fit_rows=40, rows_a_list=50).collect()}
    assert all(got[1000 + i].component_id == 1000 + i % 4 and got[1000 + i].n_links >= 2 for i in range(12))


def test_links_of_a_large_group_over_many_lists(spark):
    """A third of the rows are near copies, which take a third of the lists."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    x = np.concatenate([base + rng.normal(size=(500, 64)) * 0.228 / 8, rng.normal(size=(1000, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vecdup.near_duplicate_vectors(df, rows_a_list=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93).sum(1) - 1
    assert near[:500].min() > 100
    assert sum(got.values()) >= 0.9 * near.sum() and all(got[i] <= near[i] for i in got)


@pytest.mark.parametrize("mean", [0.975, 0.998])
def test_either_of_a_pair_probes_the_others_list(mean):
    """400 lists, fitted on rows of which a third are near copies."""
    rng = np.random.default_rng(7)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    base = unit(rng.normal(size=(1, 64)))
    group = unit(base + rng.normal(size=(8000, 64)) * (1 / mean**2 - 1) ** 0.5 / 8)
    coarse = vecdup.kmeans(np.concatenate([group[:6000], unit(rng.normal(size=(12000, 64)))]), 400, 3, 1)
    pq = vecdup.Quantiser(coarse, [], [], 0.0)
    a, b = group[6000:7000], group[7000:]
    na, nb = vecdup.nearest(a, coarse), vecdup.nearest(b, coarse)
    angles, i = np.full(1000, np.arccos(0.93)), np.arange(1000)
    found = pq.reachable(a, na, angles, 2.5)[i, nb] | pq.reachable(b, nb, angles, 2.5)[i, na]
    assert len(set(na.tolist())) > 24 and found[(a * b).sum(1) >= 0.93].mean() >= 0.98


def test_balls_hold_only_linked_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lead, angle = vecdup.gather_balls(x, 0.4)
    for i in set(lead.tolist()):
        own = x[lead == i]
        assert (own @ own.T).min() >= np.cos(0.8) - 1e-9
    assert (angle <= 0.4).all()


def test_no_vectors(spark):
    assert vecdup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 7 Language identification


def test_languages_on_held_out_documents(spark):
    rng = random.Random(8)
    kinds = {"xx": "ba be bi bo bu da de".split(), "yy": "kra kre krü çi ço ñu".split(), "zz": "lom lum lim nam nem".split()}
    texts = [("".join(rng.choice(v) + rng.choice(["", " "]) for _ in range(80)), k) for k, v in kinds.items() for _ in range(40)]
    rows = [(i, t, k) for i, (t, k) in enumerate(texts)] + [(900, None, "xx"), (901, "12 !? 3", "xx"), (902, "", None), (903, "ÇI ÇO ÑU KRÜ KRA " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    assert all(got[i].lang_pred == k for i, (_, k) in enumerate(texts)) and got[903].lang_pred == "yy"
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(with_odd(df))
    assert kept.columns == with_odd(df).columns and own_odd(kept.collect()) and kept.count() == len(texts) + 1
    assert {r.lang_pred for r in langid.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_folded_weights_equal_the_kernel_method():
    """Weights folded into n-grams against explicit kernels, landmarks and the ridge solve."""
    rng = random.Random(21)
    kinds = {"xx": "ba be bi bo bu".split(), "yy": "kra kre kri lom".split(), "zz": "nam nem nim".split()}
    texts = [" ".join(rng.choice(kinds[k]) + rng.choice(kinds[k]) for _ in range(12)) for k in kinds for _ in range(8)]
    labels = [k for k in kinds for _ in range(8)]
    new = [" ".join(rng.choice(kinds[rng.choice(list(kinds))]) for _ in range(9)) for _ in range(10)]

    def bits(ts):
        raw = np.frombuffer("".join(ts).encode(), np.uint8)
        return np.concatenate([p for _, p in langid.presence(raw, np.cumsum([0] + [len(t.encode()) for t in ts]))])

    def grams(t):
        t = f" {t}".encode()
        return {t[i : i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return np.array([[len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5 for y in b] for x in a])

    model = langid.fit(np.packbits(bits(texts).astype(np.uint8), axis=1), labels, landmarks=9, ridge=1e-2)
    marks = [texts[8 * k + i] for i in range(3) for k in range(3)]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(values)
    phi = kernel(texts, marks) @ root
    y = np.where(np.array(labels)[:, None] == np.array(list(kinds)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + 1e-2 * len(texts) / 3 * np.eye(9), phi.T @ y)
    assert np.allclose(model.scores(bits(new)), kernel(new, marks) @ root @ w, atol=0.03)  # hashed n-grams may meet


def test_every_language_is_learned(spark):
    """More languages than the sample would have rows for."""
    rng = random.Random(5)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrs"]
    rng.shuffle(syllables)
    own = {f"l{k:02}": syllables[k * 5 : k * 5 + 5] for k in range(40)}
    rows = [(i, " ".join("".join(rng.choice(v) for _ in range(2)) for _ in range(30)), k) for i, (k, v) in enumerate((k, v) for k, v in own.items() for _ in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(df, fit_rows=60, landmarks=8).collect()}
    assert np.mean([got[i] == k for i, _, k in rows]) > 0.95
    # A margin does not depend on how many languages there are; without one nothing that has a letter goes.
    assert langid.keep_identified(df, min_margin=0.02).count() >= 0.98 * len(rows) and langid.keep_identified(df).count() == len(rows)


def test_languages_of_nothing_repeated_rows_and_long_texts(spark):
    df = spark.createDataFrame([(i, ("la le li " if i % 2 else "kra kro kru ") * 9, ("xx", "yy")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert langid.identify_languages(df.limit(0)).count() == 0 and langid.keep_identified(df.limit(0)).count() == 0
    more = df.union(df.limit(9)).union(df.where("doc_id < 4").withColumn("text", F.lit("kra la " * 5))).union(df.where("doc_id = 1").withColumn("text", F.repeat(F.lit("la le li "), 60_000)))
    first, again = (sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in langid.identify_languages(d).collect()) for d in (more, more.repartition(5).orderBy(F.rand(2))))
    assert first == again and len(first) == 54
    # Two languages of the very same texts: all get the same answer.
    same = spark.createDataFrame([(i, "ab cd ef", ("q", "p")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    tied = langid.identify_languages(same).collect()
    assert len({(r.lang_pred, round(r.margin, 6)) for r in tied}) == 1 and tied[0].lang_pred in ("p", "q")


# 8 Decontamination


def brute_leaks(words, item):
    """Words that agree on the best alignment that holds a run; 0 if none does. Every alignment is tried."""
    best = 0
    for shift in range(1 - len(item), len(words)):
        same = [0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(item)]
        if any(sum(same[a : a + n]) >= n - k for n, k in decontam.runs_of(len(item)) for a in range(len(item) - n + 1)):
            best = max(best, sum(same))
    return best


def test_leaks_equal_a_sliding_scan():
    """Random texts of few words, so that runs with substitutions, repeats and items of every length turn up by chance."""
    rng = random.Random(17)
    some = 0
    for _ in range(120):
        vocabulary = [f"v{i}" for i in range(rng.choice([2, 3, 8, 40]))]
        items = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 7, 8, 10, 11, 13, 15, 16, 30]))] for _ in range(6)]
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))]
        for it in rng.sample(items, 3):
            at = rng.randrange(len(text) + 1)
            part = [w if rng.random() > 0.1 else "other" for w in it]
            text[at:at] = part[rng.randrange(3) :] if rng.random() < 0.5 else part
        table = decontam.Items.of(list(range(6)), [" ".join(w) for w in items])
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        got = table.found(decontam.loose_words(raw, np.array([0, len(raw)]))[0])
        want = {i: n for i, it in enumerate(items) if (n := brute_leaks(text, it))}
        assert got == want
        some += len(want)
    assert some > 100


def test_repeated_words_do_not_multiply():
    """Each of 20,000 words hits each of 200; all diagonals are looked at once."""
    table = decontam.Items.of([1, 2], ["w " * 200, "x " * 200])
    words = decontam.loose_words(np.frombuffer(b"w " * 20_000, np.uint8), np.array([0, 40_000]))[0]
    assert table.found(words) == {0: 200} and len(table.candidates(words)[0]) == 20_199


@pytest.mark.parametrize(("span", "bad"), [*decontam.RUNS, (12, 1), (11, 1), (8, 0)])
def test_masks_find_any_substitutions(span, bad):
    for at in itertools.combinations(range(span), bad):
        assert any(all(not (x == "1" and s + i in at) for i, x in enumerate(m)) for m in decontam.MASKS for s in range(span - len(m) + 1))


def test_leaks(spark):
    rng = random.Random(6)
    items = [prose(rng, n).split() for n in (40, 16, 9, 4)]
    changed = list(items[0])
    for i in (11, 13, 16):
        changed[i] = "other"
    part = items[0][20:33]
    part[4] = part[9] = "other"
    texts = [prose(rng, 60) + " " + " ".join(items[0]) + " end", " ".join(changed[5:21]).upper() + "!", " ".join(w + "," for w in items[1]), prose(rng, 300), " ".join(items[2]), " ".join(items[3]), "", None, "w " * 60_000 + " ".join(items[1]), " ".join(part), " ".join(part[1:])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (None, "x")], "item_id long, text string")
    df = docs(spark, *texts).withColumn("leaked_words", F.lit("clash"))
    want = [[0], [0], [1], [], [2], [3], [], [], [1], [0], []]
    assert [r.leaked_items for r in decontam.find_leaks(df, bench).orderBy("doc_id").collect()] == want
    assert decontam.find_leaks(df, bench, min_words=5).where("doc_id = 5").first().leaked_items == []
    kept = decontam.drop_leaks(with_odd(df.drop("leaked_words")), bench)
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [i for i, w in enumerate(want) if not w] and kept.columns == with_odd(df.drop("leaked_words")).columns and own_odd(kept.collect())
    twice = bench.union(bench.where("item_id = 0")).union(bench.where("item_id = 1").withColumn("item_id", F.lit(0).cast("long")))
    assert [r.leaked_items for r in decontam.find_leaks(df.union(df), twice).orderBy("doc_id").collect()] == [x for w in want for x in [sorted({*w, *([0] if 1 in w else [])})] * 2]
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).where("size(leaked_items) > 0").count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WORDS_A_PASS", 20)
    rng = random.Random(7)
    items = [prose(rng, 20) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = with_odd(docs(spark, " ".join(items[::-1]), items[2], None, "").drop("leaked_items"))
    for rows in (20_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
        got = decontam.find_leaks(df, bench)
        assert [(r.leaked_items, r.leaked_words) for r in got.orderBy("doc_id").collect()] == [([0, 1, 2, 3, 4], 20), ([2], 20), ([], 0), ([], 0)]
        assert own_odd(got.collect(), ("leaked_items", "leaked_words")) and set(got.columns) == set(df.columns)
    assert decontam.drop_leaks(df, bench).count() == 2 and decontam.drop_leaks(df.union(df), bench).count() == 4


# 9 Sharding


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 3000)
    for n in (1, 2, 40, 41):
        assert sharding.jump_buckets(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    a, b = sharding.jump_buckets(keys, 40), sharding.jump_buckets(keys, 41)
    assert set(b[a != b]) == {40} and 0.01 < (a != b).mean() < 0.05


def test_manifest(spark):
    df = docs(spark, *["t" * (i % 7) for i in range(500)], None, "é" * 10).withColumn("shard", F.lit("clash"))
    df = df.union(df.where("doc_id < 3")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard_manifest(df, 40).collect()
    assert len(got) == 502 + 4
    for s in range(40):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    by = {r.doc_id: r for r in got}
    assert (by[500].size, by[500].text_crc32) == (16, None) and by[501].size == 36 and by[501].text_crc32 == zlib.crc32(("é" * 10).encode())
    assert sharding.shard_manifest(df.limit(0), 40).count() == 0
    odd = with_odd(df.drop("shard")).withColumn("grown_shard", F.lit("clash")).withColumn("text", F.when(F.col("doc_id") == 2, F.repeat(F.lit("long "), 90_000)).otherwise(F.col("text")))
    placed = sharding.number_slots(sharding.assign_shards(odd, "doc_id", 40), "doc_id", 40, ["text"])
    rows = placed.collect()
    assert own_odd(rows, ("shard", "slot")) and len({(r.shard, r.slot) for r in rows}) == len(rows) == 506 and placed.columns == [*[c for c in odd.columns if c not in ("shard", "slot", "grown_shard")], "shard", "grown_shard", "slot"][: len(placed.columns)] or set(placed.columns) == set(odd.columns)
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "doc_id", 0)


def test_rows_of_a_hot_key_are_spread_over_the_buckets(spark):
    """A third of the rows without an id: no bucket holds them all, and slots stay gapless."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    plan = sharding.number_slots(sharding.assign_shards(df, "doc_id", 4), "doc_id", 4, ["text"])
    got = plan.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == r.slots == r["last"] + 1 for r in got) and sum(r.n for r in got) == 3000
    order = F.concat_ws("|", F.col("doc_id").cast("string"), "text")
    assert df.where("doc_id is null").select(F.shiftright(sharding.key_hash(order, 16), 46).alias("b")).distinct().count() > 900


def test_shards_round_trip(spark, tmp_path):
    df = docs(spark, *[f"text {i}" for i in range(200)])
    sharding.write_shards(df, "doc_id", 8, str(tmp_path / "out"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"text {i}" for i in range(200))


# 10 Mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["big"] * 30 + ["b", "ça", "Z", None, "tiny"])) for i in range(3000)] + [(5000, None, "empty"), (5001, "", "empty"), (None, "a b", "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df.withColumn("size", F.lit("clash"))).join(df.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in mixing.mix_documents(df).collect():
        assert r.taken <= 3 * r.size and r.source_size in sizes.values()
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 65, s
    again = {r.doc_id: r.taken for r in mixing.mix_documents(df.repartition(7)).collect()}
    assert all(again[r.doc_id] == r.taken for r in got)
    copies = {r.doc_id: r.n for r in mixing.take_mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in got)
    assert mixing.mix_documents(df.limit(0)).count() == 0 and mixing.take_mix(df).columns == df.columns
    odd = mixing.take_mix(with_odd(df)).collect()
    assert own_odd(odd) and len(odd) == sum(copies.values())


def test_mix_of_repeated_rows_and_long_texts(spark):
    """Repeated rows are taken alike, and their words count as often."""
    df = docs(spark, *["w " * (i % 7 + 1) for i in range(300)], "v " * 60_000, source="a").union(docs(spark, *["x " * 3] * 200, source="b"))
    twice = df.union(df)
    got = mixing.mix_documents(twice).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r["size"], r.source_size), []).append(r.taken)
    assert len(got) == 1002 and all(len(set(v)) == 1 and len(v) % 2 == 0 for v in by.values())
    assert {r.source_size for r in got} == {2 * (sum(i % 7 + 1 for i in range(300)) + 60_000), 1200}
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_budgets_are_nested(spark):
    """A larger weight takes a superset."""
    df = docs(spark, *["w " * (i % 9 + 1) for i in range(400)], source="a").union(docs(spark, *["w " * 5] * 400, source="b"))
    few, more = ({r.text + str(r.doc_id) for r in mixing.take_mix(df, weights=w).where("source = 'a'").collect()} for w in ((1, 3), (2, 3)))
    assert few < more


def test_schemas_are_stable(spark):
    """Operators never change the schema of what they are given."""
    df = docs(spark, "a b c d e f g h")
    before = T.StructType.fromJson(df.schema.jsonValue())
    toxicity.score_toxicity(df, None)
    langid.predict_languages(df, None)
    assert df.schema == before
