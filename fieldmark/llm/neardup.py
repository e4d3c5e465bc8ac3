"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives 63 MinHash values of eight bits, in nine chunks of seven. Two signatures that differ in
at most 17 positions have, by pigeonhole, a chunk with at most one difference; so each chunk is indexed with every one of its
positions ignored in turn, and all such pairs share a key. (Of pairs at Jaccard 0.8 exactly, whose signatures differ in 12.5
positions on average, all but 4 in 10,000 share a key, as nine chunks would each have to differ twice.)

Groups may be huge, so pairs within a key are not listed. Each document is first compared with one hub: among its keys' members,
the one with the most company, and of those alike in that the one whose shingles are the most common. Links confirmed on the full sets give components. Documents that share a key with another
component's are then compared across components: of the pairs that share a key, those whose signatures are near enough are
confirmed likewise, and only those are made that meet at their rarest shingles, as any linked pair must. What is left out is only
pairs already in one component, so components are those of all links among the pairs that share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import components, settled, stash, text_batches, unused
from .textkit import mix64, run_hashes, text_blocks, word_hashes

CHUNKS, WIDTH = 9, 7
SYMBOLS = CHUNKS * WIDTH
#: Ids up to which a semi-join's side is broadcast (8 bytes each); above it, both sides are shuffled.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(column: pa.Array, ngram: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``ngram``-word shingles; fewer words are one shingle, none are none."""
    for lo, hi, raw, offsets in text_blocks(column):
        words, first = word_hashes(raw, offsets)
        runs = run_hashes(words, ngram)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= ngram:
                yield np.unique(runs[a : b - ngram + 1])
            elif b > a:
                yield run_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Chunks (rows of ``CHUNKS`` integers of seven bytes) of the signatures of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), CHUNKS), np.uint64)
    for k in range(SYMBOLS):
        low = mix64(np.minimum.reduceat(flat * _MUL[k] + _ADD[k], at)) & np.uint64(0xFF)
        out[:, k // WIDTH] |= low << np.uint64(8 * (k % WIDTH))
    return out


_SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, " + ", ".join(f"c{i} long" for i in range(CHUNKS))
_C = [f"c{i}" for i in range(CHUNKS)]


def set_hashes(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit hashes of a set of shingles."""
    return s.sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()


def _sign(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sizes, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            chunks = np.zeros((n, CHUNKS), np.uint64)
            held, rows, total = [], [], 0
            for i, s in enumerate(shingle_sets(batch.column(2), ngram)):
                if len(s):
                    sizes[i] = len(s)
                    h1[i], h2[i] = set_hashes(s)
                    held.append(s)
                    rows.append(i)
                    total += len(s)
                if held and (total > 200_000 or i == n - 1):
                    chunks[rows] = signature(held)
                    held, rows, total = [], [], 0
            if held:
                chunks[rows] = signature(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *[pa.array(chunks[:, j].astype(np.int64)) for j in range(CHUNKS)]], ["doc_id", "text_hash", "n_shingles", "h1", "h2", *_C])

    return run


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, hashes, at = [], [], 0
            for i, s in enumerate(shingle_sets(batch.column(2), ngram)):
                held.append(s.view(np.int64))
                hashes.append(set_hashes(s))
                if i - at == 255 or i == len(batch) - 1:
                    offsets = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
                    h1, h2 = np.array(hashes, np.uint64).view(np.int64).T
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))], ["doc", "h1", "h2", "shingles"])
                    held, hashes, at = [], [], i + 1

    return run


def _keys() -> Column:
    """The index keys of a signature: chunk and ignored position above, the other six positions below."""
    keys = []
    for j in range(CHUNKS):
        for p in range(WIDTH):
            keys.append(F.col(f"c{j}").bitwiseAND(F.lit(((1 << 56) - 1) & ~(0xFF << 8 * p))).bitwiseOR(F.lit((j * WIDTH + p) << 56)))
    return F.array(*keys)


def _differing(a: Column, b: Column) -> Column:
    """Positions, of a chunk's seven, in which two chunks differ."""
    x = a.bitwiseXOR(b)
    for n in (1, 2, 4):
        x = x.bitwiseOR(F.shiftright(x, n))
    return F.bit_count(x.bitwiseAND(F.lit(0x01010101010101)))


def _distance(a: str, b: str) -> Column:
    return reduce(add, [_differing(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in _C])


def _share_a_key(a: str, b: str) -> Column:
    """Whether some chunk differs in one position at most."""
    return F.least(*[_differing(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in _C]) <= 1


def pick_rows(docs: DataFrame, ids: DataFrame, on: Column, how: str) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) a row of ``ids``; texts stay where they are if ids are few
    enough to broadcast."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


class NearDuplicates:
    """The links and components of ``docs(doc_id, text)``.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the distinct ``ngram``-word shingles, or the
    whole sequence if there are fewer words. Documents are linked if 100 * intersection >= ``percent`` * union. Texts that are
    null, empty or blank are linked with nothing. Repeated rows are one document; of rows with one doc_id and several texts each
    is compared by its own text and gets the component of that. Rows without a doc_id are left as they are.
    """

    def __init__(self, docs: DataFrame, *, ngram: int = 5, percent: int = 80) -> None:
        self.ngram, self.percent = ngram, percent
        self.docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        share = percent / 100
        #: Signature distance above which no pair is confirmed: five deviations beyond that of a pair at the limit.
        self.most_apart = ceil(SYMBOLS * (1 - share) + 5 * sqrt(SYMBOLS * share * (1 - share)))
        self.signed = stash(self.docs.mapInArrow(_sign(ngram), _SIGNED))
        firsts = [F.first(c).alias(c) for c in _C]
        # One node for each distinct set; exact copies end here, combined before the shuffle. Nodes go by their smallest doc_id, and
        # by number in that order only where one doc_id has several texts and may stand for several nodes.
        sets = self.signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc"), *firsts)
        self.classes = stash(sets.withColumn("id", F.col("doc")))
        if self.classes.groupBy("doc").count().where("count > 1").limit(1).count():
            self.classes = settled(lambda classes=self.classes: classes.repartitionByRange("doc", "h1").sortWithinPartitions("doc", "h1").withColumn("id", F.monotonically_increasing_id()), self.classes)

    def shared_keys(self) -> DataFrame:
        """(key, id, company, typical): each class under each key that it shares, in how many pairs its keys hold it, and, of classes
        whose signatures are the same, how common its shingles are among them."""
        keyed = self.classes.select("id", F.explode(_keys()).alias("key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        entries = stash(keyed.join(shared, "key"))
        company = stash(entries.groupBy("id").agg(F.sum("n").alias("company")))
        known = company.join(self.typical(company), "id", "left").withColumn("typical", F.coalesce("typical", F.lit(0.0)))
        return stash(entries.drop("n").join(stash(known), "id").select("key", "id", "company", "typical"))

    def typical(self, company: DataFrame) -> DataFrame:
        """(id, typical): of the classes in large groups whose whole signatures are those of others, in how many of these each shingle of
        theirs stands, on average.

        Such classes have equal company, but only one may be the text that the others were copied from: it has none of their changes, so its
        shingles are the most common. As the hub it is linked with more of them than a copy would be. This decides which
        pairs are compared first, never which are linked.
        """
        alike = self.classes.groupBy(F.xxhash64(*_C).alias("whole")).agg(F.count("*").alias("n")).where("n > 1").select("whole")
        large = company.where(F.col("company") > 4 * SYMBOLS).select("id")
        tied = stash(self.classes.select("id", F.xxhash64(*_C).alias("whole")).join(alike, "whole", "left_semi").join(large, "id", "left_semi").select("id"))
        shingles = stash(self.sets(tied).select("id", F.explode("shingles").alias("token")))
        often = stash(shingles.groupBy("token").agg(F.count("*").alias("often")))
        return shingles.join(often, "token").groupBy("id").agg(F.avg("often").alias("typical"))

    def signed_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b, ...)`` that share a key and whose signatures are near enough."""
        sig = self.classes.select("id", "n_shingles", *_C)
        both = pairs.join(sig.alias("x"), F.col("a") == F.col("x.id")).join(sig.alias("y"), F.col("b") == F.col("y.id"))
        sizes = 100 * F.least("x.n_shingles", "y.n_shingles") >= self.percent * F.greatest("x.n_shingles", "y.n_shingles")
        return both.where(sizes & _share_a_key("x", "y") & (_distance("x", "y") <= self.most_apart)).select(*pairs.columns)

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the classes in ``ids(id)``, from the text of a document of each."""
        wanted = stash(self.classes.join(ids.distinct(), "id", "left_semi").select("id", "doc", "h1", "h2"))
        docs = wanted.select(F.col("doc").alias("__doc")).distinct()
        rows = pick_rows(self.docs, docs, F.col("doc_id") == F.col("__doc"), "left_semi").mapInArrow(_sets(self.ngram), "doc long, h1 long, h2 long, shingles array<long>")
        return rows.groupBy("doc", "h1", "h2").agg(F.first("shingles").alias("shingles")).join(wanted, ["doc", "h1", "h2"]).select("id", "shingles")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that are linked, by their full sets."""
        pairs = stash(pairs.select("a", "b"))
        # Written, so that both joins have plain exchanges on both sides: a hub's many pairs can then be split.
        sets = stash(self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return stash(both.where(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b"))

    def hub_pairs(self, entries: DataFrame) -> DataFrame:
        """Each document with the hub that has the most company among the hubs of its keys; of equal ones, the most typical."""
        hubs = entries.groupBy("key").agg(F.max(F.struct("company", "typical", (-F.col("id")).alias("minus"))).alias("hub"))
        weight = F.struct("hub.company", "hub.typical").alias("w")
        near = entries.join(hubs, "key").where(F.col("id") != -F.col("hub.minus")).select("id", weight, (-F.col("hub.minus")).alias("hub")).distinct()
        good = self.signed_pairs(near.select(F.col("id").alias("a"), F.col("hub").alias("b"), "w"))
        return good.groupBy("a").agg(F.max(F.struct("w", (-F.col("b")).alias("minus"))).alias("best")).select("a", (-F.col("best.minus")).alias("b"))

    def rare_shingles(self, ids: DataFrame) -> DataFrame:
        """(token, id, n, at): each document's rarest shingles, those in which any pair that could be linked must meet.

        Rarity is among the documents in ``ids(id)``; ``at`` is a shingle's place in its document's set of ``n``, rarest first.
        """
        shingles = self.sets(ids).select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
        often = shingles.groupBy("token").agg(F.count("*").alias("often"))
        place = F.row_number().over(W.partitionBy("id").orderBy("often", "token")) - 1
        near = shingles.join(often, "token").withColumn("at", place)
        return near.where((F.col("often") > 1) & (100 * (F.col("n") - F.col("at")) >= self.percent * F.col("n"))).select("token", "id", "n", "at")

    def open_pairs(self, entries: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of documents that share keys with others of another component, and could be linked; each once.

        In a large group the members of its largest component are done with each other; what remains are copies changed too much
        to be linked with its hub, which share keys with nearly all. Their own changes are their rarest shingles, so ordered by
        rarity almost no pair of them meets early enough for the rest of both sets to make a link.
        """
        held = stash(entries.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
        mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        held = stash(held.join(mixed, "key").select("id", "comp").distinct())
        held = stash(self.rare_shingles(held.select("id")).join(held, "id"))
        largest = held.groupBy("token", "comp").agg(F.count("*").alias("rows")).groupBy("token").agg(F.max(F.struct("rows", "comp"))["comp"].alias("most"))
        # Written, so that the joins below have plain exchanges on both sides, whose hot tokens Spark can split.
        held = stash(held.join(stash(largest), "token"))
        few = held.where("comp <> most")
        once = (F.col("y.comp") == F.col("y.most")) | (F.col("x.id") < F.col("y.id"))
        rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
        enough = rest * (100 + self.percent) >= self.percent * (F.col("x.n") + F.col("y.n"))
        found = few.alias("x").join(held.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & once & enough)
        return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def labels(self) -> DataFrame:
        """(id, doc) for every class that is linked with another: the smallest doc_id of its component."""
        entries = self.shared_keys()
        links = self.confirm(self.hub_pairs(entries))
        labels = components(links)
        more = self.confirm(self.signed_pairs(self.open_pairs(entries, labels)))
        found = components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more)).join(self.classes.select("id", "doc"), "id")
        return found.select("id", "comp").join(found.groupBy("comp").agg(F.min("doc").alias("doc")), "comp").select("id", "doc")

    def judged(self) -> DataFrame:
        """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept."""
        labels = settled(self.labels)
        named = self.classes.select("h1", "h2", F.col("n_shingles").alias("n"), "id", F.col("doc").alias("own")).join(labels, "id", "left").select("h1", "h2", "n", F.coalesce("doc", "own").alias("comp"))
        same = (F.col("s.h1") == F.col("c.h1")) & (F.col("s.h2") == F.col("c.h2")) & (F.col("s.n_shingles") == F.col("c.n")) & F.col("s.doc_id").isNotNull()
        comp = F.coalesce("c.comp", "s.doc_id")
        kept = F.coalesce(F.col("s.doc_id") == comp, F.lit(True))
        return self.signed.alias("s").join(named.alias("c"), same, "left").select("s.doc_id", "s.text_hash", "s.n_shingles", comp.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, *, ngram: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept
    (whether that is its own). See :class:`NearDuplicates`; other columns of ``docs`` do not matter."""
    return NearDuplicates(docs, ngram=ngram, percent=percent).judged().drop("text_hash")


def drop_near_duplicates(docs: DataFrame, *, ngram: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id (repeated rows of it all stay). Columns stay as
    they are, whatever their names."""
    judged = NearDuplicates(docs, ngram=ngram, percent=percent).judged()
    doc, text = unused(docs, "doc", "text_hash")
    gone = stash(judged.where("not kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct())
    return pick_rows(docs, gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")
