"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word budget. Documents are ordered by a hash of their id, and a source takes those below a hash threshold;
a larger budget only raises the threshold, so budgets are nested. The threshold is found from histograms of words by hash
bucket: only the bucket in which the budget runs out is looked into again, twelve bits finer each time. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import quoted, small, stash, unused
from .sharding import key_hash

BITS, LEVELS = 12, 5  # 60 hash bits in all


def word_count(text: str) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, the place of each row by ``source`` (by code point, null last) from 0. Sources are dealt by ranges and
    numbered within them, so of any number of sources no task holds all; only the ranges are counted in one."""
    at = F.col("source").asc_nulls_last()
    placed = stash(sizes.repartitionByRange(at).sortWithinPartitions(at).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + within).drop("at", "part", "start")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: shares of the sum by weight, none above ``cap`` times its source's size.

    Weights go round over the sources by code point, null last. What a cap cuts off is shared again by weight among the rest
    until none is above, which is: the smallest common level L with sum(min(cap*size, weight*L)) = total. Each round is one aggregation:
    the level if those that it caps are capped, which only rises, until it caps no more. As the sum is concave in L this is Newton's
    method, and takes a few rounds whatever the number of sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = stash(ranked(sizes).select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    total, level, capped_before = s.agg(F.sum("source_size").cast("double")).first()[0] or 0.0, 0.0, -1
    while True:
        above = F.col("w") * F.lit(level) > F.col("most")
        r = s.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w"))), F.count_if(above)).first()
        # All capped: every target is its cap.
        if not r[1] or r[2] == capped_before:
            break
        capped_before, level = r[2], (total - r[0]) / r[1]
    target = F.least("most", F.col("w") * F.lit(level)) if r[1] else F.col("most")
    return s.select("source", "source_size", target.alias("target"))


def mix_limits(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> tuple[DataFrame, int]:
    """The plan of a mix of ``docs(source, size, h)``: one row for each source, and how many there are.

    Columns: source, source_size, target, whole (copies of every document), last (one more of those whose hash is not above it).
    """
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stash(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n = targets.count()
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    edge = targets.select("source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("g"))
    for level in range(1, LEVELS + 1):
        inside = F.shiftright("d.h", 60 - BITS * (level - 1)) == F.col("t.bucket")
        bucket = F.shiftright("d.h", 60 - BITS * level).alias("bucket")
        hist = docs.alias("d").join(small(edge, n).alias("t"), same & inside).groupBy("t.source", "t.rest", "t.base", bucket).agg(F.sum("d.size").alias("g"))
        upto = F.col("base") + F.sum("g").over(W.partitionBy("source").orderBy("bucket"))
        found = F.min(F.struct("bucket", "rest", (F.col("upto") - F.col("g")).alias("base"), "g")).alias("e")
        edge = hist.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(found).select("source", "e.rest", "e.bucket", "e.base", "e.g")
    # After the last level a bucket is one hash: its documents are taken if the budget is missed by less with them.
    last = F.when(2 * F.col("base") + F.col("g") <= 2 * F.col("rest"), F.col("bucket")).otherwise(F.col("bucket") - 1).alias("last")
    found = small(edge.select("source", last), n).alias("d")
    return targets.alias("t").join(found, same, "left").select("t.source", "t.source_size", "t.target", "t.whole", F.coalesce("d.last", F.lit(-1)).alias("last")), n


def _with_copies(docs: DataFrame, limits: DataFrame, n: int, h: str, name: str, *columns: Column) -> DataFrame:
    copies = (F.col("t.whole") + (F.col(f"d.{h}") <= F.col("t.last")).cast("long")).alias(name)
    return docs.alias("d").join(small(limits, n).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(*columns, copies)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """For each row of ``docs(doc_id, source, text)``: doc_id, size (words), source_size, target, taken.

    ``taken`` is size times the copies the mix takes: floor(target / source_size) of every document of its source, and one more
    of those below the source's threshold. A source's sum misses its target by half of one document at most, documents of one id
    counting as one. Null texts have size 0; a null source is a source; null ids share one hash; empty tables give no rows.
    """
    digest = stash(docs.select("doc_id", "source", word_count("text").alias("size"), key_hash(F.col("doc_id")).alias("h")))
    limits, n = mix_limits(digest, **options)
    rows = _with_copies(digest, limits, n, "h", "copies", F.col("d.doc_id"), F.col("d.size"), F.col("t.source_size"), F.col("t.target"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it (not at all, or up to ``cap`` times).

    Texts are not shuffled: they meet the thresholds, one row for each source, where they are.
    """
    h = key_hash(F.col("doc_id"))
    limits, n = mix_limits(stash(docs.select("source", word_count("text").alias("size"), h.alias("h"))), **options)
    hash_, copies, copy = unused(docs, "h", "copies", "copy")
    rows = _with_copies(docs.withColumn(hash_, h), limits, n, hash_, copies, *[F.col(f"d.{quoted(c)}") for c in docs.columns])
    return rows.where(F.col(copies) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[F.col(quoted(c)) for c in docs.columns])
