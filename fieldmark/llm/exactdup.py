"""Exact duplicates by progressive refinement: by length, then by a hash of the beginning, then by a hash of the whole text.

One scan gives each row's length and a hash of its beginning, a few bytes that are written and grouped instead of texts. Lengths of
one row only go first, then beginnings of one row only. A second scan hashes whole texts, but only those whose length and beginning
another row shares; rows left alone earlier are never hashed and never shuffled again. No step moves a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, quoted, settled, small, stash, unused

#: Characters of a text's beginning that are hashed in the second step.
BEGINNING = 64
#: Keys (eight bytes each) up to which the texts to be hashed are chosen by a broadcast; above it every text is hashed where it lies,
#: which costs less than moving texts to their keys.
BROADCAST_KEYS = 1_000_000


def one_space(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _begins(text: Column) -> Column:
    return F.xxhash64(F.octet_length(text), F.substring(text, 1, BEGINNING))


def shared_beginnings(texts: DataFrame, text: str) -> DataFrame:
    """(begins): each hash of length and beginning that several rows of ``texts`` have."""
    sized = stash(texts.select(F.octet_length(text).alias("bytes"), _begins(F.col(text)).alias("begins")))
    lengths = stash(sized.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes"))
    left = sized.join(small(lengths, lengths.count()), "bytes", "left_semi")
    return left.groupBy("begins").agg(F.count("*").alias("n")).where("n > 1").select("begins")


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", same: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its key, ``keep_id`` (the key of the row that stays of those with its text), ``group_size`` (how
    many rows have it), ``kept``, ``whole`` (SHA-256 of the text, null if no other row shares length and beginning) and ``carry``,
    columns of ``docs`` that travel along.

    Texts are equal when ``same``, an expression over ``text``, gives the same for both: by default the text with each run of ASCII
    white space as one space; a null text counts as empty. Of equal texts the row with the smallest key stays; null keys
    come last, and of rows repeated with that key one stays. Groups of any size are combined before they are shuffled. An empty table
    gives no rows; other columns do not matter, whatever their names.
    """
    same = one_space(F.col(quoted(text))) if same is None else same
    named = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)]
    texts = docs.select(F.col(quoted(key)).alias("key"), *named, same.alias("text"))
    keys = settled(lambda: shared_beginnings(texts, "text"))
    if keys.count() <= BROADCAST_KEYS:
        shared = texts.withColumn("begins", _begins(F.col("text"))).join(F.broadcast(keys.withColumn("shared", F.lit(True))), "begins", "left")
    else:
        shared = texts.withColumn("shared", F.lit(True))
    whole = F.when(F.col("shared"), F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("whole")
    hashed = stash(shared.select("key", *[f"c{i}" for i in range(len(carry))], whole, F.monotonically_increasing_id().alias("row")))
    first = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "row")).alias("first")
    groups = stash(hashed.where(F.col("whole").isNotNull()).groupBy("whole").agg(F.count("*").alias("n"), first).where("n > 1"))
    # Rows without a whole hash stay out of the join: all of them would meet in the task of the null key.
    met = hashed.where(F.col("whole").isNotNull()).join(small(groups.select(F.col("whole").alias("w"), "n", "first"), groups.count()), F.col("whole") == F.col("w"), "left")
    alone = hashed.where(F.col("whole").isNull()).withColumns({"n": F.lit(1), "first": F.lit(None).cast(groups.schema["first"].dataType)})
    out = [F.col("key").alias(key), F.when(F.col("first").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("keep_id")]
    out += [F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "whole"]
    out += [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return met.select(*out).unionAll(alone.select(*out))


def drop_exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", same: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as :func:`exact_duplicates` does; columns stay as they are, whatever
    their names. Of rows that repeat one key and text, but differ in other columns, an arbitrary one stays."""
    same = one_space(F.col(quoted(text))) if same is None else same
    mine, whole, first = unused(docs, "mine", "whole", "first")
    judged = stash(exact_duplicates(docs, key=key, text=text, same=same).where("group_size > 1").groupBy(F.col(quoted(key)).alias(mine), F.col("whole").alias(whole)).agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    rows = docs.withColumn(whole, F.unhex(F.sha2(same.cast("binary"), 256)))
    at = F.col(quoted(key)).eqNullSafe(F.col(mine)) & (F.col(f"d.{whole}") == F.col(f"j.{whole}"))
    gone, twice = judged.where("not kept").select(mine, whole), judged.where("kept and n > 1").select(mine, whole)
    kept = rows.alias("d").join(_narrow(gone).alias("j"), at, "left_anti")
    if not twice.limit(1).count():
        return kept.select(*[F.col(quoted(c)) for c in docs.columns])
    one = kept.alias("d").join(_narrow(twice).alias("j"), at, "left_semi").groupBy(F.col(quoted(key)), F.col(whole)).agg(F.first(F.struct(*[F.col(quoted(c)) for c in docs.columns])).alias(first))
    rest = kept.alias("d").join(_narrow(twice).alias("j"), at, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
    return rest.unionAll(one.select(*[F.col(f"{first}.{quoted(c)}") for c in docs.columns]))


def _narrow(keys: DataFrame) -> DataFrame:
    """Keys for a join at the texts' place while they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
