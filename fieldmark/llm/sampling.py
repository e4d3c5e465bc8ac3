"""Bounded samples of labelled rows, for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import small

_PARTS = 1 << 20


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _hash(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(_PARTS))


def stratified(rows: DataFrame, key: str, label: str, counts: dict, each: dict) -> DataFrame:
    """About ``each[value]`` of the ``counts[value]`` rows of each label value, chosen by a hash of the key: a join with the shares, of which
    there is a row for each value, and a filter; no sort and no shuffle.

    Rows of other values, or of none, are left out. The hash picks the same rows in any order and partitioning.
    """
    shares = [(value, float(_PARTS * min(1.0, n / max(1, counts.get(value, 0))))) for value, n in sorted(each.items(), key=lambda x: str(x[0]))]
    table = rows.sparkSession.createDataFrame(shares, f"__label {rows.schema[label].dataType.simpleString()}, __share double")
    met = rows.join(small(table, len(shares)), F.col(label) == F.col("__label"))
    return met.where(_hash(key) < F.col("__share")).select(*[F.col(c) for c in rows.columns])


def smallest_hashes(rows: DataFrame, key: str, label: str, counts: dict, n: int) -> DataFrame:
    """The ``n`` rows of each label value whose keys' hashes are the smallest, of values that have as many: a generous share is drawn
    first, so that few rows meet in a task. One row of each key and value, that with the smallest hash of all columns."""
    drawn = stratified(rows, key, label, counts, dict.fromkeys(counts, 4 * n + 64))
    fields = [F.col(c) for c in rows.columns]
    one = drawn.groupBy(key, label).agg(F.min(F.struct(F.xxhash64(*rows.columns).alias("__by"), *[f for f, c in zip(fields, rows.columns, strict=True) if c not in (key, label)])).alias("r")).select(key, label, "r.*").drop("__by")
    place = F.row_number().over(W.partitionBy(label).orderBy(_hash(key), key))
    return one.withColumn("__place", place).where(F.col("__place") <= n).select(*rows.columns)


def one_row(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """One of the rows of each key: that with the smallest hash of ``by``, then of the smallest values; the same in any order and
    partitioning. Combined before the shuffle, so a frequent key is not gathered."""
    fields = [F.col(c) for c in rows.columns]
    return rows.groupBy(key).agg(F.min(F.struct(F.xxhash64(*by).alias("__by"), *[f for f, c in zip(fields, rows.columns, strict=True) if c != key])).alias("r")).select(key, "r.*").drop("__by")
