"""Keyed collections and append-only trails on Parquet. A collection's rows lie in partitions by a hash of their key, as many as its size
asks for; a change replaces the partitions that it touches by Spark's dynamic partition overwrite, and reads no others."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .scratch import exists, hadoop_path


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """One of the rows of each key: the last by updated_at, then version (as a number, then as text), as far as there are such columns, then
    that of the largest hash. The same one in any order and partitioning; combined before the shuffle, so a frequent key is not gathered."""
    has, version = set(rows.columns), F.col("version").cast("string")
    order = [F.col("updated_at")] if "updated_at" in has else []
    order += [F.try_to_number(version, F.lit("999999999999999999")), version] if "version" in has else []
    every = [F.col(c) for c in rows.columns]
    last = F.max(F.struct(F.struct(*order, F.xxhash64(*every)).alias("order"), F.struct(*every).alias("row")))
    return rows.groupBy(F.col(key).alias("__key")).agg(last.alias("last")).select("last.row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; of new rows with one key the newest stays (:func:`newest`)."""
    new = newest(new, key)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(old: DataFrame, new: DataFrame, key: str = "document_id", *, documents: DataFrame | None = None) -> DataFrame:
    """``old`` with all rows of each document in ``new`` replaced by its rows there. ``documents(key)``: the documents that have rows in
    ``new``, if they are known without making these rows once more."""
    # By another name, so that Spark can drop a document before its rows are made.
    gone = (new if documents is None else documents).select(F.col(key).alias("__gone")).distinct()
    return old.join(gone, F.col(key) == F.col("__gone"), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    return old.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(old: DataFrame, ids: list[str] | DataFrame, key: str = "id") -> DataFrame:
    """``old`` without the rows of the ids, of which there must be some if they are listed."""
    if isinstance(ids, DataFrame):
        return old.join(ids.select(key).distinct(), key, "left_anti")
    if not ids:
        raise ValueError("ids must not be empty")
    return old.where(~F.coalesce(F.col(key).isin(*ids), F.lit(False)))


def scroll(rows: DataFrame, where: Column | None = None, *, limit: int = 50, vectors: bool = False) -> DataFrame:
    """The first rows by id that pass a filter; vectors are only read if asked for."""
    rows = rows.where(where) if where is not None else rows
    return (rows if vectors else rows.drop("embedding")).orderBy("id").limit(limit)


def list_memories(rows: DataFrame, *, limit: int = 50, **equal: str) -> DataFrame:
    """The newest memories that have the values given."""
    if unknown := set(equal) - {"asset_id", "lifecycle_status", "jev_status", "memory_type"}:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows.orderBy(F.desc("updated_at"), "memory_id").limit(limit)


class Collection:
    """A table of one schema under ``root/name``, with one writer at a time.

    Rows lie under ``parts=N/part=k``, k a hash of the key. N is a power of two; once partitions have four times ``part_bytes`` bytes on average
    it doubles until they have fewer than that, and the rows move to a folder of their own, which counts once it is whole. Files are sorted by ``sorted_by`` and have
    Bloom filters on these columns and the key, so a scan for one value reads few pages. A partition that is rewritten also gets a row
    without a key, which readers leave out: so one that loses its last row is overwritten too. Partitions are replaced one by one at the
    end of a job: a change that is lost half-way is made whole by making it again.

    ``check`` is applied to rows before they are written (:func:`fieldmark.operators.validate.insist`, say). A row without a key is an error.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType, key: str, *, part_bytes: int = 128 << 20, parts: int = 8, sorted_by: tuple[str, ...] = (), page_rows: int = 20_000, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.schema, self.key, self.check = spark, schema, key, check
        self.part_bytes, self.first_parts, self.sorted_by, self.page_rows = part_bytes, parts, sorted_by, page_rows
        self.path = f"{root.rstrip('/')}/{name}"
        self._stored = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField("part", T.IntegerType())])

    def parts(self) -> int:
        """How many partitions there are; 0 before the first write."""
        found, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(found):
            return 0
        numbers = [int(s.getPath().getName().removeprefix("parts=")) for s in fs.listStatus(found) if s.getPath().getName().startswith("parts=")]
        # A folder that rows moved to counts once it is whole; the first one was never moved to.
        return max((n for n in numbers if exists(self.spark, f"{self._folder(n)}/_SUCCESS")), default=min(numbers, default=0))

    def _folder(self, n: int) -> str:
        return f"{self.path}/parts={n}"

    def _part(self, key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _rows(self, n: int, touched: list[int] | None = None) -> DataFrame:
        if not n:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._stored).parquet(self._folder(n))
        rows = rows.where(F.col("part").isin(touched)) if touched is not None else rows
        return rows.where(F.col(self.key).isNotNull()).select(*self.schema.names)

    def _touched(self, keys: DataFrame, n: int) -> list[int]:
        """The partitions of ``keys``: at most as many numbers as there are partitions."""
        return sorted(r[0] for r in keys.select(self._part(F.col(self.key), n).alias("part")).distinct().collect())

    def _write(self, rows: DataFrame, n: int, touched: list[int], folder: str, **options: str) -> None:
        marks = self.spark.createDataFrame([(p,) for p in touched], "part int")
        own = rows.select(*self.schema.names).withColumn("part", self._part(F.col(self.key), n)).unionByName(marks, allowMissingColumns=True)
        writer = own.repartition("part").sortWithinPartitions("part", *self.sorted_by, self.key).write.mode("overwrite").partitionBy("part").options(**options)
        writer = writer.option("parquet.page.row.count.limit", str(self.page_rows))
        for c in {*self.sorted_by, self.key}:
            # A filter for about as many values as a partition may have rows; the default is a megabyte a column.
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(max(64, self.part_bytes // 512)))
        writer.parquet(folder)

    def _replace(self, rows: DataFrame, n: int, touched: list[int]) -> None:
        """``rows`` in place of those of the partitions touched, and more partitions if these have grown too large."""
        self._write(rows, n, touched, self._folder(n), partitionOverwriteMode="dynamic")
        found, fs = hadoop_path(self.spark, self._folder(n))
        held, more = fs.getContentSummary(found).getLength(), n
        # Well above the aim before anything moves: more files also have more of what every file has.
        while held > 4 * n * self.part_bytes and held > more * self.part_bytes:
            more *= 2
        if more > n:
            self._write(self._rows(n), more, [], self._folder(more))
            fs.delete(found, True)

    def _checked(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.schema.names)
        keyed = F.when(F.col(self.key).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row without {self.key}")).cast("boolean"))
        return (self.check(rows) if self.check else rows).where(keyed)

    def read(self) -> DataFrame:
        """The current rows; none if nothing was written."""
        return self._rows(self.parts())

    def put(self, rows: DataFrame) -> None:
        """Rows in place of those with their keys; of several with one key the newest (:func:`newest`)."""
        held, rows = self.parts(), newest(self._checked(rows), self.key).persist()
        n = held or self.first_parts
        try:
            if touched := self._touched(rows, n):
                kept = self._rows(n, touched).join(rows.select(self.key), self.key, "left_anti") if held else self._rows(0)
                self._replace(kept.unionByName(rows), n, touched)
        finally:
            rows.unpersist()

    def replace(self, rows: DataFrame, by: str, values: DataFrame | None = None) -> None:
        """Rows in place of all that have a value of theirs, or of ``values(by)``, in ``by``: chunks of documents, say, of which some may have
        none any more."""
        n = self.parts() or self.first_parts
        rows, held = newest(self._checked(rows), self.key).persist(), self.read()
        try:
            values = (values if values is not None else rows).select(by).distinct()
            if touched := sorted({*self._touched(held.join(values, by, "left_semi"), n), *self._touched(rows, n)}):
                kept = self._rows(n if self.parts() else 0, touched).join(values, by, "left_anti")
                self._replace(kept.unionByName(rows), n, touched)
        finally:
            rows.unpersist()

    def delete(self, ids: list[str] | DataFrame) -> bool:
        """Drop the rows of the ids; whether there were any."""
        if not isinstance(ids, DataFrame):
            if not ids:
                raise ValueError("ids must not be empty")
            ids = self.spark.createDataFrame([(i,) for i in ids], T.StructType([self.schema[self.key]]))
        n = self.parts()
        touched = self._touched(self.pick(ids), n) if n else []
        if touched:
            self._replace(delete_ids(self._rows(n, touched), ids, self.key), n, touched)
        return bool(touched)

    def pick(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, from their partitions alone."""
        n = self.parts()
        if not n:
            return self._rows(0)
        return self._rows(n, self._touched(keys, n)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def get(self, id: str) -> DataFrame:
        """The row of an id; only its partition is read."""
        n = self.parts()
        if not n:
            return self._rows(0)
        part = self.spark.range(1).select(self._part(F.lit(id).cast(self.schema[self.key].dataType), n)).first()[0]
        return self._rows(n, [part]).where(F.col(self.key) == id)


class Trail:
    """An append-only table under ``root/name``: one folder a batch, and nothing ever read or rewritten to append.

    A batch that is given again adds what it did not add before: rows are told by their key, within the batch's own folder.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType, key: str, *, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.schema, self.key, self.check = spark, schema, key, check
        self.path = f"{root.rstrip('/')}/{name}"

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={''.join(c if c.isalnum() or c in '-.' else '_' for c in batch)}"

    def append(self, rows: DataFrame, batch: str) -> None:
        rows, folder = rows.select(*self.schema.names), self._folder(batch)
        rows = self.check(rows) if self.check else rows
        if exists(self.spark, folder):
            rows = rows.join(self.spark.read.schema(self.schema).parquet(folder).select(self.key), self.key, "left_anti").select(*self.schema.names)
        if not rows.isEmpty():
            rows.write.mode("append").parquet(folder)

    def read(self) -> DataFrame:
        """All rows; none if nothing was appended."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])).parquet(self.path).drop("batch")
