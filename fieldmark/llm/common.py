"""Shared plumbing: scratch tables on shared storage, connected components, broadcast bounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "longs": T.ArrayType(T.LongType())}

#: Rows up to which a side whose rows have a fixed width is broadcast; above it a shuffle join is planned.
BROADCAST_ROWS = 20_000

_own_root: str | None = None
_tables: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one if driver and executors are one
    process (tests); on a cluster, whose executors do not share such a folder, an error."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: scratch tables are written there")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="fieldmark-")
    return _own_root


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to shared storage and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation of what led here.
    The table goes with :func:`drop_stashed`, at the end of a :func:`settled` step, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fieldmark-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        _tables.remove((spark, path))
        try:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # the session may have ended before the process
            pass


def drop_stashed(spark: SparkSession | None = None) -> None:
    """Delete scratch tables written so far by :func:`stash` (of one session, or of all)."""
    _delete([t for t in _tables if spark is None or t[0] is spark])


def settled(make: Callable[[], DataFrame], *spent: DataFrame) -> DataFrame:
    """``make()`` written, after which the scratch tables of its making go, and those of ``spent``: results of this function or of
    :func:`stash` that nothing else will read."""
    before = set(_tables)
    out = make()
    made = [t for t in _tables if t not in before]
    out = stash(out)
    gone = {df._stashed for df in spent}
    _delete(made + [t for t in _tables if t[1] in gone])
    return out


atexit.register(drop_stashed)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the Arrow batches of its session to 2,000 rows where the user has set nothing: texts are long, and a
    batch is held by the JVM and by Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in conf.getAll:
        conf.set(key, "2000")
    return df


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """A narrow map of Arrow batches: ``make`` gives the columns ``fields`` of each batch of ``df``. Columns travel by place, so
    their names may hold any characters."""
    plain, names = text_batches(df).toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch), names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    return plain.mapInArrow(run, schema).toDF(*[f.name for f in fields])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, is within the bound; else unmarked."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (case-insensitive, like the session)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def fields_with(df: DataFrame, **added: str) -> list[T.StructField]:
    """The columns of ``df`` and further ones."""
    return [*df.schema.fields, *[T.StructField(k, _TYPES[v]) for k, v in added.items()]]


def quoted(name: str) -> str:
    """A column's name for an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def _are_stars(links: DataFrame) -> bool:
    """Whether each node of ``links(a, b)`` either leads to one other, or is led to."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("leads"), F.lit(0).alias("led")).union(links.select("b", F.lit(0), F.lit(1)))
    both = ends.groupBy("id").agg(F.sum("leads").alias("leads"), F.max("led").alias("led"))
    return not both.where("leads > 1 or leads = 1 and led = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(id, comp)`` per node, ``comp`` its smallest reachable id.

    Large and small stars in turn (Kiveris et al., 2014). Edges lead from a node to a smaller one. A large star leads the nodes of
    each node on to the smallest node it knows; a small star joins what each node leads to. Either only rewrites edges, so it never
    makes more of them than there are edges and nodes; when all that is left is stars, each is around the smallest node of its
    component. A chain of a thousand nodes takes some ten rounds. Each step is an equi-join whose other side has one row a node, so a
    hub's edges are split by Spark's skew-join handling and never gathered, and a ``min`` that combines before the shuffle.
    """
    links = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(links):
        least = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = stash(links.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        own, other = F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        pair = F.explode(F.when(F.col("b") == F.col("m"), F.array(own)).otherwise(F.array(own, other))).alias("e")
        joined = large.join(least, "a").select(pair).select("e.a", "e.b")
        links = settled(joined.distinct, links, large)
    return links.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(links.select("b", "b").distinct())
