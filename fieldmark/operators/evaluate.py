"""Evaluation: the context of a candidate, its prompt, the model's answer and the verdict record."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import exact_terms
from ..functions.verdicts import coerce, generate_with, json_object_exact, judge_prompt
from .nearest import asked_once, closest, first_copies
from .products import KEYS, PRODUCTS
from .retrieval import retrieve

if TYPE_CHECKING:
    from .term_index import TermIndex
    from .vector_index import VectorIndex

OBSERVATIONS, DOCUMENTS, HISTORY = 6, 6, 4
DOCUMENT = ("id", "source", "content")
#: Candidates of an asset that are shown its texts side by side, and how often each text is copied for that at most; beyond, it goes to each that found it.
SIDE_BY_SIDE, COPIES = 8192, 3


def fleet_neighbours(candidates: DataFrame, fleet: DataFrame, *, k: int = OBSERVATIONS, index: VectorIndex | None = None, exact: bool = True, copies: DataFrame | None = None) -> DataFrame:
    """(candidate_id, memory_id, similarity, position): the ``k`` memories of ``fleet(memory_id, embedding)`` most similar to each of
    ``candidates(memory_id, embedding)``, itself left out before ranking. With an ``index`` of the fleet only its lists are compared with;
    it may hold but one memory of each vector, if ``copies(stands_for, memory_id)`` has the first ``k`` + 1 of its vector for each of these, itself included."""
    c, members = asked_once(candidates.select(F.col("memory_id").alias("candidate_id"), F.col("embedding").alias("__v")), id="candidate_id")
    # One more than wanted, for a candidate may be among its own nearest. Candidates and memories of one vector are compared once.
    if index is not None:
        found = index.search(c, k=k + 1, exact=exact)
    else:
        rows = first_copies(fleet.select("memory_id", F.col("embedding").alias("__e")), by=["__e"], id="memory_id", k=k + 1)
        found = closest(c, rows, id="memory_id", k=k + 1)
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("similarity"), "memory_id"))
    if copies is not None:
        found = found.withColumnRenamed("memory_id", "stands_for").join(copies, "stands_for").select("candidate_id", "memory_id", "similarity").withColumn("position", place).where(F.col("position") <= k + 1)
    others = members.join(found.drop("position").withColumnRenamed("candidate_id", "__as"), "__as").where("memory_id <> candidate_id")
    return others.select("candidate_id", "memory_id", "similarity").withColumn("position", place).where(F.col("position") <= k)


def asset_documents(candidates: DataFrame, chunks: DataFrame, *, k: int = DOCUMENTS, index: VectorIndex | None = None, exact: bool = True, vectors: DataFrame | None = None, terms: TermIndex | None = None, content: bool = True) -> DataFrame:
    """(candidate_id, id, source, content if wanted, score, position): the authoritative chunks that the hybrid query finds for each candidate's
    content within its asset (without one: in all), best first. ``index``: a vector index of the chunks, with asset_id and jev_status; ``vectors``: as for
    :func:`fieldmark.operators.retrieval.retrieve`. Texts join what each candidate found, at the end."""
    asked = candidates.select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("vector"), exact_terms(F.col("content")).alias("terms"), F.col("asset_id").alias("scope"))
    asked, members = asked_once(asked, id="query_id")
    found = retrieve(asked, chunks, where=F.col("jev_status") == "not_applicable", limit=k, scoped=True, index=index, exact=exact, vectors=vectors, terms=terms, content=False)
    found = members.join(found.withColumnRenamed("query_id", "__as"), "__as").select(F.col("query_id").alias("candidate_id"), "id", "source", "score", "position")
    return found.join(chunks.select("id", "content"), "id").select("candidate_id", "id", "source", "content", "score", "position") if content else found


_VERDICT = ("verdict_id", "memory_id", "verdict", "rationale")


def verdict_history(candidates: DataFrame, verdicts: DataFrame, memories: DataFrame, *, k: int = HISTORY, as_of: str | None = None) -> DataFrame:
    """(candidate_id, verdict_id, memory_id, verdict, rationale, position): the ``k`` newest verdicts on memories of each candidate's
    asset, newest first, those on the candidate itself left out after the limit. Verdicts have no asset; their memories do. A memory may have
    several; of those given at one time the smallest memory_id, then verdict_id, comes first.

    ``as_of`` names a time of the candidates: then only verdicts given by that time count (:func:`history_as_of`).
    """
    placed = verdicts.select(*_VERDICT, "evaluated_at").join(memories.select("memory_id", "asset_id"), "memory_id")
    if as_of is None:
        # The newest of an asset serve all its candidates, so only those travel to the join.
        place = F.row_number().over(W.partitionBy("asset_id").orderBy(F.desc("evaluated_at"), "memory_id", "verdict_id"))
        newest = placed.withColumn("position", place).where(F.col("position") <= k)
        found = candidates.select(F.col("memory_id").alias("candidate_id"), "asset_id").join(newest, "asset_id")
    else:
        held = history_as_of(candidates.select(F.col("memory_id").alias("candidate_id"), "asset_id", F.col(as_of).alias("at")), placed, k=k)
        found = held.select("candidate_id", F.posexplode("history").alias("place", "v")).select("candidate_id", "v.*", (F.col("place") + 1).alias("position"))
    return found.where("candidate_id <> memory_id").select("candidate_id", *_VERDICT, "position")


def _last_before(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``rows(by, at, v)`` with ``last``: the ``k`` last of the ``v`` that are not null up to each row, newest first. One pass in order of
    time that keeps ``k`` offsets, not a list that grows; at one time rows with ``v`` come first."""
    own = W.partitionBy(*by).orderBy("at", F.col("v").isNull(), F.desc("v.memory_id"), F.desc("v.verdict_id"))
    seen = F.last("v", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    order = "at, v IS NULL, v.memory_id DESC, v.verdict_id DESC"
    earlier = [F.expr(f"lag(v, {i}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY {order})") for i in range(1, k + 1)]
    # A row that has a verdict counts it as the first of the last; its lags are those before it.
    listed = F.when(F.col("v").isNull(), F.array(*earlier)).otherwise(F.array(seen, *earlier[:-1]))
    return rows.withColumn("last", F.filter(listed, lambda x: x.isNotNull()))


def history_as_of(asked: DataFrame, placed: DataFrame, *, k: int) -> DataFrame:
    """``asked(candidate_id, asset_id, at)`` with ``history``: the ``k`` newest of ``placed(asset_id, evaluated_at, ...)`` that their asset
    had at that time, newest first.

    An as-of join by one ordered pass in place of a range join. Assets are cut into days, so that one with a third of all rows is many
    tasks; what the days before bring along is the ``k`` last verdicts of each, found before the shuffle and passed on by a second, small
    pass. Times are ISO texts in UTC; without one, or without an asset, a candidate has no history.
    """
    asked, placed = asked.where("asset_id is not null and at is not null"), placed.where("asset_id is not null and evaluated_at is not null")
    v = F.struct(*_VERDICT, "evaluated_at").alias("v")
    day = lambda c: F.substring(c, 1, 10).alias("day")
    given = placed.select("asset_id", day("evaluated_at"), F.col("evaluated_at").alias("at"), v)
    none = F.lit(None).cast(given.schema["v"].dataType).alias("v")
    rows = asked.select("candidate_id", "asset_id", day("at"), "at", none).unionByName(given, allowMissingColumns=True)
    within = _last_before(rows, ["asset_id", "day"], k).where("candidate_id is not null").select("candidate_id", "asset_id", "day", F.col("last").alias("today"))
    newest = F.row_number().over(W.partitionBy("asset_id", "day").orderBy(F.desc("at"), "v.memory_id", "v.verdict_id"))
    daily = given.withColumn("place", newest).where(F.col("place") <= k).drop("place")
    # A mark at the beginning of each day: what the days before had.
    marks = asked.select("asset_id", day("at")).distinct().select("asset_id", "day", F.col("day").alias("at"), none)
    before = _last_before(daily.unionByName(marks), ["asset_id"], k).where("v is null").select("asset_id", "day", F.col("last").alias("earlier"))
    return within.join(before, ["asset_id", "day"], "left").select("candidate_id", F.slice(F.concat("today", F.coalesce("earlier", F.array().cast(before.schema["earlier"].dataType))), 1, k).alias("history"))


def fleet_context(candidates: DataFrame, fleet: DataFrame, chunks: DataFrame, verdicts: DataFrame, memories: DataFrame, *, as_of: str | None = None, index: VectorIndex | None = None, copies: DataFrame | None = None, vectors: DataFrame | None = None, stage: str = "cloud") -> DataFrame:
    """``candidates`` with three arrays: observations (with the device they come from), documents and history (of all time, or as of a
    time of the candidates). ``index``: a vector index of the fleet, with its ``copies`` (:func:`fleet_neighbours`); ``vectors``: those of the chunks, if they
    are a table apart. At the edge, whose judge sees documents only, there are no other arrays."""
    def gathered(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("position", *fields)))
        return rows.groupBy("candidate_id").agg(F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))

    out = candidates.withColumn("candidate_id", F.col("memory_id"))
    parts = []
    if stage == "cloud":
        seen = fleet_neighbours(candidates, fleet, index=index, copies=copies).join(fleet.select("memory_id", "source", "content"), "memory_id").withColumnRenamed("memory_id", "id")
        past = verdict_history(candidates, verdicts, memories, as_of=as_of)
        parts = [(seen, "observations", ("id", "source", "content")), (past, "history", ("verdict", "rationale"))]
    for rows, name, fields in parts:
        out = out.join(gathered(rows, name, *fields), "candidate_id", "left").withColumn(name, F.coalesce(name, F.array().cast(_array_of(fields))))
    found = asset_documents(candidates, chunks, vectors=vectors, content=False).select("candidate_id", "id", "source", "position")
    texts = chunks.select("id", "asset_id", "content")
    per_asset = candidates.groupBy("asset_id").agg(F.count("*").alias("n")).limit(KEYS + 1).collect()
    parts_of = [(r.asset_id, -(-r.n // SIDE_BY_SIDE)) for r in per_asset]
    if sum(r.n for r in per_asset) >= PRODUCTS and len(parts_of) <= KEYS and all(asset is not None and n <= COPIES for asset, n in parts_of):
        return _with_documents(out, found, texts, parts_of)
    held = gathered(found.join(texts.drop("asset_id"), "id"), "documents", *DOCUMENT)
    return out.join(held, "candidate_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(_array_of(DOCUMENT)))).drop("candidate_id")


def _array_of(fields: tuple[str, ...]) -> str:
    return "array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>"


def _with_documents(out: DataFrame, found: DataFrame, texts: DataFrame, parts_of: list[tuple[str, int]]) -> DataFrame:
    """``out(candidate_id, asset_id, ...)`` with the array ``documents`` of ``found(candidate_id, id, source, position)``, all of a candidate's being of its asset.

    Most texts are found by several candidates. So texts go to the candidates of their asset once, or once to each part of them (``parts_of``: in how many they lie), instead of
    once for each candidate that found them; what is found, the candidates and the texts are dealt by asset and part, and nothing is dealt again after that.
    """
    spark = out.sparkSession
    parts = F.broadcast(spark.createDataFrame(parts_of, "asset_id string, __parts int"))
    own = F.struct("asset_id", F.pmod(F.xxhash64("candidate_id"), F.col("__parts")).cast("int").alias("part")).alias("__side")
    whose = lambda position, source: F.struct("candidate_id", position.cast("int").alias("position"), source.cast("string").alias("source")).alias("__p")
    shown = F.struct(*[c for c in out.columns if c != "candidate_id"]).alias("__c")
    people = out.join(parts, "asset_id").select(own, F.concat(F.lit("of "), "candidate_id").alias("id"), whose(F.lit(0), F.lit(None)), shown)
    pairs = found.join(out.select("candidate_id", "asset_id"), "candidate_id").join(parts, "asset_id").select(own, F.concat(F.lit("id "), "id").alias("id"), whose(F.col("position"), F.col("source")))
    copies = texts.join(parts, "asset_id").withColumn("__n", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    copies = copies.select(F.struct("asset_id", F.col("__n").alias("part")).alias("__side"), F.concat(F.lit("id "), "id").alias("id"), "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(n for _, n in parts_of))
    dealt = people.unionByName(pairs, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True).repartition(tasks, "__side")
    met = dealt.groupBy("__side", "id").agg(F.first("content", ignorenulls=True).alias("content"), F.first("__c", ignorenulls=True).alias("__c"), F.collect_list("__p").alias("__ps"))
    each = met.select("__side", F.substring("id", 4, 1 << 30).alias("id"), "content", "__c", F.explode("__ps").alias("p"))
    listed = F.array_sort(F.collect_list(F.when(F.col("p.position") > 0, F.struct("p.position", "id", "p.source", "content"))))
    whole = each.groupBy("__side", "p.candidate_id").agg(F.first("__c", ignorenulls=True).alias("__c"), listed.alias("documents"))
    return whole.select("__c.*", F.transform("documents", lambda x: F.struct(*[x[f].alias(f) for f in DOCUMENT])).alias("documents"))


def prompts(context: DataFrame, *, stage: str) -> Column:
    """The judge's prompt for each row of ``context``; with the evidence that a record was written with (``evidence``), if there is
    such a column."""
    held = F.col("evidence") if "evidence" in context.columns else F.array().cast("array<struct<source: string, content: string>>")
    shown = {"observations": F.col("observations"), "history": F.col("history")} if stage == "cloud" else {"evidence": held}
    return judge_prompt(stage, *[F.col(c) for c in ("content", "memory_type", "asset_id", "source")], F.col("documents"), **shown)


def evaluate(context: DataFrame, provider: Callable[[list[str]], list[str]], *, stage: str, model: str, now: str) -> DataFrame:
    """A verdict record for each row of ``context`` (see :func:`fleet_context`): prompt, answer, recovery, coercion.

    Evidence: at the edge the ids of the evidence that the record was written with and of the documents, each once; in the cloud those of
    observations and documents, one after the other.
    """
    cloud = stage == "cloud"
    answered = generate_with(context.withColumn("__prompt", prompts(context, stage=stage)), "__prompt", provider, column="__raw").withColumn("__json", json_object_exact(F.col("__raw")))
    ids: Column = F.transform("documents", lambda d: d["id"])
    with_ids = "evidence" in context.columns and "id" in context.schema["evidence"].dataType.elementType.names
    own = F.transform("evidence", lambda e: e["id"]) if with_ids else F.array().cast("array<string>")
    used = F.concat(F.transform("observations", lambda o: o["id"]), ids) if cloud else F.array_distinct(F.concat(own, ids))
    fields = coerce(F.col("__json"), stage)
    return answered.select(
        F.concat(F.lit("vrd-"), F.substring(F.sha2(F.concat_ws("\x00", "memory_id", F.lit(stage), F.lit(now)), 256), 1, 32)).alias("verdict_id"), "memory_id", F.lit(stage).alias("stage"),
        *[c.alias(k) for k, c in fields.items()], used.alias("evidence_used"), F.lit(model).alias("model_used"), F.lit(now).alias("evaluated_at"),
    )
