"""The query catalogue over the driver tables: Spark callables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..functions.vector import cosine, embed_with, hash_embed
from ..functions.verdicts import coerce, grounded_prompt, json_object, stub_verdicts
from ..operators import answer, filters, gate, lifecycle, listing, provision, retrieval, session, sync, validate
from ..operators.evaluate import OBSERVATIONS, asset_documents, evaluate, fleet_context, fleet_neighbours, prompts, verdict_history
from ..operators.nearest import first_copies
from ..operators.term_index import TermIndex
from ..operators.vector_index import VectorIndex
from ..sources import ingest, store
from ..sources.scratch import scratch_folder, state_of, written
from . import oracle
from .views import spark_view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

TARGET = {"component": "pump", "job_terms": ["the", "und"]}
NOW = "2025-01-01T00:00:00Z"


def query(f: Query) -> Query:
    """Register a query under its function's name; a final underscore, which keeps it apart from an operator, does not count."""
    _QUERIES[f.__name__.rstrip("_")] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(spark_view(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """What is searched by vectors of the chunks, without their texts."""
    return spark_view(spark, d, "chunk_vec").select("id", "asset_id", "jev_status", "embedding")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The questions, each with a vector of the table and its terms."""
    rows, vectors = spark_view(spark, d, "questions"), spark_view(spark, d, "embeddings")
    vectors = vectors.select("vec_id", F.col("embedding").alias("vector"))
    return rows.withColumn("vec_id", F.col("n") % vectors.count()).join(vectors, "vec_id").withColumn("terms", X.exact_terms(F.col("text"))).drop("n")


def kept_terms(spark: SparkSession, d: str) -> TermIndex:
    """An index of the chunks' words, kept while the documents stay as they are."""
    path = f"{scratch_folder(spark)}/terms-words-{state_of(spark, f'{d}/documents.parquet')[:12]}"
    return TermIndex.kept(spark_view(spark, d, "chunks"), path)


def kept_index(spark: SparkSession, d: str, name: str, id: str, *tables: str) -> VectorIndex:
    """An index of the rows of ``_INDEXED[name]``, kept while the files of the tables they come from stay as they are."""
    state = "-".join(state_of(spark, f"{d}/{t}.parquet")[:12] for t in tables)
    return VectorIndex.kept(spark, f"{scratch_folder(spark)}/vectors-{name}-{state}", lambda: _INDEXED[name](spark, d), id=id)


# Vectors and filters


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(spark_view(spark, d, "embeddings"), vector_of(spark, d, 0), k=12, id="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query
def vector_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index's lists, as many as it takes to find 98 in 100 of the nearest rows."""
    index = kept_index(spark, d, "embeddings", "memory_id", "embeddings")
    return index.top(vector_of(spark, d, 0), k=12, exact=False).select("memory_id", F.round("score", 6).alias("score"))


@query
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = filters.metadata_filter({"component": "pump", "doc_type": "report"})
    return retrieval.vector_topk(spark_view(spark, d, "chunk_vec"), vector_of(spark, d, 1), k=8, where=where).select("id", "component", "doc_type", F.round("score", 6).alias("score"))


@query
def cloud_search(spark: SparkSession, d: str) -> DataFrame:
    where = filters.metadata_filter({"asset_id": "MSN4405"}, allowed=filters.CLOUD_METADATA)
    return retrieval.vector_topk(spark_view(spark, d, "chunk_vec"), vector_of(spark, d, 2), where=where).select("id", "asset_id", F.round("score", 6).alias("score"))


@query
def scroll_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = filters.combine([filters.equals("asset_id", "MSN4407")], [filters.equals("doc_type", "report"), filters.equals("component", "electrical")])
    return store.scroll(spark_view(spark, d, "chunks"), where, limit=30).select("id", "asset_id", "doc_type", "component")


@query
def filter_any_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "chunks").where(filters.metadata_filter({"applicable_to": ["MSN4403", "fleet-1"], "equipment_model": "A320"})).select("id", joined("applicability").alias("applicability"))


@query
def filter_text_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "chunks").where(filters.text("content", "The, und!")).select("id")


@query
def filter_must_should_must_not(spark: SparkSession, d: str) -> DataFrame:
    where = filters.combine([filters.equals("jev_status", "not_applicable")], [filters.equals("component", "pump"), filters.equals("component", "valve")], [filters.equals("equipment_model", "A320")])
    return spark_view(spark, d, "chunks").where(where).select("id", "component", "equipment_model")


# Terms


@query
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "documents").select("doc_id", joined(X.identifier_tokens(F.col("text"))).alias("tokens"))


@query
def exact_terms_hinted(spark: SparkSession, d: str) -> DataFrame:
    texts = F.concat(F.lit("fault code "), F.col("doc_id").cast("string"), F.lit(" on ERR-"), (F.col("doc_id") % 7).cast("string"), F.lit("1: "), "text")
    return spark_view(spark, d, "documents").select("doc_id", joined(X.exact_terms(texts)).alias("terms"))


@query
def keyword_leg(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_leg(written(asked(spark, d)), spark_view(spark, d, "chunks"), per_leg=12, terms=kept_terms(spark, d))


# Fusion and ranking


def _legs(spark: SparkSession, d: str) -> DataFrame:
    """Two made-up legs: ranks from the conversation's turns."""
    t = spark_view(spark, d, "conversations")
    semantic = t.where("turn < 4").select(F.col("conv_id").alias("query_id"), F.lit("semantic").alias("leg"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("rank"), F.lit(1.0).alias("weight"))
    keyword = t.where("turn between 2 and 5").select("conv_id", F.lit("keyword"), F.concat(F.lit("c"), F.col("turn").cast("string")), F.lit(5) - F.col("turn"), F.lit(1.2))
    return semantic.union(keyword)


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_legs(spark, d)).select("query_id", "id", F.round("score", 9).alias("score"), "semantic_rank", "keyword_rank")


@query
def dedupe_best_version(spark: SparkSession, d: str) -> DataFrame:
    rows = spark_view(spark, d, "chunks").select(F.col("asset_id").alias("query_id"), F.concat("component", F.lit("/"), "doc_type").alias("id"), F.coalesce("importance", F.lit(0.0)).alias("score"), "version", F.col("n").alias("place"))
    return retrieval.dedupe(rows).select("query_id", "id", "score", "version", "place", "position")


@query
def rerank_boosts(spark: SparkSession, d: str) -> DataFrame:
    chunks = spark_view(spark, d, "chunks")
    fused = chunks.select(F.col("asset_id").alias("query_id"), "id", "content", "keywords", "version", (F.lit(1.0) / (61 + F.col("n") % 40)).alias("score"), F.when(F.col("n") % 3 != 0, F.col("n") % 40).alias("semantic_rank"), F.when(F.col("n") % 2 == 0, F.col("n") % 40).alias("keyword_rank"), F.array(F.lit("ERR-4012"), F.lit("PN-607")).alias("terms"))
    return retrieval.rerank(fused, limit=6).select("query_id", "position", "id", F.round("final_score", 9).alias("final_score"), joined("matched_keywords").alias("matched"))


@query
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.retrieve(written(asked(spark, d)), spark_view(spark, d, "chunk_texts"), terms=kept_terms(spark, d), vectors=chunk_vectors(spark, d), content=False)
    return rows.select("query_id", "position", "id", "document_id", "source", "score", "semantic_rank", "keyword_rank", "version", joined("matched_keywords").alias("matched"))


@query
def hybrid_retrieval_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same with both legs from indexes, the vectors' from the lists that a query probes at first."""
    index = kept_index(spark, d, "chunks", "id", "documents", "embeddings")
    rows = retrieval.retrieve(written(asked(spark, d)), spark_view(spark, d, "chunk_texts"), index=index, terms=kept_terms(spark, d), exact=False, vectors=chunk_vectors(spark, d), content=False)
    return rows.select("query_id", "position", "id", "score")


@query
def fallback_unfiltered(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.retrieve_or_widen(written(asked(spark, d)), spark_view(spark, d, "chunk_texts"), terms=kept_terms(spark, d), vectors=chunk_vectors(spark, d), content=False)
    return rows.select("query_id", "position", "id", "asset_id", "score", "widened")


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    rows = spark_view(spark, d, "chunks").select(F.col("asset_id").alias("query_id"), (F.col("n") % 97 * 1000000 + F.col("n")).alias("position"), "id", F.when(F.col("n") % 10 != 0, F.concat(F.lit("doc-"), (F.col("n") % 60).cast("string"))).alias("document_id"), "source", "version")
    return retrieval.citations(rows).select("query_id", "position", "document_id", "source", "version", joined("chunk_ids").alias("chunk_ids"))


# Contracts


def _broken(c: str, n: int, bad: Column, of: str = "n") -> Column:
    return F.when(F.col(of) % n == 0, bad).otherwise(F.col(c))


@query
def validate_memory(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    m = m.withColumns({"content": _broken("content", 13, F.lit("  ")), "memory_type": _broken("memory_type", 17, F.lit("rumour")), "importance": _broken("importance", 19, F.lit(float("nan"))), "created_at": _broken("created_at", 23, F.lit("yesterday")), "asset_id": _broken("asset_id", 29, F.lit(None).cast("string"))})
    return validate.validate(m, "memory").select("memory_id", joined("errors").alias("errors"))


@query
def validate_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = spark_view(spark, d, "chunk_vec").withColumn("embedding", F.col("embedding").cast("array<double>"))
    c = c.withColumns({"embedding": _broken("embedding", 13, F.array(F.lit(1.0), F.lit(float("nan")))), "keywords": _broken("keywords", 17, F.array(F.lit("ok"), F.lit(" "))), "component": _broken("component", 19, F.lit("")), "jev_status": _broken("jev_status", 23, F.lit("trusted"))})
    return validate.validate(c, "chunk").select("id", joined("errors").alias("errors"))


@query
def validate_verdict(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    v = m.select("n", F.concat(F.lit("v-"), "memory_id").alias("verdict_id"), "memory_id", F.when(F.col("n") % 13 == 0, "space").otherwise("edge").alias("stage"), F.when(F.col("n") % 17 == 0, "perhaps").otherwise("accept_local").alias("verdict"), F.when(F.col("n") % 7 == 0, " ").otherwise("seen").alias("rationale"), "confidence", F.when(F.col("n") % 19 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("risk_flags"), F.array().cast("array<string>").alias("evidence_used"), F.lit("m").alias("model_used"), F.col("created_at").alias("evaluated_at"))
    return validate.validate(v, "verdict").select("memory_id", joined("errors").alias("errors"))


@query
def validate_event(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    e = m.select(F.concat(F.lit("e-"), "memory_id").alias("event_id"), "memory_id", F.when(F.col("n") % 11 == 0, "drop").otherwise("create").alias("operation"), "source", F.col("source").alias("source_device"), "version", F.col("version").alias("source_version"), F.when(F.col("n") % 13 == 0, "").otherwise("2").alias("target_version"), F.when(F.col("n") % 17 == 0, "soon").otherwise(F.col("updated_at")).alias("timestamp"), F.lit("queued").alias("status"))
    return validate.validate(e, "sync_event").select("memory_id", joined("errors").alias("errors"))


@query
def validate_conflict(spark: SparkSession, d: str) -> DataFrame:
    m, none = spark_view(spark, d, "memories"), F.lit(None).cast("string")
    n = F.col("n")
    c = m.select("memory_id", F.concat(F.lit("c-"), "memory_id").alias("conflict_id"), F.lit("a").alias("edge_version"), F.when(n % 13 == 0, " ").otherwise("b").alias("cloud_version"), F.lit("version_divergence").alias("conflict_type"), F.when(n % 17 != 0, F.struct(F.lit("validated").alias("verdict"), F.when(n % 5 == 0, "").otherwise("why").alias("rationale"))).alias("jev_recommendation"), F.when(n % 3 == 0, "resolved").when(n % 19 == 0, "closed").otherwise("open").alias("status"), F.when(n % 2 == 0, "edge").otherwise("").alias("resolution"), F.when(n % 7 == 0, none).otherwise("ann").alias("resolved_by"), none.alias("recommended_by_verdict"), F.when(n % 23 == 0, "never").alias("updated_at"), none.alias("resolved_at"), F.when(n % 29 == 0, "both").alias("resolution_winner"))
    return validate.validate(c, "conflict").select("memory_id", joined("errors").alias("errors"))


@query
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Records that break their contract, apart from those that keep it."""
    m = spark_view(spark, d, "memories").withColumn("content", _broken("content", 13, F.lit("  ")))
    good, bad = validate.split_valid(m, "memory")
    return good.select("memory_id", F.lit("").alias("errors")).union(bad.select("memory_id", joined("errors")))


@query
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"memory_id": "'), "memory_id", F.when(F.col("n") % 7 == 0, F.lit('", "colour": 1, "content": "x"}')).when(F.col("n") % 11 == 0, F.lit('", "Content": "x", "size": {"a": 1}}')).otherwise(F.lit('", "source": "s"}')))
    return spark_view(spark, d, "memories").select("memory_id", joined(validate.unknown_fields(raw, "memory")).alias("unknown"))


# Change detection and reconciliation


@query
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories").withColumn("fingerprint", sync.fingerprint())
    return m.select("memory_id", "fingerprint", sync.version_label(F.col("fingerprint")).alias("label"))


@query
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    return sync.detect_changes(spark_view(spark, d, "memories"), spark_view(spark, d, "ledger")).select("memory_id", F.col("last").isNull().alias("is_new"))


@query
def sync_eligible(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "memories").select("memory_id", sync.sync_eligible().alias("eligible"))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return sync.build_delta(spark_view(spark, d, "memories"), spark_view(spark, d, "ledger"))


@query
def build_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("memory_id", "operation", "fingerprint", "high_visibility")


@query
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.change_counts(spark_view(spark, d, "memories"), spark_view(spark, d, "ledger"))


@query
def pending_changes(spark: SparkSession, d: str) -> DataFrame:
    return sync.pending_changes(spark_view(spark, d, "memories"), spark_view(spark, d, "ledger")).select("memory_id", "operation", "sync_eligible")


def _withdrawn(spark: SparkSession, d: str) -> DataFrame:
    """What technicians withdraw: the query set, and an id that nobody knows."""
    return spark_view(spark, d, "memories").where("n % 20 = 0").select("memory_id").union(spark.createDataFrame([("mem-unknown",)], "memory_id string"))


@query
def expire_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return sync.expire_items(_withdrawn(spark, d), spark_view(spark, d, "memories"), spark_view(spark, d, "ledger"))


def _round(spark: SparkSession, d: str) -> DataFrame:
    """One round of a device that lost some memories, and holds some that break their contract."""
    edge = spark_view(spark, d, "memories").where("n % 17 <> 0").withColumn("asset_id", _broken("asset_id", 13, F.lit(" ")))
    return sync.plan_round(edge, spark_view(spark, d, "ledger"), spark_view(spark, d, "cloud_memories"), _withdrawn(spark, d))


@query
def sync_round_plan(spark: SparkSession, d: str) -> DataFrame:
    return _round(spark, d).select("memory_id", "operation", "outcome", "reason")


@query
def reconcile_adopt(spark: SparkSession, d: str) -> DataFrame:
    return sync.edge_after(_round(spark, d), now=NOW).where("outcome = 'adopt'").select("memory_id", "content", "lifecycle_status", "sync_status", "updated_at", "adopt_error")


@query
def sync_round_state(spark: SparkSession, d: str) -> DataFrame:
    """The edge's records that a round changes, and what both sides then agree on."""
    plan = _round(spark, d)
    return sync.edge_after(plan, now=NOW).select("memory_id", "content", "lifecycle_status", "sync_status").join(sync.ledger_after(plan), "memory_id", "full")


def _all_cases(spark: SparkSession, d: str) -> DataFrame:
    return sync.classify_all(spark_view(spark, d, "memories").where("n % 17 <> 0"), spark_view(spark, d, "ledger"), spark_view(spark, d, "cloud_memories"))


@query
def classify_versions(spark: SparkSession, d: str) -> DataFrame:
    return _all_cases(spark, d).select("memory_id", "kase")


@query
def case_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.case_counts(_all_cases(spark, d))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return sync.classify(_delta(spark, d), spark_view(spark, d, "ledger"), spark_view(spark, d, "cloud_memories"))


@query
def reconcile_outcome(spark: SparkSession, d: str) -> DataFrame:
    return sync.reconcile_counts(_classified(spark, d))


@query
def conflict_records(spark: SparkSession, d: str) -> DataFrame:
    return sync.conflict_records(_classified(spark, d), now=NOW).select("memory_id", "edge_version", "cloud_version", "conflict_type", "status", F.col("jev_recommendation.verdict").alias("recommended"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts found in two rounds, the second of which knew another cloud version of some; some are resolved."""
    first = sync.conflict_records(_classified(spark, d), now="2025-01-01T00:00:00Z").withColumn("n", F.substring("memory_id", 5, 9).cast("int"))
    again = first.where("n % 2 = 0").withColumns({"conflict_id": F.concat(F.lit("cfl-later-"), "memory_id"), "cloud_version": F.lit("later"), "updated_at": F.lit("2025-01-02T00:00:00Z")})
    return first.withColumn("conflict_id", F.concat(F.lit("cfl-"), "memory_id")).union(again).withColumn("status", F.when(F.col("n") % 5 == 0, "resolved").otherwise("open"))


@query
def current_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return sync.current_conflicts(_found(spark, d))


@query
def open_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return listing.open_conflicts(_found(spark, d)).select("position", "conflict_id", "memory_id")


@query
def conflict_by_id(spark: SparkSession, d: str) -> DataFrame:
    return listing.conflict_by_id(_found(spark, d), "cfl-mem-000000042").select("conflict_id", "memory_id", "status")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Delta items, some of which the cloud must refuse."""
    n = F.col("n")
    return _delta(spark, d).withColumns({"record_id": F.when(n % 9 == 0, "mem-other").otherwise(F.col("memory_id")), "has_record": n % 8 != 5, "content": F.when(n % 5 == 0, " ").otherwise(F.col("content")), "operation": F.when(n % 13 == 0, "merge").otherwise(F.col("operation"))}).withColumn("memory_id", F.when(n % 31 == 0, "").otherwise(F.col("memory_id")))


@query
def ingest_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("n", sync.reject_reason().alias("reason"))


@query
def sync_events(spark: SparkSession, d: str) -> DataFrame:
    applied = _items(spark, d).where(sync.reject_reason().isNull())
    return sync.sync_events(applied, device="edge-1", now=NOW).drop("event_id")


@query
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    events = sync.sync_events(m.withColumns({"operation": F.lit("create"), "fingerprint": sync.fingerprint()}), device="edge-1", now=NOW).join(m.select("memory_id", "updated_at"), "memory_id")
    events = events.withColumns({"timestamp": F.col("updated_at"), "event_id": F.concat(F.lit("evt-"), "memory_id")})
    return listing.audit_trail(events).select("position", "event_id", "memory_id", "timestamp", "target_version")


def _acked(spark: SparkSession, d: str) -> DataFrame:
    items = _delta(spark, d)
    r = items.select("memory_id", F.when(F.col("n") % 3 == 0, "rejected").otherwise("applied").alias("status"), F.lit(1).alias("at")).union(items.where("n % 6 = 3").select("memory_id", F.lit("applied"), F.lit(2)))
    return sync.acknowledge(items, r)


@query
def ack_to_synced(spark: SparkSession, d: str) -> DataFrame:
    return _acked(spark, d).select("memory_id", "acked", "new_lifecycle", "new_sync_status")


@query
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_counts(_acked(spark, d))


@query
def sync_results(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_results(_acked(spark, d))


# Lifecycle and routing


@query
def capture_records(spark: SparkSession, d: str) -> DataFrame:
    rows = spark_view(spark, d, "memories").select("content", "asset_id", "source")
    return lifecycle.capture(rows, "observation", now=NOW).select("memory_id", "memory_type", "importance", "confidence", "lifecycle_status", "jev_status", "sync_status")


@query
def capture_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Notes and manuals: their defaults and first statuses."""
    rows = spark_view(spark, d, "memories").select("content", "asset_id", "source", "version", F.when(F.col("n") % 3 == 0, F.lit(0.8)).alias("importance"))
    return store.union_by_name([lifecycle.capture(rows, kind, now=NOW) for kind in ("note", "manual")]).select("memory_id", "memory_type", "version", "importance", "confidence", "lifecycle_status", "jev_status")


def _evaluated(stored: DataFrame) -> DataFrame:
    """Scripted verdicts: some memories get none, some one without a reason, some one that is not of this stage."""
    k = F.pmod(F.conv(F.substring("memory_id", 5, 8), 16, 10).cast("long"), F.lit(7))
    v = F.when(k == 1, "flag_risk").when(k == 2, "validated").otherwise("accept_local")
    return stored.select("memory_id", v.alias("verdict"), F.when(k == 3, " ").otherwise("as the manual says").alias("rationale"), F.lit(0.9).alias("confidence"), k.alias("k")).where("k <> 0").drop("k")


@query
def capture_and_route(spark: SparkSession, d: str) -> DataFrame:
    rows = spark_view(spark, d, "memories").select("content", "asset_id", "source", "importance").distinct()
    routed = lifecycle.capture_and_route(rows, "observation", _evaluated, now=NOW)[1]
    return routed.select("memory_id", "verdict", "verdict_confidence", "action", F.col("error").isNotNull().alias("refused"), "lifecycle_status", "jev_status", joined("transitions").alias("transitions"))


@query
def revise_and_route(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    wanted = m.where("revision_of is not null").select(F.col("revision_of").alias("update_of"), F.concat("content", F.lit(" revised")).alias("content"), F.when(F.col("n") % 2 == 0, F.lit(0.9)).alias("importance"), "n")
    routed = lifecycle.revise_and_route(wanted, m, lambda stored: stub_verdicts(stored, now=NOW), now=NOW)[0]
    return routed.select("n", "memory_type", "version", "importance", "action", "verdict_route", "lifecycle_status", "jev_status", "revision_of")


@query
def strict_steps(spark: SparkSession, d: str) -> DataFrame:
    """Only legal steps are taken; the strict form would raise on any other."""
    m, target = spark_view(spark, d, "memories"), F.lit("conflict")
    legal = m.where(lifecycle.is_legal("lifecycle", F.col("lifecycle_status"), target))
    return legal.select("memory_id", lifecycle.checked_step("lifecycle", F.col("lifecycle_status"), target).alias("lifecycle_status"))


@query
def transition_relation(spark: SparkSession, d: str) -> DataFrame:
    """Each legal step, and how many memories stand where it begins."""
    at = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(own).alias("from_status")) for kind, own in (("lifecycle", "lifecycle_status"), ("jev", "jev_status"))])).alias("at")
    standing = spark_view(spark, d, "memories").select(at).groupBy("at.kind", "at.from_status").agg(F.count("*").alias("n"))
    return lifecycle.transitions(spark).join(standing, ["kind", "from_status"], "left").select("kind", "from_status", "to_status", F.coalesce("n", F.lit(0)).alias("memories"))


@query
def initial_status(spark: SparkSession, d: str) -> DataFrame:
    s = lifecycle.initial_status(F.col("memory_type"))
    return spark_view(spark, d, "memories").select("memory_id", s["lifecycle_status"].alias("life"), s["jev_status"].alias("judged"))


def _steps(spark: SparkSession, d: str, kind: str, own: str) -> DataFrame:
    seen = spark_view(spark, d, "memories").agg(F.collect_set(own).alias("seen")).select("seen", F.explode("seen").alias("from_status")).select("from_status", F.explode("seen").alias("to_status"))
    return seen.select("from_status", "to_status", lifecycle.is_legal(kind, F.col("from_status"), F.col("to_status")).alias("legal"))


@query
def lifecycle_legal(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, "lifecycle", "lifecycle_status")


@query
def jev_legal(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, "jev", "jev_status")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    verdict = F.when(n % 23 == 0, "maybe").when(n % 19 == 0, "validated").when(n % 3 == 0, "flag_risk").when(n % 5 == 0, "needs_more_evidence").otherwise("accept_local")
    m = spark_view(spark, d, "memories").withColumn("verdict", verdict)
    action, error = lifecycle.route(F.col("verdict"), expire=n % 7 == 0, update_of=F.when(n % 11 == 0, F.col("revision_of")))
    return m.withColumns({"action": action, "route_error": error})


@query
def route_memory(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("memory_id", "action", F.col("route_error").isNotNull().alias("refused"))


@query
def apply_route(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.apply_route(_routed(spark, d).where("action is not null")).select("memory_id", "action", "lifecycle_status", "jev_status", joined("transitions").alias("transitions"), F.col("error").isNotNull().alias("illegal"))


def _revisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = spark_view(spark, d, "memories")
    wanted = m.where("revision_of is not null").select(F.when(F.col("n") % 5 == 0, "mem-none").otherwise(F.col("revision_of")).alias("update_of"), F.concat("content", F.lit(" revised")).alias("content"), "n")
    return lifecycle.revise(wanted, m, now=NOW)


@query
def revision_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _revisions(spark, d)[0].select("n", "revision_of", "version", "memory_id")


@query
def orphan_revisions(spark: SparkSession, d: str) -> DataFrame:
    return _revisions(spark, d)[1].groupBy("error").agg(F.count("*").alias("n"))


@query
def mark_used(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    return lifecycle.mark_used(m, m.where("n % 3 = 0").select("memory_id")).select("memory_id", "lifecycle_status", F.col("used_error").isNotNull().alias("refused"))


@query
def mark_sync_pending(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.mark_sync_pending(spark_view(spark, d, "memories")).select("memory_id", "marked")


# Provisioning and stores


@query
def select_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return provision.select_knowledge(spark_view(spark, d, "chunks"), TARGET, max_chunks=40).select("rank", "id", "document_id", F.round("priority", 6).alias("priority"))


@query
def provision_summary(spark: SparkSession, d: str) -> DataFrame:
    return provision.summary(spark_view(spark, d, "chunks"), TARGET, max_chunks=40)


@query
def transfer_by_document(spark: SparkSession, d: str) -> DataFrame:
    return provision.transfer(_selected(spark, d))[1]


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """Of chunks with a text: one without would break its contract and stop the transfer."""
    return provision.select_knowledge(spark_view(spark, d, "chunk_vec").where(F.col("content").rlike(r"\S")), {"component": "pump"}, max_chunks=60)


@query
def transferred_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The records that a device is given, with defaults and their vectors as they were."""
    bare = _selected(spark, d).withColumns({"version": F.when(F.col("n") % 5 != 0, F.col("version")), "jev_status": F.when(F.col("n") % 2 == 0, "").otherwise(F.col("jev_status"))})
    return provision.transfer(bare)[0].select("id", "document_id", "version", "jev_status", "source", F.round(F.element_at("embedding", 1), 6).alias("first"), F.size("embedding").alias("dimensions"))


@query
def package_header(spark: SparkSession, d: str) -> DataFrame:
    return provision.build_package(spark_view(spark, d, "chunks"), TARGET, max_chunks=40).header


@query
def package_items(spark: SparkSession, d: str) -> DataFrame:
    items = provision.build_package(spark_view(spark, d, "chunks"), {"equipment_model": "A320", "component": None}, max_chunks=25).items
    return items.select("rank", "id", "document_id", "equipment_model", "jev_status")


@query
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spark_view(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", F.lit("MSN4400").alias("asset_id"), F.lit("pump").alias("component"), "source")
    rows = ingest.ingest(docs, now=NOW, cloud=True)
    return store.replace_documents(rows.where("document_id < '5'"), rows, documents=docs.where(X.has_chunks(F.col("text")))).select("id", "document_id", "content", "jev_status", F.size("embedding").alias("dimensions"))


@query
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    m, new = spark_view(spark, d, "memories").select("memory_id", "content", "version"), spark_view(spark, d, "cloud_memories")
    return store.upsert(m.where("version <> '3'"), new.where("n % 7 = 0").select("memory_id", "content", "version"), "memory_id")


@query
def delete_by_document(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_where(spark_view(spark, d, "chunks"), F.col("document_id") == "doc-8").select("id", "document_id")


@query
def delete_by_ids(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    return store.delete_ids(m, m.where("n % 4 = 1").select("memory_id"), "memory_id").select("memory_id")


@query
def list_memories(spark: SparkSession, d: str) -> DataFrame:
    return store.list_memories(spark_view(spark, d, "memories"), asset_id="MSN4403", limit=25).select("memory_id", "updated_at")


@query
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """A provider's vectors, 32 texts a call; this one gives each text's length and number of words."""
    t = spark_view(spark, d, "turns")
    return embed_with(t, "text", _measure).select("session_id", "seq", joined(F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("vector"))


def _measure(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(len(t.split()))] for t in texts]


# Evaluation, gate and conflicts


def _coerced(spark: SparkSession, d: str, stage: str) -> DataFrame:
    v = spark_view(spark, d, "verdict_raw").withColumn("json", json_object(F.col("raw")))
    c = coerce(F.col("json"), stage)
    return v.select("memory_id", c["verdict"].alias("verdict"), c["rationale"].alias("rationale"), c["confidence"].alias("confidence"), joined(c["risk_flags"]).alias("flags"))


@query
def edge_coerce(spark: SparkSession, d: str) -> DataFrame:
    return _coerced(spark, d, "edge")


@query
def cloud_coerce(spark: SparkSession, d: str) -> DataFrame:
    return _coerced(spark, d, "cloud")


def _cloud_verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return spark_view(spark, d, "memories").where("n % 3 = 0").select("memory_id", F.when(n % 5 == 0, "validated").when(n % 5 == 1, "needs_human_review").when(n % 5 == 2, "rejected").when(n % 5 == 3, "accept_local").alias("verdict"), F.concat(F.lit("because "), "content").alias("rationale"), F.col("updated_at").alias("evaluated_at"))


@query
def gate_route(spark: SparkSession, d: str) -> DataFrame:
    rows = gate.apply_cloud_verdicts(spark_view(spark, d, "memories"), _cloud_verdicts(spark, d))
    return rows.select("memory_id", "action", "jev_status", F.col("error").isNotNull().alias("refused"))


@query
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("review_id", "memory_id", "queued_at", "status", F.col("memory.content").alias("content"), F.col("verdict_record.rationale").alias("rationale"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return gate.review_queue(spark_view(spark, d, "memories"), _cloud_verdicts(spark, d), now=F.col("evaluated_at"))


@query
def open_reviews(spark: SparkSession, d: str) -> DataFrame:
    decided = _reviews(spark, d).withColumn("status", F.when(F.substring("memory_id", 13, 1).isin("1", "4"), "done").otherwise(F.col("status")))
    return listing.open_reviews(decided).select("position", "review_id", "queued_at")


@query
def fleet_effects(spark: SparkSession, d: str) -> DataFrame:
    return gate.fleet_effects(spark_view(spark, d, "memories"), _cloud_verdicts(spark, d), now=NOW).select("memory_id", "store", "action", "jev_status", "sync_status", "updated_at")


@query
def conflict_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """From conflict to memory to the cloud's copy to the last verdict on it."""
    v = _cloud_verdicts(spark, d).withColumns({"stage": F.lit("cloud"), "verdict_id": F.concat(F.lit("v1-"), "memory_id")})
    newer = v.where("verdict = 'rejected'").withColumns({"verdict": F.lit("validated"), "verdict_id": F.concat(F.lit("v2-"), "memory_id"), "evaluated_at": F.lit(NOW)})
    rows = sync.conflict_records(_classified(spark, d), now=NOW).withColumn("conflict_id", F.concat(F.lit("cfl-"), "memory_id"))
    return gate.recommendations(rows, spark_view(spark, d, "cloud_memories"), v.union(newer).union(v.withColumns({"stage": F.lit("edge"), "evaluated_at": F.lit("2026-01-01T00:00:00Z")})))


@query
def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations and decisions on open conflicts; some conflicts were decided, or recommended on, in an earlier round."""
    k = F.col("k")
    rows = sync.conflict_records(_classified(spark, d), now=NOW).withColumn("k", F.substring("memory_id", 5, 9).cast("int"))
    before, told, none = k % 7 == 0, k % 7 == 1, F.lit(None).cast("string")
    real = F.struct(F.lit("rejected").alias("verdict"), F.lit("seen earlier").alias("rationale"))
    rows = rows.withColumns({"status": F.when(before, "resolved").otherwise(F.col("status")), "resolution": F.when(before, "as agreed").otherwise(F.col("resolution")), "resolved_by": F.when(before, "bob").otherwise(F.col("resolved_by")), "resolution_winner": F.when(before, "cloud").otherwise(none), "resolved_at": F.when(before, "2024-06-01T00:00:00Z").otherwise(none), "recommended_by_verdict": F.when(before | told, "v0").otherwise(none), "jev_recommendation": F.when(before | told, real).otherwise(F.col("jev_recommendation"))})
    rows = gate.recommend(rows, rows.where("k % 2 = 0").select("conflict_id", F.lit("validated").alias("verdict"), F.when(k % 6 == 0, " ").otherwise("newer reading").alias("rationale"), F.lit("v1").alias("verdict_id")))
    done = gate.confirm(rows, rows.where("k % 4 <> 3").select("conflict_id", F.when(k % 5 == 0, "both").otherwise("edge").alias("winner"), F.lit("keep the edge's").alias("resolution"), F.lit("ann").alias("resolved_by")), now=NOW)
    return done.select("memory_id", "status", "recommended", "error", "resolution", "resolved_by", "resolution_winner", "resolved_at", "recommended_by_verdict", F.col("jev_recommendation.verdict").alias("advised"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("memory_id"), "embedding", "vec_id")


def _neighbours(spark: SparkSession, d: str, exact: bool) -> DataFrame:
    e = _vectors(spark, d)
    found = fleet_neighbours(e.where("vec_id % 20 = 0"), e, index=kept_index(spark, d, "embeddings", "memory_id", "embeddings"), exact=exact)
    return found.select("candidate_id", "memory_id", "position", F.round("similarity", 6).alias("similarity"))


@query
def fleet_knn(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, exact=True)


@query
def fleet_knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Only from the lists that a vector probes at first."""
    return _neighbours(spark, d, exact=False)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Memories with a vector."""
    m, emb = spark_view(spark, d, "memories"), spark_view(spark, d, "embeddings")
    return m.join(emb, emb.vec_id == m.n % emb.count()).select(m["*"], "embedding")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: memories with an id divisible by 20."""
    return _placed(spark, d).where("n % 20 = 0")


def _fleet_copies(spark: SparkSession, d: str) -> DataFrame:
    """(stands_for, memory_id): of the memories of each vector the first that an evaluation may see, and which of them stands for all."""
    emb = spark_view(spark, d, "embeddings")
    m = spark_view(spark, d, "memories").select("memory_id", (F.col("n") % emb.count()).alias("vec_id"))
    # By the vectors' ids first, so that of each only a few memories meet it; ids of one vector are then one.
    few = first_copies(m, by=["vec_id"], id="memory_id", k=OBSERVATIONS + 1).join(emb.select("vec_id", "embedding"), "vec_id")
    own = first_copies(few.select("memory_id", "embedding"), by=["embedding"], id="memory_id", k=OBSERVATIONS + 1)
    return own.select(F.min("memory_id").over(W.partitionBy("embedding")).alias("stands_for"), "memory_id", "embedding")


#: What is indexed, by name.
_INDEXED: dict[str, Query] = {
    "embeddings": _vectors,
    "fleet-vectors": lambda spark, d: _fleet_copies(spark, d).where("memory_id = stands_for").select("memory_id", "embedding"),
    "chunks": chunk_vectors,
}


@query
def fleet_documents(spark: SparkSession, d: str) -> DataFrame:
    return asset_documents(written(_candidates(spark, d)), spark_view(spark, d, "chunk_texts"), vectors=chunk_vectors(spark, d), content=False).select("candidate_id", "id", "position", "score")


@query
def fleet_documents_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same with its vector leg from an index's lists, within each asset."""
    index = kept_index(spark, d, "chunks", "id", "documents", "embeddings")
    return asset_documents(written(_candidates(spark, d)), spark_view(spark, d, "chunk_texts"), index=index, exact=False, vectors=chunk_vectors(spark, d), content=False).select("candidate_id", "id", "position", "score")


def _context(spark: SparkSession, d: str, stage: str = "cloud") -> DataFrame:
    """Of the query set of searches, ids divisible by 20, against the whole fleet; at the edge against the documents alone."""
    fleet, candidates = _placed(spark, d), written(_candidates(spark, d))
    cloud = stage == "cloud"
    index = kept_index(spark, d, "fleet-vectors", "memory_id", "events", "embeddings") if cloud else None
    copies = written(_fleet_copies(spark, d).select("stands_for", "memory_id")) if cloud else None
    return fleet_context(candidates, fleet, spark_view(spark, d, "chunk_texts"), _judged(spark, d), fleet, index=index, copies=copies, vectors=chunk_vectors(spark, d), stage=stage)


def _answer(prompts: list[str]) -> list[str]:
    """A scripted model: trusts what the fleet has seen, and asks a person about the rest."""
    return ['{"verdict": "%s", "rationale": "%d characters read", "confidence": 0.75, "risk_flags": []}' % ("validated" if "Other devices:" in p else "accept_local", len(p)) for p in prompts]


@query
def edge_evaluation(spark: SparkSession, d: str) -> DataFrame:
    held = F.when(F.col("n") % 40 == 0, F.array(F.struct(F.lit("e1").alias("id"), F.lit("logbook").alias("source"), F.lit("it was loose").alias("content")))).otherwise(F.array().cast("array<struct<id: string, source: string, content: string>>"))
    return evaluate(_context(spark, d, "edge").withColumn("evidence", held), _answer, stage="edge", model="scripted", now=NOW).withColumns({"risk_flags": joined("risk_flags"), "evidence_used": joined("evidence_used")})


@query
def cloud_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(_context(spark, d), _answer, stage="cloud", model="scripted", now=NOW).withColumns({"risk_flags": joined("risk_flags"), "evidence_used": joined("evidence_used")})


@query
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = _context(spark, d)
    return c.select("memory_id", prompts(c, stage="cloud").alias("prompt"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Cloud verdicts, and a first one, given earlier and for another reason, on every other memory of them."""
    last = _cloud_verdicts(spark, d).withColumn("verdict_id", F.concat(F.lit("v2-"), "memory_id"))
    first = spark_view(spark, d, "memories").where("n % 6 = 0").select("memory_id", F.lit("needs_human_review").alias("verdict"), F.concat(F.lit("at first sight "), "content").alias("rationale"), F.col("created_at").alias("evaluated_at"), F.concat(F.lit("v1-"), "memory_id").alias("verdict_id"))
    return last.unionByName(first)


@query
def verdict_history_(spark: SparkSession, d: str) -> DataFrame:
    m = spark_view(spark, d, "memories")
    return verdict_history(m, _judged(spark, d), m)


@query
def verdict_history_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What each memory's asset had been judged when the memory was last changed."""
    m = spark_view(spark, d, "memories")
    return verdict_history(m, _judged(spark, d), m, as_of="updated_at")


# Sessions


@query
def session_last_context(spark: SparkSession, d: str) -> DataFrame:
    return session.context_at(spark_view(spark, d, "turns")).select("session_id", "seq", "asset_id", "component")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two hits for each turn, of which the second is beyond what a session keeps."""
    t, i = spark_view(spark, d, "turns"), F.col("session_id")
    return t.withColumn("position", F.explode(F.array(F.lit(1), F.lit(4)))).select("session_id", "seq", "position", F.concat(F.lit("doc-"), (F.col("seq") % 5).cast("string")).alias("document_id"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("source"), F.col("text").alias("content"), F.when(i % 4 == 0, "Pumps").when(i % 4 == 1, " ").alias("component"))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    t = spark_view(spark, d, "conversations").where("role = 'assistant'")
    number = F.lpad(F.col("turn").cast("string"), 4, "0")
    return t.select(F.col("conv_id").alias("session_id"), F.concat(F.lit("o-"), number).alias("memory_id"), F.substring("text", 1, 60).alias("content"), number.alias("created_at"))


def _opened(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("session_id")
    return spark_view(spark, d, "turns").select("session_id").distinct().select("session_id", F.when(c % 3 == 0, "A320").alias("equipment_model"), F.when(c % 4 == 1, "it leaks").alias("issue"))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return session.states(spark_view(spark, d, "turns"), evidence=_evidence(spark, d), observations=_noted(spark, d), sessions=_opened(spark, d))


@query
def session_evidence(spark: SparkSession, d: str) -> DataFrame:
    return session.kept_evidence(_evidence(spark, d)).select("session_id", "seq", "position", "document_id", "content")


@query
def session_observations(spark: SparkSession, d: str) -> DataFrame:
    return session.mirrored(_noted(spark, d), keep=2)


@query
def session_borrowed_context(spark: SparkSession, d: str) -> DataFrame:
    return session.context_at(spark_view(spark, d, "turns"), _evidence(spark, d)).select("session_id", "seq", "asset_id", "component")


@query
def suggested_filters(spark: SparkSession, d: str) -> DataFrame:
    return session.suggested_filters(_state(spark, d))


@query
def session_recent_buffer(spark: SparkSession, d: str) -> DataFrame:
    return session.recent(spark_view(spark, d, "turns"), keep=2).select("session_id", "seq")


@query
def actions_taken(spark: SparkSession, d: str) -> DataFrame:
    return session.actions_taken(spark_view(spark, d, "turns"))


@query
def context_dependent(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "turns").select("session_id", "seq", X.is_context_dependent(F.col("text")).alias("context_dependent"))


@query
def expand_query(spark: SparkSession, d: str) -> DataFrame:
    return session.expanded(spark_view(spark, d, "turns")).select("session_id", "seq", "query")


@query
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("session_id", "asset_id", "component", session.summary_of().alias("summary"))


@query
def grounded_prompt_(spark: SparkSession, d: str) -> DataFrame:
    questions = written(asked(spark, d))
    found = retrieval.retrieve(questions, spark_view(spark, d, "chunk_texts"), terms=kept_terms(spark, d), vectors=chunk_vectors(spark, d))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("position", "source", "document_id", "content"))), lambda c: F.struct(c["source"].alias("source"), c["document_id"].alias("document_id"), c["content"].alias("content")))
    return found.groupBy("query_id").agg(chunks.alias("chunks")).join(questions.select("query_id", "text"), "query_id").select("query_id", grounded_prompt(F.col("text"), F.col("chunks"), sources=True).alias("prompt"))


def _asked_in_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each question as one more of its conversation, with the state in which that ended."""
    return written(asked(spark, d).select("query_id", F.col("conv_id").alias("session_id"), "text", "vector").join(_state(spark, d), "session_id"))


@query
def answer_question(spark: SparkSession, d: str) -> DataFrame:
    """Expansion, the session's scope or beyond it, retrieval, prompt and generation, as one query."""
    answers = answer.answer(_asked_in_sessions(spark, d), spark_view(spark, d, "chunk_texts"), _count, terms=kept_terms(spark, d), vectors=chunk_vectors(spark, d))[0]
    return answers.select("query_id", "query", "widened", "used_context", "prompt", "answer")


def _count(prompts_: list[str]) -> list[str]:
    return [f"read {len(p)} characters" for p in prompts_]


@query
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    cited = answer.answer(_asked_in_sessions(spark, d), spark_view(spark, d, "chunk_texts"), _count, terms=kept_terms(spark, d), vectors=chunk_vectors(spark, d), content=False)[2]
    return cited.select("query_id", "position", "document_id", "source", "version", joined("chunk_ids").alias("chunk_ids"))


# Texts


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit(" the "), F.lit("\u00a0the \r\n")), F.lit(". "), F.lit(". \t\r"))
    return spark_view(spark, d, "documents").select("doc_id", X.normalize_text(raw).alias("text"))


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("position", "sentence"))


@query
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "documents").select("doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("position", "content"))


@query
def hash_embed_(spark: SparkSession, d: str) -> DataFrame:
    about = spark.range(1).select(hash_embed(F.lit("the pump valve filter of the hydraulic system"))).first()[0]
    return spark_view(spark, d, "documents").select("doc_id", F.round(cosine(hash_embed(F.col("text")), F.array(*[F.lit(x) for x in about])), 6).alias("similarity"))
