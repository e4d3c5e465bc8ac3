"""Change detection against a ledger, deltas, the cloud's ingest, version classes and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MEMORY, OPERATIONS
from .lifecycle import is_legal
from .validate import error_list

CASES = ("IDENTICAL", "EDGE_NEW", "CLOUD_NEWER", "DIVERGED", "none")


def fingerprint() -> Column:
    """SHA-256 of id, content, parent and version of a memory row, separated by NUL."""
    return F.sha2(F.concat_ws("\x00", F.col("memory_id"), F.col("content"), F.coalesce("revision_of", F.lit("")), F.col("version")), 256)


def version_label(print_: Column) -> Column:
    return F.substring(print_, 1, 12)


def change_counts(memories: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many memories were scanned, how many of them changed, and how many of those may ride a delta, in one row."""
    last = ledger.select("memory_id", F.col("fingerprint").alias("last"))
    rows = memories.withColumn("fingerprint", fingerprint()).join(last, "memory_id", "left").withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("last")))
    return rows.agg(F.count("*").alias("scanned"), F.count_if("changed").alias("changed"), F.count_if(F.col("changed") & sync_eligible()).alias("eligible"))


def detect_changes(memories: DataFrame, ledger: DataFrame) -> DataFrame:
    """Memories whose fingerprint the ledger does not hold, with ``fingerprint`` and ``last`` (null if never synced)."""
    last = ledger.select("memory_id", F.col("fingerprint").alias("last"))
    return memories.withColumn("fingerprint", fingerprint()).join(last, "memory_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("last")))


def sync_eligible() -> Column:
    """Whether a memory row may ride a delta: field observations in a live state, flagged, or accepted and on their way."""
    life, judged = F.col("lifecycle_status"), F.col("jev_status")
    live = (F.col("memory_type") == "field_observation") & ~life.isin("new", "expired", "conflict", "resolved")
    return F.coalesce(live & ((judged == "flag_risk") | ((judged == "accept_local") & life.isin("sync_pending", "used", "synced"))), F.lit(False))


def build_delta(memories: DataFrame, ledger: DataFrame) -> DataFrame:
    """One item for each changed and eligible memory: create or update, its record's columns, fingerprint and visibility."""
    items = detect_changes(memories, ledger).where(sync_eligible())
    return items.withColumns({"operation": F.when(F.col("last").isNull(), "create").otherwise("update"), "high_visibility": F.col("jev_status") == "flag_risk"}).drop("last")


def in_order(delta: DataFrame) -> DataFrame:
    """Items by memory_id: a sort by ranges, for a package whose order counts."""
    return delta.orderBy("memory_id")


def pending_changes(memories: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every changed memory with the operation it waits for and whether it may ride a delta as it is."""
    items = detect_changes(memories, ledger)
    return items.withColumns({"operation": F.when(F.col("last").isNull(), "create").otherwise("update"), "sync_eligible": sync_eligible()}).drop("last")


def expire_items(requested: DataFrame, memories: DataFrame, ledger: DataFrame) -> DataFrame:
    """Expire items of ``requested(memory_id)``: those known and once synced; others are skipped."""
    known = requested.select("memory_id").distinct().join(memories, "memory_id", "left_semi").join(ledger.select("memory_id", "fingerprint"), "memory_id")
    return known.select("memory_id", F.lit("expire").alias("operation"), "fingerprint")


def version_case(edge: Column, cloud: Column, base: Column) -> Column:
    """The three-way class of an edge, cloud and base fingerprint; null and empty ones are absent."""
    e, c, b = (F.coalesce(x, F.lit("")) for x in (edge, cloud, base))
    return (
        F.when(e == c, "IDENTICAL").when(c == "", "EDGE_NEW").when(e == "", "CLOUD_NEWER").when(b == "", "DIVERGED")
        .when((e != b) & (c != b), "DIVERGED").when(c != b, "CLOUD_NEWER").when(e != b, "EDGE_NEW").otherwise("DIVERGED")
    )


def classify(items: DataFrame, ledger: DataFrame, cloud: DataFrame) -> DataFrame:
    """``items(memory_id, fingerprint, ...)`` with base and cloud fingerprints and ``kase``."""
    base = ledger.select("memory_id", F.col("fingerprint").alias("base_fingerprint"))
    theirs = cloud.withColumn("cloud_fingerprint", fingerprint()).select("memory_id", "cloud_fingerprint")
    joined = items.join(base, "memory_id", "left").join(theirs, "memory_id", "left")
    return joined.withColumn("kase", version_case(F.col("fingerprint"), F.col("cloud_fingerprint"), F.col("base_fingerprint")))


def classify_all(memories: DataFrame, ledger: DataFrame, cloud: DataFrame) -> DataFrame:
    """Every id known to the edge, the ledger or the cloud with its class; so copies that only the cloud changed are found too."""
    mine = memories.withColumn("fingerprint", fingerprint()).select("memory_id", "fingerprint")
    base = ledger.select("memory_id", F.col("fingerprint").alias("base_fingerprint"))
    theirs = cloud.withColumn("cloud_fingerprint", fingerprint()).select("memory_id", "cloud_fingerprint")
    joined = mine.join(base, "memory_id", "full").join(theirs, "memory_id", "full")
    return joined.withColumn("kase", version_case(F.col("fingerprint"), F.col("cloud_fingerprint"), F.col("base_fingerprint")))


def case_counts(classified: DataFrame) -> DataFrame:
    """One row for each class, with none for absent ones."""
    spark = classified.sparkSession
    return spark.createDataFrame([(k,) for k in CASES], "kase string").join(classified.groupBy("kase").agg(F.count("*").alias("n")), "kase", "left").select("kase", F.coalesce("n", F.lit(0)).alias("n"))


def branch(classified: DataFrame) -> DataFrame:
    """``classified(kase, operation)`` with what reconciliation does: conflict, adopt, dedupe, upload; a diverged expiry is withheld,
    other expiries are uploaded."""
    expire = F.coalesce(F.col("operation") == "expire", F.lit(False))
    return classified.withColumn("outcome", F.when(F.col("kase") == "DIVERGED", "conflict").when(expire, "upload").when(F.col("kase") == "CLOUD_NEWER", "adopt").when(F.col("kase") == "IDENTICAL", "dedupe").otherwise("upload"))


def reconcile_counts(classified: DataFrame) -> DataFrame:
    """uploaded, adopted, conflicts and deduped, in one row."""
    b = branch(classified)
    n = lambda k, name: F.count_if(F.col("outcome") == k).alias(name)
    return b.agg(n("upload", "uploaded"), n("adopt", "adopted"), n("conflict", "conflicts"), n("dedupe", "deduped"))


# Fixed value: what a conflict says before anyone has recommended anything.
NO_RECOMMENDATION = "Both sides changed this memory since they last agreed; nobody has recommended a version yet."


def conflict_records(classified: DataFrame, *, now: str | None = None) -> DataFrame:
    """An open conflict for each diverged item, under an id made of both versions; ``updated_at`` says when it was found."""
    mine, theirs = version_label(F.col("fingerprint")), version_label(F.coalesce("cloud_fingerprint", F.lit("")))
    rows = classified.where("kase = 'DIVERGED'")
    return rows.select(
        F.concat(F.lit("cfl-"), F.substring(F.sha2(F.concat_ws("\x00", "memory_id", mine, theirs), 256), 1, 32)).alias("conflict_id"), "memory_id", mine.alias("edge_version"), theirs.alias("cloud_version"),
        F.lit("version_divergence").alias("conflict_type"), F.struct(F.lit("needs_human_review").alias("verdict"), F.lit(NO_RECOMMENDATION).alias("rationale")).alias("jev_recommendation"), F.lit("open").alias("status"), F.lit("").alias("resolution"), F.lit("").alias("resolved_by"), F.lit(now).cast("string").alias("updated_at"),
    )


def current_conflicts(conflicts: DataFrame) -> DataFrame:
    """The last open conflict of each memory: that found last (``updated_at``), of those found at once the one of the larger id."""
    return conflicts.where("status = 'open'").groupBy("memory_id").agg(F.max_by("conflict_id", F.struct("updated_at", "conflict_id")).alias("conflict_id"))


def reject_reason() -> Column:
    """Why the cloud refuses an item ``(memory_id, operation, record_id, has_record, ...memory columns)``; null if it applies it."""
    errors = error_list("memory")
    return (
        F.when(F.coalesce("memory_id", F.lit("")) == "", "item without memory_id")
        .when(F.col("operation") == "expire", None)
        .when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), F.concat(F.lit("no such operation: "), F.coalesce("operation", F.lit("null"))))
        .when(~F.col("has_record"), "item without record")
        .when(~F.col("record_id").eqNullSafe(F.col("memory_id")), "record of another memory_id")
        .when(F.size(errors) > 0, F.concat(F.lit("record breaks its contract: "), F.array_join(errors, "; ")))
    )


def sync_events(applied: DataFrame, *, device: str, now: str) -> DataFrame:
    """An audit event for each applied item."""
    return applied.select(
        F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws("\x00", "memory_id", "operation", "fingerprint", F.lit(now)), 256), 1, 32)).alias("event_id"), "memory_id", "operation", F.lit(device).alias("source_device"),
        F.lit("1").alias("source_version"), F.coalesce(F.nullif(version_label(F.col("fingerprint")), F.lit("")), F.lit("none")).alias("target_version"), F.lit(now).alias("timestamp"), F.lit("applied").alias("status"),
    )


def acknowledge(items: DataFrame, results: DataFrame) -> DataFrame:
    """``items`` with ``acked`` and their memory's status after it: the last of ``results(memory_id, status, at)`` decides, and an
    applied field observation steps to sync_pending, if legal, and to synced."""
    last = results.groupBy("memory_id").agg(F.max_by("status", "at").alias("__status"))
    applied = F.coalesce(F.col("__status") == "applied", F.lit(False))
    life = F.col("lifecycle_status")
    moves = applied & (F.col("operation") != "expire") & (F.col("memory_type") == "field_observation") & (life.isin("synced", "sync_pending") | is_legal("lifecycle", life, F.lit("sync_pending")))
    return items.join(last, "memory_id", "left").withColumns({"acked": applied, "new_lifecycle": F.when(moves, "synced").otherwise(life), "new_sync_status": F.when(moves, "synced").otherwise(F.col("sync_status"))}).drop("__status")


def sync_counts(acked: DataFrame) -> DataFrame:
    return acked.agg(F.count("*").alias("items"), F.count_if("acked").alias("synced"), F.count_if(~F.col("acked")).alias("rejected"))


def sync_results(acked: DataFrame) -> DataFrame:
    """(memory_id, outcome): which ids were synced and which were rejected, as rows, for there may be any number of them."""
    return acked.select("memory_id", F.when(F.col("acked"), "synced").otherwise("rejected").alias("outcome"))


def plan_round(memories: DataFrame, ledger: DataFrame, cloud: DataFrame, expire: DataFrame | None = None) -> DataFrame:
    """What one sync round does: a row for each memory that it touches, with ``outcome`` and both records.

    Outcomes: upload (a changed memory that the cloud takes), reject (one that it refuses, with ``reason``), expire (asked for by
    ``expire(memory_id)``; the cloud's copy goes), conflict (both sides changed; withheld, whatever was asked), dedupe (both sides
    alike), adopt (only the cloud changed, or the edge no longer has it). Columns: memory_id, operation, fingerprint and m (the edge's),
    cloud_fingerprint and c (the cloud's record), outcome, reason.
    """
    def record(df: DataFrame, name: str) -> DataFrame:
        return df.select("memory_id", F.struct(*[F.col(c) for c in MEMORY.names]).alias(name), fingerprint().alias(f"{name}_print"), *([sync_eligible().alias("eligible")] if name == "m" else []))

    asked = F.lit(None).cast("boolean").alias("asked")
    requested = expire.select("memory_id", F.lit(True).alias("asked")).distinct() if expire is not None else memories.select("memory_id", asked).limit(0)
    base = ledger.select("memory_id", F.col("fingerprint").alias("base"))
    rows = record(memories, "m").join(base, "memory_id", "full").join(record(cloud, "c"), "memory_id", "left").join(requested, "memory_id", "left")
    rows = rows.withColumn("kase", version_case(F.col("m_print"), F.col("c_print"), F.col("base")))
    changed = F.col("m").isNotNull() & ~F.col("m_print").eqNullSafe(F.col("base")) & F.col("eligible")
    expires = F.col("asked") & F.col("m").isNotNull() & F.col("base").isNotNull()
    operation = F.when(expires, "expire").when(changed, F.when(F.col("base").isNull(), "create").otherwise("update"))
    adopts = (F.col("kase") == "CLOUD_NEWER") & F.col("base").isNotNull() & F.col("c").isNotNull()
    rows = rows.withColumn("operation", operation)
    outcome = (
        F.when(F.col("operation").isNotNull() & (F.col("kase") == "DIVERGED") & F.col("c").isNotNull(), "conflict").when(F.col("operation") == "expire", "expire")
        .when(adopts, "adopt").when(F.col("operation").isNotNull(), F.when(F.col("kase") == "IDENTICAL", "dedupe").otherwise("upload"))
    )
    rows = rows.withColumn("outcome", outcome).where("outcome is not null")
    fields = rows.select("memory_id", "operation", "outcome", "m_print", "c_print", "m", "c", *[F.col("m")[c].alias(c) for c in MEMORY.names if c != "memory_id"])
    checked = fields.withColumns({"record_id": F.col("memory_id"), "has_record": F.lit(True)}).withColumn("reason", F.when(F.col("outcome") == "upload", reject_reason()))
    return checked.select("memory_id", "operation", F.col("m_print").alias("fingerprint"), "m", F.col("c_print").alias("cloud_fingerprint"), "c", F.when(F.col("reason").isNotNull(), "reject").otherwise(F.col("outcome")).alias("outcome"), "reason")


def edge_after(plan: DataFrame, *, now: str) -> DataFrame:
    """The edge's records that a round changes: those uploaded step to synced, where they legally can; those adopted are the cloud's,
    stepped to synced if the edge had one of its own; ``adopt_error`` says where the cloud's record cannot step there, which then stays out."""
    def synced(record: str) -> dict[str, Column]:
        life = F.col(record)["lifecycle_status"]
        return {"legal": life.isin("synced", "sync_pending") | is_legal("lifecycle", life, F.lit("sync_pending")), "life": life}

    up, down = synced("m"), synced("c")
    as_it_is = (F.col("outcome") == "adopt") & F.col("m").isNull()
    moves = F.when(F.col("outcome") == "upload", up["legal"] & (F.col("m")["memory_type"] == "field_observation")).when(F.col("outcome") == "adopt", down["legal"])
    rows = plan.where("outcome IN ('upload', 'adopt')").withColumns({"r": F.when(F.col("outcome") == "upload", F.col("m")).otherwise(F.col("c")), "moves": moves & ~as_it_is, "adopt_error": F.when((F.col("outcome") == "adopt") & ~as_it_is & ~down["legal"], "illegal step")})
    rows = rows.where((F.col("outcome") == "adopt") | F.col("moves"))
    changed = {"lifecycle_status": F.lit("synced"), "sync_status": F.lit("synced"), "updated_at": F.lit(now)}
    return rows.select("outcome", "adopt_error", *[(F.when(F.col("moves"), changed[c]).otherwise(F.col("r")[c]) if c in changed else F.col("r")[c]).alias(c) for c in MEMORY.names])


def ledger_after(plan: DataFrame) -> DataFrame:
    """(memory_id, fingerprint) that both sides agree on after a round."""
    agreed = plan.where("outcome IN ('upload', 'dedupe', 'adopt')")
    return agreed.select("memory_id", F.when(F.col("outcome") == "adopt", F.col("cloud_fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"))
