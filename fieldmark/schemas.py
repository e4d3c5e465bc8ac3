"""Record contracts: enumerations, transition relations and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The record contract's enumerations.
MEMORY_TYPES = ("manual", "field_observation", "session_note")
SYNC_STATUSES = ("local", "sync_pending", "synced")
LIFECYCLE_STATUSES = ("new", "local", "used", "sync_pending", "synced", "conflict", "resolved", "expired")
EVAL_STATUSES = ("not_applicable", "pending", "accept_local", "needs_more_evidence", "flag_risk", "validated", "needs_human_review", "rejected")
STAGES = ("edge", "cloud")
VERDICTS = ("accept_local", "needs_more_evidence", "flag_risk", "validated", "needs_human_review", "rejected")
EDGE_VERDICTS = ("accept_local", "needs_more_evidence", "flag_risk")
CLOUD_VERDICTS = ("validated", "needs_human_review", "rejected")
OPERATIONS = ("create", "update", "expire")
CONFLICT_STATUSES = ("open", "resolved")
WINNERS = ("edge", "cloud")

# Legal steps of the two state machines.
LIFECYCLE_STEPS = {
    "new": ("local", "expired"),
    "local": ("used", "sync_pending", "expired", "conflict"),
    "used": ("sync_pending", "expired", "conflict"),
    "sync_pending": ("synced", "conflict"),
    "synced": ("expired", "conflict"),
    "conflict": ("resolved", "expired"),
    "resolved": ("local", "used", "sync_pending", "expired"),
    "expired": (),
}
EVAL_STEPS = {
    "not_applicable": ("pending",),
    "pending": ("accept_local", "needs_more_evidence", "flag_risk", "rejected"),
    "accept_local": ("validated", "flag_risk", "rejected"),
    "needs_more_evidence": ("accept_local", "flag_risk", "rejected"),
    "flag_risk": ("accept_local", "validated", "needs_human_review", "rejected"),
    "needs_human_review": ("validated", "rejected"),
    "validated": (),
    "rejected": (),
}

SYNC_THRESHOLD = 0.7


def _struct(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "ad": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in columns.items()])


MEMORY = _struct(memory_id="s", memory_type="s", content="s", asset_id="s", source="s", version="s", importance="d", confidence="d", created_at="s", updated_at="s", sync_status="s", lifecycle_status="s", jev_status="s", revision_of="s")
VERDICT = _struct(verdict_id="s", memory_id="s", stage="s", verdict="s", rationale="s", confidence="d", risk_flags="as", evidence_used="as", model_used="s", evaluated_at="s")
CHUNK = _struct(id="s", document_id="s", version="s", content="s", embedding="ad", asset_id="s", component="s", source="s", created_at="s", updated_at="s", equipment_model="s", doc_type="s", applicability="as", keywords="as", jev_status="s")
SYNC_EVENT = _struct(event_id="s", memory_id="s", operation="s", source_device="s", source_version="s", target_version="s", timestamp="s", status="s")
CONFLICT = T.StructType([
    *_struct(conflict_id="s", memory_id="s", edge_version="s", cloud_version="s", conflict_type="s").fields,
    T.StructField("jev_recommendation", _struct(verdict="s", rationale="s")),
    *_struct(status="s", resolution="s", resolved_by="s", recommended_by_verdict="s", updated_at="s", resolved_at="s", resolution_winner="s").fields,
])
LEDGER = _struct(memory_id="s", fingerprint="s")
#: An entry of the review queue: both records as they were when it was queued.
REVIEW = T.StructType([*_struct(review_id="s", memory_id="s", queued_at="s", status="s").fields, T.StructField("memory", MEMORY), T.StructField("verdict_record", VERDICT)])
