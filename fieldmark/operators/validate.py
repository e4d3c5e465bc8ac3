"""Closed-world validators: each adds ``errors``, all that is wrong with a record at once, in the order of its fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S


def _need(field: str, c: Column | None = None) -> Column:
    c = F.col(field) if c is None else c
    return F.when(c.isNull(), F.lit(f"{field}: missing")).when(~c.rlike(r"\S"), F.lit(f"{field}: blank"))


def _enum(field: str, allowed: Sequence[str]) -> Column:
    return F.when(~F.coalesce(F.col(field).isin(*allowed), F.lit(False)), F.lit(f"{field}: none of {', '.join(allowed)}"))


def _finite(field: str) -> Column:
    c = F.col(field)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"{field}: no finite number"))


def _time(field: str, optional: bool = False) -> Column:
    bad = F.when(F.col(field).isNull() | F.try_to_timestamp(F.col(field)).isNull(), F.lit(f"{field}: no time"))
    return F.when(F.col(field).isNotNull(), bad) if optional else bad


def _strings(field: str, *, optional: bool = False, blank: bool = True) -> Column:
    c = F.col(field)
    good = F.forall(c, lambda x: x.isNotNull() & (F.lit(blank) | x.rlike(r"\S")))
    bad = F.when(c.isNull() | ~good, F.lit(f"{field}: no list of {'texts' if blank else 'texts that are not blank'}"))
    return F.when(c.isNotNull(), bad) if optional else bad


def _optional(field: str, check: Column) -> Column:
    return F.when(F.col(field).isNotNull(), check)


MEMORY = lambda: [
    _need("memory_id"), _enum("memory_type", S.MEMORY_TYPES), _need("content"), _need("asset_id"), _need("source"), _need("version"), _finite("importance"), _finite("confidence"),
    _time("created_at"), _time("updated_at"), _enum("sync_status", S.SYNC_STATUSES), _enum("lifecycle_status", S.LIFECYCLE_STATUSES), _enum("jev_status", S.EVAL_STATUSES), _optional("revision_of", _need("revision_of")),
]
VERDICT = lambda: [
    _need("verdict_id"), _need("memory_id"), _enum("stage", S.STAGES), _enum("verdict", S.VERDICTS), _need("rationale"), _finite("confidence"), _strings("risk_flags"), _strings("evidence_used"), _need("model_used"), _time("evaluated_at"),
]
SYNC_EVENT = lambda: [
    _need("event_id"), _need("memory_id"), _enum("operation", S.OPERATIONS), _need("source_device"), _need("source_version"), _need("target_version"), _time("timestamp"), _need("status"),
]


def CHUNK() -> list[Column]:  # noqa: N802
    v = F.col("embedding")
    vector = F.when(v.isNull() | ~F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit("embedding: no list of finite numbers"))
    return [
        _need("id"), _need("document_id"), _need("version"), _need("content"), vector, _need("asset_id"), _need("component"), _need("source"),
        _strings("applicability", optional=True, blank=False), _strings("keywords", optional=True, blank=False), _optional("jev_status", _enum("jev_status", S.EVAL_STATUSES)), _time("created_at"), _time("updated_at"),
    ]


def CONFLICT() -> list[Column]:  # noqa: N802
    resolved = F.col("status") == "resolved"
    r = F.col("jev_recommendation")
    return [
        _need("conflict_id"), _need("memory_id"), _need("edge_version"), _need("cloud_version"), _need("conflict_type"),
        F.when(r.isNull(), F.lit("jev_recommendation: missing")), F.when(r.isNotNull(), _need("jev_recommendation.verdict", r["verdict"])), F.when(r.isNotNull(), _need("jev_recommendation.rationale", r["rationale"])),
        _enum("status", S.CONFLICT_STATUSES), F.when(resolved, _need("resolution")), F.when(resolved, _need("resolved_by")),
        _optional("recommended_by_verdict", _need("recommended_by_verdict")), _time("updated_at", True), _time("resolved_at", True), _optional("resolution_winner", _enum("resolution_winner", S.WINNERS)),
    ]


CONTRACTS = {"memory": MEMORY, "verdict": VERDICT, "chunk": CHUNK, "sync_event": SYNC_EVENT, "conflict": CONFLICT}


def error_list(contract: str) -> Column:
    return F.filter(F.array(*CONTRACTS[contract]()), lambda e: e.isNotNull())


def validate(df: DataFrame, contract: str) -> DataFrame:
    """``df`` with ``errors`` (empty if the record keeps the contract)."""
    return df.withColumn("errors", error_list(contract))


def split_valid(df: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """Records that keep the contract, and the others with their errors."""
    checked = validate(df, contract)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def insist(df: DataFrame, contract: str) -> DataFrame:
    """``df``; a record that breaks the contract raises when it is read."""
    wrong = F.array_join(error_list(contract), "; ")
    return df.where(F.when(wrong == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{contract} record breaks its contract: "), wrong)).cast("boolean")))


def unknown_fields(raw_json: Column, contract: str) -> Column:
    """Top-level keys of a JSON record that its contract does not know."""
    known = {"memory": S.MEMORY, "verdict": S.VERDICT, "chunk": S.CHUNK, "sync_event": S.SYNC_EVENT, "conflict": S.CONFLICT}[contract].names
    return F.array_except(F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
