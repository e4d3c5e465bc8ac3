"""Listings of stored records in the order in which people read them; each is a top-k without a sort of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

LIMIT = 100


def _first(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The first ``limit`` rows with ``position`` from 1. Only these are numbered in one task."""
    return rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(W.orderBy(*order)))


def audit_trail(events: DataFrame, *, memory_id: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Sync events, newest first, of one memory or of all."""
    rows = events.where(F.col("memory_id") == memory_id) if memory_id is not None else events
    return _first(rows, limit, F.desc("timestamp"), "event_id")


def open_conflicts(conflicts: DataFrame, *, memory_id: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Open conflicts by id, of one memory or of all."""
    rows = conflicts.where("status = 'open'")
    return _first(rows.where(F.col("memory_id") == memory_id) if memory_id is not None else rows, limit, "conflict_id")


def conflict_by_id(conflicts: DataFrame, conflict_id: str) -> DataFrame:
    return conflicts.where(F.col("conflict_id") == conflict_id)


def open_reviews(entries: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """Open entries of the review queue, oldest first."""
    return _first(entries.where("status = 'open'"), limit, "queued_at", "review_id")
