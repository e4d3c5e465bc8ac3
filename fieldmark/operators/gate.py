"""The fleet gate: what a cloud verdict sets in motion, the review queue, and conflicts decided by people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CLOUD_VERDICTS, MEMORY, WINNERS
from .lifecycle import is_legal
from .sync import NO_RECOMMENDATION


def can_propagate(verdict: Column) -> Column:
    """Only exactly ``validated``; null never."""
    return F.coalesce(verdict == "validated", F.lit(False))


def gate_action(verdict: Column) -> Column:
    """propagate, review or hold_local; whatever is not known is held."""
    return F.when(can_propagate(verdict), "propagate").when(verdict == "needs_human_review", "review").otherwise("hold_local")


def apply_cloud_verdicts(memories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``memories`` joined with ``verdicts(memory_id, verdict)``: ``action``, the new ``jev_status`` (by legal steps only, a rejection
    where it is held) and ``error`` for verdicts that are not the cloud's."""
    v = verdicts.select("memory_id", "verdict")
    rows = memories.join(v, "memory_id")
    known = F.coalesce(F.col("verdict").isin(*CLOUD_VERDICTS), F.lit(False))
    legal = is_legal("jev", F.col("jev_status"), F.col("verdict"))
    return rows.withColumns({
        "action": F.when(known, gate_action(F.col("verdict"))),
        "error": F.when(~known, "not a cloud verdict").when(~legal & (F.col("jev_status") != F.col("verdict")), "illegal step"),
        "jev_status": F.when(known & legal, F.col("verdict")).otherwise(F.col("jev_status")),
    })


def fleet_effects(memories: DataFrame, verdicts: DataFrame, *, now: str) -> DataFrame:
    """What cloud verdicts write: a row for each record and the store that it goes to (``store``: cloud_memories, edge_memories).

    A validated memory goes to both, synced; a rejected one stays at the edge as history; a step that is not legal, a verdict that is not
    the cloud's and one that asks for a person write nothing here.
    """
    judged = apply_cloud_verdicts(memories, verdicts).where("error is null and action in ('propagate', 'hold_local')")
    goes = F.when(F.col("action") == "propagate", F.array(F.lit("cloud_memories"), F.lit("edge_memories"))).otherwise(F.array(F.lit("edge_memories")))
    written = {"sync_status": F.when(F.col("action") == "propagate", "synced").otherwise(F.col("sync_status")), "updated_at": F.lit(now)}
    return judged.select(F.explode(goes).alias("store"), "action", *[written.get(c, F.col(c)).alias(c) for c in MEMORY.names])


def latest_verdicts(verdicts: DataFrame, *, stage: str) -> DataFrame:
    """The last verdict of a stage on each memory."""
    rows = verdicts.where(F.col("stage") == stage)
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct("evaluated_at", "verdict_id"))
    return rows.groupBy("memory_id").agg(last.alias("v")).select("v.*")


def recommendations(conflicts: DataFrame, cloud: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conflict_id, verdict, rationale, verdict_id) for open conflicts that nobody has recommended anything on: the last cloud verdict on
    their memory, which must be in the cloud."""
    waiting = conflicts.where((F.col("status") == "open") & (F.col("jev_recommendation.rationale") == NO_RECOMMENDATION)).select("conflict_id", "memory_id")
    known = waiting.join(cloud.select("memory_id"), "memory_id", "left_semi")
    return known.join(latest_verdicts(verdicts, stage="cloud").select("memory_id", "verdict", "rationale", "verdict_id"), "memory_id").drop("memory_id")


def review_queue(memories: DataFrame, verdicts: DataFrame, *, now: Column) -> DataFrame:
    """An open entry, with both records as they are now, for each memory whose verdict asks for a person; listed by
    :func:`fieldmark.operators.listing.open_reviews`."""
    m = memories.select("memory_id", F.struct(*[F.col(c) for c in memories.columns]).alias("memory"))
    v = verdicts.where("verdict = 'needs_human_review'").select("memory_id", now.alias("queued_at"), F.struct(*[F.col(c) for c in verdicts.columns]).alias("verdict_record"))
    return m.join(v, "memory_id").select(F.concat(F.lit("rev-"), "memory_id").alias("review_id"), "memory_id", "queued_at", F.lit("open").alias("status"), "memory", "verdict_record")


def recommend(conflicts: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Open conflicts take the recommendation of ``recommendations(conflict_id, verdict, rationale, verdict_id)`` if it is not blank;
    ``recommended`` says whether they did. Everything else stays, who recommended something earlier too."""
    r = recommendations.select("conflict_id", F.col("verdict").alias("__v"), F.col("rationale").alias("__r"), F.col("verdict_id").alias("__i"))
    rows = conflicts.join(r, "conflict_id", "left")
    good = F.coalesce((F.col("status") == "open") & F.col("__v").isin(*CLOUD_VERDICTS) & F.col("__r").rlike(r"\S"), F.lit(False))
    return rows.withColumns({
        "recommended": good,
        "jev_recommendation": F.when(good, F.struct(F.col("__v").alias("verdict"), F.col("__r").alias("rationale"))).otherwise(F.col("jev_recommendation")),
        "recommended_by_verdict": F.when(good, F.col("__i")).otherwise(_held(rows, "recommended_by_verdict")),
    }).drop("__v", "__r", "__i")


def _held(rows: DataFrame, column: str) -> Column:
    """A column of ``rows``, or nulls if they do not have it yet."""
    return F.col(column) if column in rows.columns else F.lit(None).cast("string")


def confirm(conflicts: DataFrame, decisions: DataFrame, *, now: str) -> DataFrame:
    """Conflicts after ``decisions(conflict_id, winner, resolution, resolved_by)``: the only way to resolved. A decision needs an open
    conflict with a real recommendation, a winner, and who decided what; else ``error`` says what is missing. What was decided earlier stays."""
    d = decisions.select("conflict_id", F.col("winner").alias("__w"), F.col("resolution").alias("__r"), F.col("resolved_by").alias("__b"), F.lit(True).alias("__d"))
    rows = conflicts.join(d, "conflict_id", "left")
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    error = (
        F.when(F.col("__d").isNull(), None).when(F.col("status") != "open", "not open").when(F.col("jev_recommendation.rationale") == NO_RECOMMENDATION, "no recommendation yet")
        .when(~F.coalesce(F.col("__w").isin(*WINNERS), F.lit(False)), "winner must be edge or cloud").when(blank("__r"), "blank resolution").when(blank("__b"), "blank resolved_by")
    )
    done = F.col("__d").isNotNull() & F.col("error").isNull()
    return rows.withColumn("error", error).withColumns({
        "status": F.when(done, "resolved").otherwise(F.col("status")), "resolution": F.when(done, F.col("__r")).otherwise(F.col("resolution")), "resolved_by": F.when(done, F.col("__b")).otherwise(F.col("resolved_by")),
        "resolution_winner": F.when(done, F.col("__w")).otherwise(_held(rows, "resolution_winner")), "resolved_at": F.when(done, F.lit(now)).otherwise(_held(rows, "resolved_at")),
    }).drop("__w", "__r", "__b", "__d")
