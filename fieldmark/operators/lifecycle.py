"""The two state machines and the routing of memories by verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas as S


def transitions(spark: SparkSession) -> DataFrame:
    """The legal steps as a relation (kind, from_status, to_status)."""
    rows = [("lifecycle", a, b) for a, bs in S.LIFECYCLE_STEPS.items() for b in bs] + [("jev", a, b) for a, bs in S.EVAL_STEPS.items() for b in bs]
    return spark.createDataFrame(rows, "kind string, from_status string, to_status string")


def is_legal(kind: str, source: Column, target: Column) -> Column:
    """Whether a step is legal; unknown and null statuses have none."""
    steps = S.LIFECYCLE_STEPS if kind == "lifecycle" else S.EVAL_STEPS
    legal = F.lit(False)
    for a, bs in steps.items():
        if bs:
            legal = legal | ((source == a) & target.isin(*bs))
    return F.coalesce(legal, F.lit(False))


def checked_step(kind: str, source: Column, target: Column) -> Column:
    """The target of a legal step; an illegal one raises."""
    return F.when(is_legal(kind, source, target), target).otherwise(F.raise_error(F.concat(F.lit(f"illegal {kind} step: "), F.coalesce(source, F.lit("null")), F.lit(" to "), F.coalesce(target, F.lit("null")))))


def initial_status(memory_type: Column) -> dict[str, Column]:
    """Manuals are stored and trusted from the start; what technicians write starts new and pending."""
    manual = memory_type == "manual"
    return {"lifecycle_status": F.when(manual, "local").when(memory_type.isin(*S.MEMORY_TYPES), "new"), "jev_status": F.when(manual, "not_applicable").when(memory_type.isin(*S.MEMORY_TYPES), "pending")}


#: Defaults of captured records: type, importance, confidence.
CAPTURE = {"observation": ("field_observation", 0.4, 0.5), "note": ("session_note", 0.3, 0.5), "manual": ("manual", 0.9, 1.0)}


def capture(rows: DataFrame, kind: str, *, now: str) -> DataFrame:
    """Memory records of ``rows(content, asset_id, source[, importance, confidence, version])``; ids are hashes of what identifies them."""
    memory_type, importance, confidence = CAPTURE[kind]
    has = {c for c in rows.columns}
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    status = initial_status(F.lit(memory_type))
    return rows.select(
        F.concat(F.lit("mem-"), F.sha2(F.concat_ws("\x00", F.lit(memory_type), "asset_id", "source", "content", F.lit(now)), 256)).alias("memory_id"),
        F.lit(memory_type).alias("memory_type"), "content", "asset_id", "source", given("version", "1").alias("version"), given("importance", importance).alias("importance"), given("confidence", confidence).alias("confidence"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit("local").alias("sync_status"), status["lifecycle_status"].alias("lifecycle_status"), status["jev_status"].alias("jev_status"), F.lit(None).cast("string").alias("revision_of"),
    )


def route(verdict: Column, *, expire: Column | None = None, update_of: Column | None = None) -> tuple[Column, Column]:
    """(action, error) of a memory row under a verdict: expiry first, then revision, then the verdict's own rules.

    Actions: EXPIRE, UPDATE, SYNC, KEEP_LOCAL; null where the error says why there is none.
    """
    kind, life = F.col("memory_type"), F.col("lifecycle_status")
    expire = F.coalesce(expire, F.lit(False)) if expire is not None else F.lit(False)
    update = update_of.isNotNull() if update_of is not None else F.lit(False)
    blank = update & ~update_of.rlike(r"\S") if update_of is not None else F.lit(False)
    error = (
        F.when(~F.coalesce(verdict.isin(*S.VERDICTS), F.lit(False)), "unknown verdict")
        .when(expire & (kind == "manual"), "manuals are not expired")
        .when(expire, None)
        .when(blank, "blank parent")
        .when(update & (kind == "session_note"), "session notes are not revised")
        .when(update & (life == "expired"), "expired memories are not revised")
        .when(update, None)
        .when(verdict.isin(*S.CLOUD_VERDICTS), "cloud verdict at the edge")
    )
    syncs = (verdict == "accept_local") & ~kind.isin("session_note", "manual") & ~life.isin("synced", "sync_pending") & (F.col("importance") >= S.SYNC_THRESHOLD)
    action = F.when(error.isNotNull(), None).when(expire, "EXPIRE").when(update, "UPDATE").when(syncs, "SYNC").otherwise("KEEP_LOCAL")
    return action, error


def apply_route(routed: DataFrame) -> DataFrame:
    """``routed(lifecycle_status, jev_status, action, verdict)`` after its action, with ``transitions`` in order and ``error``.

    EXPIRE of an expired record does nothing; KEEP_LOCAL and SYNC acknowledge a new record, take the verdict of a pending one, and
    SYNC then makes it sync_pending. A step that is not legal leaves the record as it was, and says so.
    """
    life, judged, action = F.col("lifecycle_status"), F.col("jev_status"), F.col("action")
    keeps = action.isin("KEEP_LOCAL", "SYNC")
    first = F.when((action == "EXPIRE") & (life != "expired"), F.lit("expired")).when(keeps & (life == "new"), F.lit("local"))
    after = F.coalesce(first, life)
    judge = F.when(keeps & (judged == "pending") & F.col("verdict").isin(*S.EDGE_VERDICTS), F.col("verdict"))
    last = F.when((action == "SYNC") & (after != "sync_pending"), F.lit("sync_pending"))
    legal = (first.isNull() | is_legal("lifecycle", life, first)) & (judge.isNull() | is_legal("jev", judged, judge)) & (last.isNull() | is_legal("lifecycle", after, last))
    said = lambda kind, a, b: F.when(b.isNotNull(), F.concat(F.lit(f"{kind} "), a, F.lit(" → "), b))
    steps = F.filter(F.array(said("lifecycle", life, first), said("jev", judged, judge), said("lifecycle", after, last)), lambda t: t.isNotNull())
    return routed.withColumns({
        "error": F.when(~legal, "illegal step"),
        "transitions": F.when(legal, steps).otherwise(F.array().cast("array<string>")),
        "new_lifecycle": F.when(legal, F.coalesce(last, after)).otherwise(life),
        "new_jev": F.when(legal, F.coalesce(judge, judged)).otherwise(judged),
    }).drop("lifecycle_status", "jev_status").withColumnsRenamed({"new_lifecycle": "lifecycle_status", "new_jev": "jev_status"})


def effective(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``stored`` with ``verdict``, ``rationale``, ``verdict_confidence`` of ``verdicts(memory_id, verdict, rationale, confidence)``. A memory
    without one, or with a blank rationale, gets needs_more_evidence at confidence 0, and the rationale says why."""
    v = verdicts.groupBy("memory_id").agg(F.max_by(F.struct("verdict", "rationale", "confidence"), F.struct(F.coalesce("confidence", F.lit(0.0)), "verdict", "rationale")).alias("__v"))
    rows = stored.join(v, "memory_id", "left")
    said = F.coalesce(F.col("__v.rationale").rlike(r"\S"), F.lit(False))
    why = F.when(F.col("__v").isNull(), "nobody evaluated this memory").otherwise("the evaluation gave no reason")
    return rows.withColumns({
        "verdict": F.when(said, F.col("__v.verdict")).otherwise("needs_more_evidence"),
        "rationale": F.when(said, F.trim(F.col("__v.rationale"))).otherwise(why),
        "verdict_confidence": F.when(said, F.coalesce(F.col("__v.confidence"), F.lit(0.0))).otherwise(0.0),
    }).drop("__v")


def route_stored(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``stored`` after the routes of their verdicts (:func:`effective`): action, ``route_error`` where there is none, transitions and new
    statuses. A memory that cannot be routed stays as it was stored."""
    judged = effective(stored, verdicts)
    action, error = route(F.col("verdict"))
    routed = apply_route(judged.withColumns({"action": action, "route_error": error}))
    return routed.withColumn("error", F.coalesce("route_error", "error")).drop("route_error")


def capture_and_route(rows: DataFrame, kind: str, evaluate: Callable[[DataFrame], DataFrame], *, now: str) -> tuple[DataFrame, DataFrame]:
    """(stored, routed): records are captured first, whatever becomes of their evaluation; ``evaluate`` gives verdicts on them
    (:func:`effective`), by which they are routed."""
    stored = capture(rows, kind, now=now)
    return stored, route_stored(stored, evaluate(stored))


def revise(revisions: DataFrame, memories: DataFrame, *, now: str) -> tuple[DataFrame, DataFrame]:
    """(stored, refused) of ``revisions(update_of, content[, importance, confidence, ...])``: a whole record for each revision under a new id
    with its lineage and the parent's version plus one, in the first statuses of its type; or ``error``. Parents are never changed."""
    kept = [c for c in revisions.columns if c not in {"update_of", *S.MEMORY.names}]
    inherited = ("memory_type", "asset_id", "source", "version", "lifecycle_status", "importance", "confidence")
    parent = memories.select(F.col("memory_id").alias("update_of"), *[F.col(c).alias(f"p_{c}") for c in inherited])
    joined = revisions.join(parent, "update_of", "left")
    error = (
        F.when(F.col("p_memory_type").isNull(), "no such parent").when(~F.col("p_memory_type").isin("manual", "field_observation"), "parent is not revisable")
        .when(F.col("p_lifecycle_status") == "expired", "parent is expired").when(~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)), "blank content")
    )
    checked = joined.withColumn("error", error)
    number = F.col("p_version").try_cast("double")
    first = initial_status(F.col("p_memory_type"))
    own = lambda c: F.coalesce(F.col(c), F.col(f"p_{c}")) if c in revisions.columns else F.col(f"p_{c}")
    made = {
        "memory_id": F.concat(F.lit("mem-"), F.sha2(F.concat_ws("\x00", "update_of", "content", "p_version"), 256)), "memory_type": F.col("p_memory_type"), "content": F.trim("content"), "asset_id": F.col("p_asset_id"), "source": F.col("p_source"),
        "version": F.when(number.isNotNull() & ~F.isnan(number), (number + 1).cast("long").cast("string")).otherwise("1"), "importance": own("importance"), "confidence": own("confidence"),
        "created_at": F.lit(now), "updated_at": F.lit(now), "sync_status": F.lit("local"), "lifecycle_status": first["lifecycle_status"], "jev_status": first["jev_status"], "revision_of": F.col("update_of"),
    }
    stored = checked.where("error is null").select(*[c.alias(k) for k, c in made.items()], *kept)
    return stored, checked.where("error is not null").select("update_of", "error")


def revise_and_route(revisions: DataFrame, memories: DataFrame, evaluate: Callable[[DataFrame], DataFrame], *, now: str) -> tuple[DataFrame, DataFrame]:
    """(routed, refused): revisions are stored as new versions (action UPDATE) and then routed like any other memory by their own verdicts;
    ``verdict_route`` is that route's action."""
    stored, refused = revise(revisions, memories, now=now)
    return route_stored(stored, evaluate(stored)).withColumnRenamed("action", "verdict_route").withColumn("action", F.lit("UPDATE")), refused


def mark_used(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """``memories`` with ``used_error`` and the new status of those in ``evidence(memory_id)``: new and local ones become used; used
    ones stay; manuals and other states are refused. The evaluation status is never touched."""
    hit = evidence.select("memory_id").distinct().withColumn("__hit", F.lit(True))
    rows = memories.join(hit, "memory_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    life = F.col("lifecycle_status")
    error = F.when(F.col("__hit") & (F.col("memory_type") == "manual"), "manuals are not marked").when(F.col("__hit") & ~life.isin("new", "local", "used"), "illegal step")
    return rows.withColumns({"used_error": error, "lifecycle_status": F.when(F.col("__hit") & error.isNull(), "used").otherwise(life)}).drop("__hit")


def mark_sync_pending(memories: DataFrame) -> DataFrame:
    """Each memory's status if marked for sync: the step from its own, or null where that is not legal; pending ones stay."""
    life = F.col("lifecycle_status")
    return memories.withColumn("marked", F.when(life == "sync_pending", life).when(is_legal("lifecycle", life, F.lit("sync_pending")), "sync_pending"))
