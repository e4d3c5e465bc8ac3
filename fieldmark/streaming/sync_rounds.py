"""Sync rounds as a stream: each micro-batch of edge memories is stored, and what it touches is then reconciled with the cloud.

The edge's memories, the ledger, the cloud's memories and conflicts are keyed collections, the audit trail and what was refused are only
appended to, under the batch's name. They are written in an order in which a round that was lost is run again in whole: a memory in the
ledger is not uploaded twice, and an event is in the trail before its memory is in the cloud. A diverged memory is withheld, so it comes up
in every round until it is resolved; a refused one rides the next round's delta.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators import gate, lifecycle, sync
from ..operators.validate import insist, split_valid
from ..sources.scratch import hadoop_path
from ..sources.store import Collection, Trail

#: A memory that broke its contract when it was to be stored, and in what.
REFUSED = T.StructType([*S.MEMORY.fields, T.StructField("errors", T.ArrayType(T.StringType()))])
OPEN = T.StructType([T.StructField("memory_id", T.StringType())])


class SyncRounds:
    """The stores of one device and the cloud under ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, device: str, part_bytes: int = 128 << 20) -> None:
        def kept(name: str, schema, key: str, contract: str | None = None, **options) -> Collection:
            return Collection(spark, root, name, schema, key, check=partial(insist, contract=contract) if contract else None, part_bytes=part_bytes, **options)

        self.spark, self.root, self.device = spark, root.rstrip("/"), device
        self.edge = kept("edge_memories", S.MEMORY, "memory_id", "memory", sorted_by=("asset_id",))
        self.ledger = kept("ledger", S.LEDGER, "memory_id")
        self.cloud = kept("cloud_memories", S.MEMORY, "memory_id", "memory", sorted_by=("asset_id",))
        self.conflicts = kept("conflicts", S.CONFLICT, "conflict_id", "conflict")
        self.verdicts = kept("verdicts", S.VERDICT, "verdict_id", "verdict")
        self.reviews = kept("review_queue", S.REVIEW, "review_id")
        #: Ids that a round left undone: withheld, refused by the cloud, or not to be adopted.
        self.open = kept("open", OPEN, "memory_id")
        self.events = Trail(spark, root, "sync_events", S.SYNC_EVENT, "event_id", check=partial(insist, contract="sync_event"))
        self.refused = Trail(spark, root, "refused", REFUSED, "memory_id")

    def run(self, memories: DataFrame | None = None, *, now: str, expire: DataFrame | None = None, batch: str | None = None, touched_only: bool = False) -> dict[str, int]:
        """Store ``memories``, if any, and run one round (:func:`fieldmark.operators.sync.plan_round`); how many were refused before anything
        was stored, uploaded, rejected, adopted, withheld as conflicts, found alike and expired.

        Memories that break their contract are not stored but kept in ``refused``, with their errors. With ``touched_only`` the round is over
        the ids given, and those that an earlier round left undone, and reads only their partitions; else over all, which also finds what
        only the cloud changed.
        """
        batch, refused = batch or now, 0
        keys = None
        if memories is not None:
            good, bad = split_valid(memories.select(*S.MEMORY.names), "memory")
            bad = bad.persist()
            try:
                refused = bad.count()
                if refused:
                    self.refused.append(bad, batch)
            finally:
                bad.unpersist()
            self.edge.put(good)
            keys = good.select("memory_id")
        if touched_only:
            asked = [x.select("memory_id") for x in (keys, expire) if x is not None]
            ids = self.open.read()
            for x in asked:
                ids = ids.union(x)
            ids = ids.distinct()
            stores = self.edge.pick(ids), self.ledger.pick(ids), self.cloud.pick(ids)
        else:
            stores = self.edge.read(), self.ledger.read(), self.cloud.read()
        # Written: what it was made from is overwritten below.
        path = f"{self.root}/_round-{uuid.uuid4().hex}"
        sync.plan_round(*stores, expire).write.parquet(path)
        try:
            plan = self.spark.read.parquet(path)
            n = lambda outcome, name: F.count_if(F.col("outcome") == outcome).alias(name)
            counts = plan.agg(n("upload", "uploaded"), n("reject", "rejected"), n("adopt", "adopted"), n("conflict", "conflicts"), n("dedupe", "deduped"), n("expire", "expired")).first().asDict()
            after = sync.edge_after(plan, now=now)
            stuck = after.where("adopt_error is not null").select("memory_id")
            # A store is only touched by what there is of its kind.
            if counts["uploaded"] or counts["expired"]:
                applied = plan.where("outcome IN ('upload', 'expire')")
                self.events.append(sync.sync_events(applied, device=self.device, now=now), batch)
            if counts["uploaded"]:
                self.cloud.put(plan.where("outcome = 'upload'").select("m.*"))
            if counts["expired"]:
                self.cloud.delete(plan.where("outcome = 'expire'").select("memory_id"))
            if counts["conflicts"]:
                diverged = plan.where("outcome = 'conflict'").withColumn("kase", F.lit("DIVERGED"))
                none = [F.lit(None).cast("string").alias(c) for c in ("recommended_by_verdict", "resolved_at", "resolution_winner")]
                found = sync.conflict_records(diverged, now=now).select("*", *none)
                # A conflict found again stays as it is: someone may have recommended something on it.
                self.conflicts.put(found.join(self.conflicts.pick(found).select("conflict_id"), "conflict_id", "left_anti"))
            # The edge's steps come before the ledger, which comes last: a round lost before it is run again in whole.
            if counts["uploaded"] or counts["adopted"]:
                self.edge.put(after.where("adopt_error is null").select(*S.MEMORY.names))
            undone = plan.where("outcome IN ('conflict', 'reject')").select("memory_id").union(stuck).distinct()
            if self.open.parts():
                self.open.delete(plan.select("memory_id").join(undone, "memory_id", "left_anti"))
            if counts["conflicts"] or counts["rejected"] or counts["adopted"]:
                self.open.put(undone)
            if counts["uploaded"] or counts["deduped"] or counts["adopted"]:
                self.ledger.put(sync.ledger_after(plan).join(stuck, "memory_id", "left_anti"))
            return {"refused": refused, **counts}
        finally:
            found, fs = hadoop_path(self.spark, path)
            fs.delete(found, True)

    def judge(self, verdicts: DataFrame, *, now: str) -> None:
        """Store cloud verdicts and what the last on each memory sets in motion: validated memories go to cloud and edge, rejected ones stay at
        the edge, the others wait in the review queue; open conflicts on their memories take them as recommendations."""
        self.verdicts.put(verdicts)
        last = gate.latest_verdicts(verdicts, stage="cloud")
        path = f"{self.root}/_verdicts-{uuid.uuid4().hex}"
        memories = self.cloud.pick(last)
        gate.fleet_effects(memories, last, now=now).write.parquet(f"{path}/effects")
        gate.review_queue(memories.select(*S.MEMORY.names), last.select(*S.VERDICT.names), now=F.lit(now)).write.parquet(f"{path}/reviews")
        try:
            effects = self.spark.read.parquet(f"{path}/effects")
            for name, store in (("cloud_memories", self.cloud), ("edge_memories", self.edge)):
                store.put(effects.where(F.col("store") == name).select(*S.MEMORY.names))
            self.reviews.put(self.spark.read.parquet(f"{path}/reviews"))
        finally:
            found, fs = hadoop_path(self.spark, path)
            fs.delete(found, True)
        conflicts = self.conflicts.read()
        advised = gate.recommend(conflicts, gate.recommendations(conflicts, self.cloud.read(), self.verdicts.read()))
        self.conflicts.put(advised.where("recommended").withColumn("updated_at", F.lit(now)).select(*S.CONFLICT.names))

    def capture(self, rows: DataFrame, kind: str, evaluate: Callable[[DataFrame], DataFrame], *, now: str) -> DataFrame:
        """Store captured records, then route them by their verdicts and store that; the routed rows."""
        stored, routed = lifecycle.capture_and_route(rows, kind, evaluate, now=now)
        self.edge.put(stored)
        self.edge.put(routed.select(*S.MEMORY.names))
        return routed

    def stream(self, memories: DataFrame, checkpoint: str, *, now: str) -> StreamingQuery:
        """Run a round for each micro-batch of a stream of memory records, over the ids in it and those left undone. What only the cloud
        changed is found by a round over all (:meth:`run` without ``touched_only``), to be run now and then."""

        def each(rows: DataFrame, number: int) -> None:
            self.run(rows.persist(), now=now, batch=f"stream-{number}", touched_only=True)
            rows.unpersist()

        return memories.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
