import re

import pytest
from pyspark.sql import functions as F

from fieldmark import schemas as S
from fieldmark.config import ConfigError, load_config
from fieldmark.functions.verdicts import coerce, generate_with, json_object_exact, recover, stub_verdicts
from fieldmark.operators import answer, filters, gate, lifecycle, provision, session, sync, validate
from fieldmark.operators.evaluate import evaluate
from fieldmark.sources.ingest import ingest, store_documents
from fieldmark.sources.store import Collection, Trail, newest, replace_documents
from fieldmark.streaming.session_state import session_stream
from fieldmark.streaming.sync_rounds import SyncRounds

BASE = dict(memory_id="m", memory_type="field_observation", content="c", asset_id="a", source="s", version="1", importance=0.8, confidence=0.5, created_at="2024-01-01T00:00:00Z", updated_at="2024-01-01T00:00:00Z", sync_status="local", lifecycle_status="used", jev_status="accept_local", revision_of=None)


def memories(spark, *patches):
    return spark.createDataFrame([{**BASE, **p} for p in patches], S.MEMORY)


def test_all_errors_come_at_once(spark):
    rows = memories(spark, {}, dict(content=" ", created_at="soon", importance=float("nan"), memory_type="x"))
    good, bad = [r.errors for r in validate.validate(rows, "memory").collect()]
    assert good == [] and len(bad) == 4


def test_unknown_fields(spark):
    row = spark.createDataFrame([('{"memory_id": "m", "colour": 1}',)], "raw string")
    assert row.select(validate.unknown_fields(F.col("raw"), "memory")).first()[0] == ["colour"]


@pytest.mark.parametrize(("e", "c", "b", "case"), [("", "", "", "IDENTICAL"), ("x", "x", "", "IDENTICAL"), ("x", "", "", "EDGE_NEW"), ("", "x", "", "CLOUD_NEWER"), ("x", "y", "", "DIVERGED"), ("x", "y", "z", "DIVERGED"), ("x", "y", "x", "CLOUD_NEWER"), ("x", "y", "y", "EDGE_NEW")])
def test_version_cases(spark, e, c, b, case):
    assert spark.range(1).select(sync.version_case(F.lit(e), F.lit(c), F.lit(b))).first()[0] == case


def test_step_counts_and_strict_steps(spark):
    assert lifecycle.transitions(spark).groupBy("kind").count().collect() and sum(map(len, S.LIFECYCLE_STEPS.values())) == 19 and sum(map(len, S.EVAL_STEPS.values())) == 17
    with pytest.raises(Exception, match="illegal lifecycle step"):
        spark.range(1).select(lifecycle.checked_step("lifecycle", F.lit("expired"), F.lit("local"))).collect()


def test_routing(spark):
    rows = memories(spark, dict(memory_id="high", lifecycle_status="new", jev_status="pending"), dict(memory_id="low", importance=0.69, lifecycle_status="new"), dict(memory_id="note", memory_type="session_note"), dict(memory_id="done", lifecycle_status="synced"))
    action, error = lifecycle.route(F.lit("accept_local"))
    routed = rows.withColumns({"action": action, "verdict": F.lit("accept_local")})
    assert {r.memory_id: r.action for r in routed.collect()} == {"high": "SYNC", "low": "KEEP_LOCAL", "note": "KEEP_LOCAL", "done": "KEEP_LOCAL"}
    high = lifecycle.apply_route(routed.where("memory_id = 'high'")).first()
    assert high.transitions == ["lifecycle new → local", "jev pending → accept_local", "lifecycle local → sync_pending"] and high.sync_status == "local"
    assert rows.select(lifecycle.route(F.lit("validated"))[1]).first()[0]


def test_filters_refuse_what_they_do_not_know():
    with pytest.raises(ValueError):
        filters.metadata_filter({"colour": "red"})
    for target, cap in (({}, 5), ({"asset_id": " "}, 5), ({"asset_id": "a"}, 0), ({"job_terms": [""]}, 5), ({"colour": "x"}, 5)):
        with pytest.raises(ValueError):
            filters.selection_filter(target, cap)


def test_selection_never_leaks_and_says_truncated(spark):
    rows = spark.createDataFrame([(f"c{i:02}", "doc", "1", "torque text", "a", "pump", "s", "not_applicable" if i % 5 else "pending", i / 31) for i in range(30)], "id string, document_id string, version string, content string, asset_id string, component string, source string, jev_status string, importance double")
    got = provision.select_knowledge(rows, {"component": "pump"}, max_chunks=10).collect()
    assert [r.id for r in got][:2] == ["c29", "c28"] and all(r.jev_status == "not_applicable" for r in got) and len(got) == 10
    assert provision.summary(rows, {"component": "pump"}, max_chunks=10).first().truncated


def test_json_recovery_and_coercion(spark):
    assert recover('x {"a": 1} y } z') == '{"a": 1}' and recover("[1]") is None and recover('{"a": {"b": 1}') is None
    texts = ['```json\n{"verdict": "flag_risk", "rationale": "r", "confidence": 7, "risk_flags": ["a", 1, " "]}\n```', "none", '{"verdict": "flag_risk", "rationale": " "}', 'ok {"verdict": "accept_local", "rationale": "r", "confidence": "0.5"} } tail']
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("j", json_object_exact(F.col("raw")))
    got = df.select(*[c.alias(k) for k, c in coerce(F.col("j"), "edge").items()]).collect()
    assert [(r.verdict, r.confidence, r.risk_flags) for r in got] == [("flag_risk", 1.0, ["a"]), ("needs_more_evidence", 0.0, []), ("needs_more_evidence", 0.0, []), ("accept_local", 0.0, [])]
    assert all(r.rationale.strip() for r in got)


def test_only_validated_propagates(spark):
    words = ["validated", "Validated", "VALIDATED ", "accept_local", "needs_human_review", "rejected", "", None]
    rows = spark.createDataFrame([(w,) for w in words], "v string").select(gate.can_propagate(F.col("v")), gate.gate_action(F.col("v"))).collect()
    assert [r[0] for r in rows] == [True] + [False] * 7 and [r[1] for r in rows][4:6] == ["review", "hold_local"]


NONE = dict(refused=0, uploaded=0, rejected=0, adopted=0, conflicts=0, deduped=0, expired=0)


@pytest.mark.parametrize("touched_only", [True])
def test_rounds_settle_and_conflicts_are_withheld(spark, tmp_path, touched_only):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    run = lambda *rows, now: rounds.run(memories(spark, *rows) if rows else None, now=now, touched_only=touched_only)
    # A record stored before there was a contract.
    Collection(spark, str(tmp_path), "edge_memories", S.MEMORY, "memory_id").put(memories(spark, dict(memory_id="d", asset_id=" ")))
    rounds.open.put(spark.createDataFrame([("d",)], "memory_id string"))
    first = run(dict(memory_id="a"), dict(memory_id="b", jev_status="needs_more_evidence"), dict(memory_id="c", jev_status="flag_risk"), dict(memory_id="e", asset_id=" "), now="2024-02-01T00:00:00Z")
    assert first == NONE | dict(refused=1, uploaded=2, rejected=1)
    edge = {r.memory_id: (r.lifecycle_status, r.sync_status) for r in rounds.edge.read().collect()}
    assert edge == {"a": ("synced", "synced"), "b": ("used", "local"), "c": ("synced", "synced"), "d": ("used", "local")}
    assert [(r.memory_id, r.errors) for r in rounds.refused.read().collect()] == [("e", ["asset_id: blank"])]
    # A memory that the cloud refused rides the next round's delta, of which nothing was sent anew.
    assert run(now="2024-02-02T00:00:00Z") == NONE | dict(rejected=1)
    assert run(dict(memory_id="d"), now="2024-02-02T00:00:00Z") == NONE | dict(uploaded=1)
    rounds.cloud.put(memories(spark, dict(memory_id="a", content="theirs")))
    assert run(dict(memory_id="a", content="ours"), now="2024-02-03T00:00:00Z") == NONE | dict(conflicts=1)
    assert run(now="2024-02-04T00:00:00Z") == NONE | dict(conflicts=1)
    assert rounds.cloud.get("a").first().content == "theirs" and rounds.edge.get("a").first().content == "ours"
    found = rounds.conflicts.read().collect()
    assert len(found) == 1 and found[0].updated_at == "2024-02-03T00:00:00Z" and rounds.events.read().count() == 3
    with pytest.raises(Exception, match="asset_id: blank"):
        rounds.edge.put(memories(spark, dict(memory_id="f", asset_id=" ")))
    assert rounds.edge.get("f").count() == 0 and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_a_round_over_few_ids_reads_only_their_partitions(spark, tmp_path):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    rows = memories(spark, *[dict(memory_id=f"m{i:04}", content=f"text {i}") for i in range(600)])
    rounds.run(rows, now="2024-02-01T00:00:00Z")
    assert rounds.edge.parts() == 8 and rounds.cloud.read().count() == 600
    picked = rounds.cloud.pick(spark.createDataFrame([("m0007",), ("m0009",)], "memory_id string"))
    pruned = re.search(r"PartitionFilters: \[([^\]]*)\]", picked._jdf.queryExecution().executedPlan().toString())
    assert picked.count() == 2 and "part#" in pruned[1] and len(rounds.cloud._touched(picked, 8)) <= 2
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "cloud_memories").rglob("*.parquet")}
    assert rounds.run(memories(spark, dict(memory_id="m0007", content="new")), now="2024-02-02T00:00:00Z", touched_only=True) == NONE | dict(uploaded=1)
    same = {p.name for p in (tmp_path / "cloud_memories").rglob("*.parquet")} & set(untouched)
    assert len(same) >= len(untouched) - 1 and rounds.cloud.get("m0007").first().content == "new"


def test_the_trail_is_only_appended_to(spark, tmp_path):
    """Bytes of a batch do not grow with the trail, and a batch given again adds nothing."""
    trail = Trail(spark, str(tmp_path), "events", S.SYNC_EVENT, "event_id")
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert trail.read().count() == 0
    grown = []
    for i in range(4):
        rows = spark.createDataFrame([(f"e{i}-{k}", "m", "create", "d", "1", "2", "2024-01-01T00:00:00Z", "applied") for k in range(50)], S.SYNC_EVENT)
        before = size()
        trail.append(rows, f"2024:{i}")
        grown.append(size() - before)
        trail.append(rows.limit(20), f"2024:{i}")
        assert trail.read().count() == 50 * (i + 1) and size() - before == grown[-1]
    assert max(grown) < 1.2 * min(grown)


def test_of_rows_with_one_key_the_newest_stays(spark):
    rows = [dict(memory_id="a", content=f"{i}", updated_at=f"2024-01-0{1 + i % 3}T00:00:00Z", version=str(8 + i % 4)) for i in range(60)] + [dict(memory_id="a", content="tie", updated_at="2024-01-03T00:00:00Z", version="11")] * 3
    kept = {tuple(newest(memories(spark, *rows).repartition(n), "memory_id").first()) for n in (1, 2, 3, 5, 8, 13)}
    assert len(kept) == 1 and {(r[5], r[9]) for r in kept} == {("11", "2024-01-03T00:00:00Z")}


def test_a_scan_for_one_asset_reads_few_rows(spark, tmp_path):
    """Rows that the scan gives out, by its own metric, fall with the asset's share."""
    c = Collection(spark, str(tmp_path), "memories", S.MEMORY, "memory_id", parts=1, sorted_by=("asset_id",), page_rows=200)
    c.put(spark.range(20_000).select(*[(F.concat(F.lit("m"), "id") if k == "memory_id" else F.concat(F.lit("a"), F.col("id") % 50) if k == "asset_id" else F.lit(v).cast(S.MEMORY[k].dataType)).alias(k) for k, v in BASE.items()]).select(*S.MEMORY.names))

    def scanned(df):
        df.collect()
        nodes, total = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if "Scan" in node.nodeName():
                total += node.metrics().apply("numOutputRows").value()
            kids = node.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
            if "AdaptiveSparkPlan" in node.nodeName():
                nodes.append(node.executedPlan())
        return total

    one = c.read().where("asset_id = 'a7'")
    assert scanned(c.read()) >= 20_000 and one.count() == 400 and scanned(one) <= 2_000


def test_rounds_adopt_what_only_the_cloud_changed(spark, tmp_path):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    rounds.run(memories(spark, dict(memory_id="a"), dict(memory_id="b"), dict(memory_id="c"), dict(memory_id="s")), now="2024-02-01T00:00:00Z")
    rounds.cloud.put(memories(spark, dict(memory_id="a", content="corrected", lifecycle_status="synced", sync_status="synced"), dict(memory_id="b", content="stuck", lifecycle_status="expired"), dict(memory_id="c", content="back", lifecycle_status="conflict")))
    rounds.edge.delete(["c"])
    rounds.cloud.put(memories(spark, dict(memory_id="s", content="same")))
    got = rounds.run(memories(spark, dict(memory_id="s", content="same")), now="2024-02-02T00:00:00Z")
    assert got == NONE | dict(adopted=3, deduped=1)
    edge = {r.memory_id: (r.content, r.lifecycle_status, r.updated_at[:10]) for r in rounds.edge.read().collect()}
    # The cloud's record of b cannot step to synced, so the edge keeps its own; c, which the edge no longer had, is the cloud's as it is.
    assert edge["a"] == ("corrected", "synced", "2024-02-02") and edge["b"][0] == "c" and edge["c"] == ("back", "conflict", "2024-01-01")
    assert rounds.run(now="2024-02-03T00:00:00Z") == NONE | dict(adopted=1)


def test_rounds_expire_what_was_synced(spark, tmp_path):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    rounds.run(memories(spark, dict(memory_id="a"), dict(memory_id="b", jev_status="needs_more_evidence"), dict(memory_id="x")), now="2024-02-01T00:00:00Z")
    rounds.cloud.put(memories(spark, dict(memory_id="x", content="theirs")))
    rounds.edge.put(memories(spark, dict(memory_id="x", content="ours")))
    gone = spark.createDataFrame([("a",), ("a",), ("b",), ("nobody",), ("x",)], "memory_id string")
    # Never synced, unknown and diverged memories are not expired.
    assert rounds.run(now="2024-02-02T00:00:00Z", expire=gone) == NONE | dict(expired=1, conflicts=1)
    assert {r.memory_id for r in rounds.cloud.read().collect()} == {"x"} and {r.operation for r in rounds.events.read().collect()} == {"create", "expire"}


def test_cloud_verdicts_reach_the_stores(spark, tmp_path):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    rounds.run(memories(spark, *[dict(memory_id=m) for m in "abcx"]), now="2024-02-01T00:00:00Z")
    rounds.cloud.put(memories(spark, dict(memory_id="x", content="theirs")))
    rounds.run(memories(spark, dict(memory_id="x", content="ours")), now="2024-02-02T00:00:00Z")
    verdicts = spark.createDataFrame([(f"v-{m}", m, "cloud", v, "seen twice", 0.9, [], [], "m", "2024-02-03T00:00:00Z") for m, v in (("a", "validated"), ("b", "rejected"), ("c", "needs_human_review"), ("x", "validated"))], S.VERDICT)
    rounds.judge(verdicts, now="2024-02-03T00:00:00Z")
    cloud, edge = ({r.memory_id: r.jev_status for r in c.read().collect()} for c in (rounds.cloud, rounds.edge))
    assert (cloud["a"], cloud["b"], cloud["c"]) == ("validated", "accept_local", "accept_local") and (edge["a"], edge["b"], edge["c"]) == ("validated", "rejected", "accept_local")
    (entry,) = rounds.reviews.read().collect()
    assert entry.memory_id == "c" and entry.memory.content == "c" and entry.verdict_record.verdict_id == "v-c"
    (conflict,) = rounds.conflicts.read().collect()
    assert conflict.status == "open" and conflict.jev_recommendation.verdict == "validated" and conflict.recommended_by_verdict == "v-x"
    rounds.run(now="2024-02-04T00:00:00Z")
    assert rounds.conflicts.read().first().recommended_by_verdict == "v-x" and rounds.verdicts.read().count() == 4


def test_capture_is_stored_whatever_becomes_of_its_evaluation(spark, tmp_path):
    rounds = SyncRounds(spark, str(tmp_path), device="edge-1")
    rows = spark.createDataFrame([("loose bolt", "a", "s", 0.9), ("odd noise", "a", "s", 0.1)], "content string, asset_id string, source string, importance double")
    routed = rounds.capture(rows, "observation", lambda stored: stub_verdicts(stored, now="x").where("false"), now="2024-02-01T00:00:00Z")
    assert {(r.verdict, r.action, r.rationale) for r in routed.collect()} == {("needs_more_evidence", "KEEP_LOCAL", "nobody evaluated this memory")}
    assert {(r.lifecycle_status, r.jev_status) for r in rounds.edge.read().collect()} == {("local", "needs_more_evidence")}


def test_provisioning_is_repeatable_and_replaces_documents(spark, tmp_path):
    vectors = [[float(i), 1.0] for i in range(8)]
    rows = [(f"c{i}", f"d{i % 3}", None if i == 0 else "2", "torque text", "a", "pump", "s", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", vectors[i], "not_applicable") for i in range(8)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, version string, content string, asset_id string, component string, source string, created_at string, updated_at string, embedding array<double>, jev_status string").withColumn("importance", F.lit(0.5))
    edge = Collection(spark, str(tmp_path), "chunks", S.CHUNK, "id", check=lambda df: validate.insist(df, "chunk"))
    edge.put(spark.createDataFrame([("old", "d1", "1", "outdated", [1.0, 1.0], "a", "pump", "s", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", None, None, None, None, None)], S.CHUNK))
    for _ in range(2):
        report = provision.provision_device(chunks, {"component": "pump"}, edge)
        assert (report["transferred"], report["documents"], report["total_available"], report["truncated"]) == (8, 3, 8, False)
        assert {r.id: list(r.embedding) for r in edge.read().collect()} == {f"c{i}": vectors[i] for i in range(8)}
    assert edge.get("c0").first().version == "1"
    assert provision.provision_device(chunks, {"component": "valve"}, edge)["transferred"] == 0 and edge.read().count() == 8
    with pytest.raises(Exception, match="embedding: no list"):
        provision.provision_device(chunks.withColumn("embedding", F.lit(None).cast("array<double>")), {"component": "pump"}, edge)
    assert edge.read().count() == 8


def test_sync_stream(spark, tmp_path):
    memories(spark, dict(memory_id="a"), dict(memory_id="b")).write.parquet(str(tmp_path / "in"))
    rounds = SyncRounds(spark, str(tmp_path / "state"), device="edge-1")
    stream = spark.readStream.schema(S.MEMORY).parquet(str(tmp_path / "in"))
    rounds.stream(stream, str(tmp_path / "checkpoint"), now="2024-02-01T00:00:00Z").awaitTermination(120)
    assert {r.memory_id for r in rounds.cloud.read().collect()} == {"a", "b"}


def test_session_stream_agrees_with_windows(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "pumps on rig R-77"), (1, 1, "and again?"), (1, 2, "the filter now"), (2, 0, "hello")], "session_id long, seq long, text string")
    turns.write.parquet(str(tmp_path / "in"))
    q = session_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    columns = ["session_id", "seq", "asset_id", "component"]
    assert sorted(map(str, spark.table("sessions").select(*columns).collect())) == sorted(map(str, session.context_at(turns).select(*columns).collect()))


def test_ingest_is_repeatable_and_replaces_documents(spark):
    docs = spark.createDataFrame([("d1", "One. " * 100, "a", "pump", "s"), ("d2", "Two.", "a", "pump", "s")], "document_id string, text string, asset_id string, component string, source string")
    first, again = (ingest(docs, now="2024-01-01T00:00:00Z", cloud=True, max_chars=120, overlap_chars=0) for _ in range(2))
    assert sorted(r.id for r in first.collect()) == sorted(r.id for r in replace_documents(first, again).collect())
    assert validate.validate(first, "chunk").where(F.size("errors") > 0).count() == 0


def test_collection_versions(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "memories", S.MEMORY, "memory_id", check=lambda df: validate.insist(df, "memory"))
    assert c.read().count() == 0 and not c.delete(["a"])
    c.put(memories(spark, dict(memory_id="a"), dict(memory_id="b")))
    c.put(memories(spark, dict(memory_id="b", content="new")))
    assert {r.memory_id: r.content for r in c.read().collect()} == {"a": "c", "b": "new"}
    assert c.delete(["a"]) and not c.delete(["a"])
    assert [r.memory_id for r in c.read().collect()] == ["b"] and c.get("b").count() == 1 and c.get("a").count() == 0
    with pytest.raises(ValueError):
        c.delete([])
    with pytest.raises(Exception, match="content: blank"):
        c.put(memories(spark, dict(memory_id="z", content=" ")))
    assert [r.memory_id for r in c.read().collect()] == ["b"]


def test_partitions_grow_with_rows_and_a_change_touches_few(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "memories", S.MEMORY, "memory_id", part_bytes=30_000)
    c.put(memories(spark, *[dict(memory_id=f"m{i}") for i in range(64)]))
    few = c.parts()
    c.put(memories(spark, *[dict(memory_id=f"m{i}", content=" ".join(str(hash((i, k))) for k in range(20))) for i in range(5000)]))
    many = c.parts()
    assert few == 8 and many >= 16 and c.read().count() == 5000 and len(list((tmp_path / "memories").iterdir())) == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "memories").rglob("*.parquet")}
    c.put(memories(spark, dict(memory_id="m7", content="new"), dict(memory_id="m8", content="new")))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "memories").rglob("*.parquet")}
    assert len(set(after.items()) - set(before.items())) <= 2 and c.read().count() == 5000 and c.get("m7").first().content == "new"
    assert c.delete([f"m{i}" for i in range(5000)]) and c.read().count() == 0 and c.get("m7").count() == 0
    with pytest.raises(Exception, match="a row without memory_id"):
        c.put(memories(spark, dict(memory_id=None)))


def test_documents_are_stored_in_place_of_their_former_chunks(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "chunks", S.CHUNK, "id")
    schema = "document_id string, text string, asset_id string, component string, source string"
    store_documents(spark.createDataFrame([("d1", "One. " * 100, "a", "pump", "s"), ("d2", "Two.", "a", "pump", "s")], schema), c, now="2024-01-01T00:00:00Z", max_chars=120, overlap_chars=0)
    store_documents(spark.createDataFrame([("d1", "Three.", "a", "pump", "s")], schema), c, now="2024-01-02T00:00:00Z")
    assert sorted((r.document_id, r.content) for r in c.read().collect()) == [("d1", "Three."), ("d2", "Two.")]
    # A document that is blank now has no chunks any more.
    store_documents(spark.createDataFrame([("d2", " \n", "a", "pump", "s")], schema), c, now="2024-01-02T00:00:00Z")
    assert [r.document_id for r in c.read().collect()] == ["d1"]
    store_documents(spark.createDataFrame([("d2", "Two.", "a", "pump", "s")], schema), c, now="2024-01-02T00:00:00Z")
    with pytest.raises(Exception, match="component: blank"):
        store_documents(spark.createDataFrame([("d1", "Four.", "a", " ", "s")], schema), c, now="2024-01-03T00:00:00Z")
    assert c.read().count() == 2


def test_a_batch_that_fails_is_asked_one_by_one(spark):
    def picky(prompts):
        if len(prompts) > 1 or prompts[0] == "bad":
            raise RuntimeError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    assert [r.raw for r in generate_with(df, "p", picky).collect()] == ["A", None, "C"]
    assert [r.raw for r in generate_with(df, "p", lambda ps: [str(len(ps))] * len(ps)).collect()] == ["3", "3", "3"]


def test_a_question_that_finds_nothing_is_put_without_excerpts(spark):
    chunks = spark.createDataFrame([], "id string, document_id string, version string, content string, asset_id string, component string, source string, equipment_model string, doc_type string, keywords array<string>, embedding array<double>")
    turns = spark.createDataFrame([(1, 0, "the pump on rig R-77")], "session_id long, seq long, text string")
    asked = session.states(turns).withColumns({"query_id": F.col("session_id"), "text": F.lit("is it tight?")})
    answers, _, cited = answer.answer(asked, chunks, lambda ps: ["none"] * len(ps))
    got = answers.first()
    assert (got.query, got.widened, got.used_context, got.answer) == ("is it tight? (pump, R-77)", False, True, "none") and "Excerpts: none" in got.prompt and "asset R-77" in got.prompt and cited.count() == 0


def test_evaluation_survives_a_failing_model(spark):
    ctx = memories(spark, {}).withColumns({"documents": F.expr("array(named_struct('id', 'd', 'source', 's', 'content', 'x'), named_struct('id', 'd', 'source', 's', 'content', 'y'))"), "observations": F.expr("array(named_struct('id', 'o', 'source', 's', 'content', 'x'))"), "history": F.expr("cast(array() as array<struct<verdict: string, rationale: string>>)")})

    def fails(_):
        raise RuntimeError

    edge = evaluate(ctx, fails, stage="edge", model="m", now="2024-01-01T00:00:00Z").first()
    cloud = evaluate(ctx, lambda p: ['{"verdict": "validated", "rationale": "r", "confidence": 0.9}'] * len(p), stage="cloud", model="m", now="2024-01-01T00:00:00Z").first()
    assert (edge.verdict, edge.confidence, edge.evidence_used) == ("needs_more_evidence", 0.0, ["d"]) and (cloud.verdict, cloud.evidence_used) == ("validated", ["o", "d", "d"])


def test_config(tmp_path):
    (tmp_path / "env").write_text("A=1\n# no\nB='two'\nC=file\n")
    got = load_config({"A": "0", "B": "0", "C": "0"}, env_file=tmp_path / "env", env={"C": "env"}, overrides={"A": " 9 "})
    assert dict(got) == {"A": "9", "B": "two", "C": "env"}
    with pytest.raises(ConfigError):
        load_config({}, required=("X",))
