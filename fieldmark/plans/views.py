"""Deterministic views of the driver tables as knowledge records.

Each view is one list of expressions in SQL that both engines read, but for the names in braces; so the oracle starts from the
same rows by construction, and what it checks is the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ids of vectors up to which they are broadcast.
VECTORS = 2_000_000

SPARK = {"str": "string", "arr": "array", "sha": "sha2({}, 256)", "nul": "char(0)"}
DUCK = {"str": "varchar", "arr": "list_value", "sha": "sha256({})", "nul": "chr(0)"}


def _sha(dialect: dict[str, str], content: str) -> str:
    joined = f"concat_ws({dialect['nul']}, memory_id, {content}, coalesce(revision_of, ''), version)"
    return dialect["sha"].format(joined)


def _chunks(d: dict[str, str]) -> list[str]:
    return [
        f"'chunk-' || lpad(cast(doc_id as {d['str']}), 9, '0') AS id",
        f"'doc-' || cast(doc_id - doc_id % 4 as {d['str']}) AS document_id",
        f"cast(1 + doc_id % 12 as {d['str']}) AS version",
        "text AS content",
        f"'MSN' || cast(4400 + doc_id % 20 as {d['str']}) AS asset_id",
        "CASE doc_id % 6 WHEN 0 THEN 'hydraulic' WHEN 1 THEN 'electrical' WHEN 2 THEN 'avionics' WHEN 3 THEN 'pump' WHEN 4 THEN 'valve' ELSE 'filter' END AS component",
        "CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'bulletin' WHEN 2 THEN 'procedure' ELSE 'report' END AS doc_type",
        "CASE doc_id % 3 WHEN 0 THEN 'A320' WHEN 1 THEN 'B737' END AS equipment_model",
        "source",
        f"{d['arr']}('ERR-' || cast(4000 + doc_id % 50 as {d['str']}), 'PN-' || cast(600 + doc_id % 30 as {d['str']})) AS keywords",
        f"CASE WHEN doc_id % 5 <> 0 THEN {d['arr']}('MSN' || cast(4400 + doc_id % 20 as {d['str']}), 'fleet-' || cast(doc_id % 2 as {d['str']})) END AS applicability",
        "CASE WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'not_applicable' END AS jev_status",
        "CASE WHEN doc_id % 9 <> 0 THEN cast(doc_id % 101 as double) / cast(100 as double) END AS importance",
        f"'2024-01-' || lpad(cast(1 + doc_id % 28 as {d['str']}), 2, '0') || 'T00:00:00Z' AS created_at",
        f"'2024-02-' || lpad(cast(1 + doc_id % 28 as {d['str']}), 2, '0') || 'T00:00:00Z' AS updated_at",
        "doc_id AS n",
    ]


def _memories(d: dict[str, str]) -> list[str]:
    return [
        f"'mem-' || lpad(cast(event_id as {d['str']}), 9, '0') AS memory_id",
        "CASE event_id % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'session_note' ELSE 'field_observation' END AS memory_type",
        "event_type || ' ' || props AS content",
        f"'MSN' || cast(4400 + user_id % 20 as {d['str']}) AS asset_id",
        f"'device-' || cast(user_id % 7 as {d['str']}) AS source",
        f"cast(1 + event_id % 5 as {d['str']}) AS version",
        "cast(event_id % 101 as double) / cast(100 as double) AS importance",
        "cast(event_id % 89 as double) / cast(100 as double) AS confidence",
        f"'2024-03-' || lpad(cast(1 + event_id % 28 as {d['str']}), 2, '0') || 'T00:00:00Z' AS created_at",
        f"'2024-04-' || lpad(cast(1 + event_id % 28 as {d['str']}), 2, '0') || 'T00:00:00Z' AS updated_at",
        "CASE event_id % 8 WHEN 3 THEN 'sync_pending' WHEN 4 THEN 'synced' ELSE 'local' END AS sync_status",
        "CASE event_id % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'local' WHEN 2 THEN 'used' WHEN 3 THEN 'sync_pending' WHEN 4 THEN 'synced' WHEN 5 THEN 'sync_pending' WHEN 6 THEN 'expired' ELSE 'conflict' END AS lifecycle_status",
        "CASE event_id % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_more_evidence' WHEN 2 THEN 'accept_local' WHEN 3 THEN 'accept_local' WHEN 4 THEN 'validated' WHEN 5 THEN 'flag_risk' WHEN 6 THEN 'rejected' ELSE 'flag_risk' END AS jev_status",
        f"CASE WHEN event_id % 11 = 0 AND event_id > 20 THEN 'mem-' || lpad(cast(event_id - 7 as {d['str']}), 9, '0') END AS revision_of",
        "event_id AS n",
    ]


_RAW = """CASE event_id % 6
 WHEN 0 THEN '{"verdict": "accept_local", "rationale": "matches the manual", "confidence": 0.8, "risk_flags": []}'
 WHEN 1 THEN 'Here it is: {"verdict": "flag_risk", "rationale": " pressure too high ", "confidence": 7, "risk_flags": [" leak ", "", 3]} - done.'
 WHEN 2 THEN '{"verdict": "accept_local", "rationale": "  ", "confidence": 0.9, "risk_flags": ["x"]}'
 WHEN 3 THEN '{"verdict": "approved", "rationale": "fine", "confidence": 0.4, "risk_flags": ["y"]}'
 WHEN 4 THEN 'I cannot tell.'
 ELSE '{"verdict": "validated", "rationale": "seen on three aircraft", "confidence": -2, "risk_flags": ["z"]}' END AS raw"""


def _selects(d: dict[str, str]) -> dict[str, tuple[str, list[str], str]]:
    """view: (from, expressions, where), in order of dependence."""
    return {
        "chunks": ("documents", _chunks(d), ""),
        "memories": ("events", _memories(d), ""),
        "ledger": ("memories", ["memory_id", f"CASE WHEN n % 5 = 0 THEN {_sha(d, chr(39) + 'older ' + chr(39) + ' || content')} ELSE {_sha(d, 'content')} END AS fingerprint"], "n % 3 <> 0"),
        "cloud_memories": ("memories", ["memory_id", "memory_type", "CASE WHEN n % 7 = 0 THEN content || ' [cloud]' ELSE content END AS content", "asset_id", "source", "version", "importance", "confidence", "created_at", "updated_at", "sync_status", "lifecycle_status", "jev_status", "revision_of", "n"], "n % 4 <> 0"),
        "verdict_raw": ("events", [f"'mem-' || lpad(cast(event_id as {d['str']}), 9, '0') AS memory_id", _RAW, "event_id AS n"], ""),
        "chunk_vec": ("chunks c JOIN embeddings e ON e.vec_id = c.n % (SELECT count(*) FROM embeddings)", ["c.*", "e.embedding"], ""),
        # Searches ask what users said in every twentieth conversation, and something to look up.
        "questions": ("conversations", ["conv_id * 1000 + turn AS query_id", "conv_id", f"""text || CASE (conv_id + turn * 20) % 100 WHEN 0 THEN ' what does ERR-' || cast(4000 + (conv_id + turn) % 50 as {d['str']}) || ' mean' WHEN 20 THEN ' why is the pump noisy'
 WHEN 40 THEN ' procedure for PN-' || cast(600 + (conv_id + turn) % 30 as {d['str']}) || ' and the valve' WHEN 60 THEN ' it leaks again' ELSE ' check error ' || cast(4000 + (conv_id + turn) % 50 as {d['str']}) || ' on the filter' END AS text""",
            f"CASE (conv_id + turn * 20) % 80 WHEN 0 THEN NULL WHEN 20 THEN 'MSN' || cast(4400 + turn % 20 as {d['str']}) WHEN 40 THEN 'MSN9999' ELSE 'MSN4410' END AS scope", "conv_id + turn AS n"], "role = 'user' AND conv_id % 20 = 0 AND turn IS NOT NULL"),
        "turns": ("conversations", ["conv_id AS session_id", "turn AS seq", "text || CASE conv_id % 5 WHEN 0 THEN ' check the fuel system on aircraft MSN 4453' WHEN 1 THEN CASE WHEN turn < 3 THEN ' the pumps on rig R-77' ELSE ' it again' END WHEN 2 THEN '' WHEN 3 THEN ' replaced the old filter and reset the breaker' ELSE ' landing gear, unit id TX-9' END AS text"], "role = 'user'"),
    }


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables in ``sf_dir``. ``chunk_texts``: chunks that have a vector, without it, so that texts do not travel."""
    selects = _selects(SPARK)
    if name == "chunk_texts":
        chunks, vectors = spark_view(spark, sf_dir, "chunks"), spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
        n = vectors.count()
        return chunks.join(F.broadcast(vectors) if n <= VECTORS else vectors, F.col("vec_id") == F.col("n") % n).drop("vec_id")
    if name == "chunk_vec":
        chunks, emb = spark_view(spark, sf_dir, "chunks"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return chunks.join(emb, emb.vec_id == chunks.n % emb.count()).select(chunks["*"], "embedding")
    if name not in selects:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, expressions, where = selects[name]
    rows = spark_view(spark, sf_dir, source)
    return (rows.where(where) if where else rows).selectExpr(*expressions)


def duck_views(*names: str) -> str:
    """The WITH clause of the views named and those they need, for the oracle."""
    selects = _selects(DUCK)
    needs = {"ledger": ["memories"], "cloud_memories": ["memories"], "chunk_vec": ["chunks"]}
    order: list[str] = []
    for n in names:
        order += [x for x in [*needs.get(n, []), n] if x not in order]
    parts = []
    for n in order:
        source, expressions, where = selects[n]
        parts.append(f"{n} AS (SELECT {', '.join(expressions)} FROM {source}{' WHERE ' + where if where else ''})")
    return "WITH " + ",\n".join(parts)
