"""The oracle: SQL for DuckDB, written apart from the operators, that must give the rows of the catalogue's queries."""

from __future__ import annotations

from ..functions.verdicts import CHECKS, CLOUD_VERDICTS, EDGE_VERDICTS, JUDGES
from .views import duck_views

SQL: dict[str, str] = {}

_FP = "sha256(concat_ws(chr(0), memory_id, content, coalesce(revision_of, ''), version))"


def _v(name: str, views: str, body: str) -> None:
    with_ = duck_views(*views.split()) if views else ""
    if with_ and body.lstrip().startswith(","):
        SQL[name] = with_ + body
    else:
        SQL[name] = f"{with_}\n{body}" if with_ else body


_v("vector_topk", "", """SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 12""")
_v("vector_topk_filtered", "chunk_vec", """SELECT id, component, doc_type, round(s, 6) AS score FROM (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 9) AS s FROM chunk_vec WHERE component = 'pump' AND doc_type = 'report') ORDER BY s DESC, id LIMIT 8""")
_v("cloud_search", "chunk_vec", """SELECT id, asset_id, round(s, 6) AS score FROM (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)), 9) AS s FROM chunk_vec WHERE asset_id = 'MSN4405') ORDER BY s DESC, id LIMIT 4""")
_v("scroll_filtered", "chunks", "SELECT id, asset_id, doc_type, component FROM chunks WHERE asset_id = 'MSN4407' AND (doc_type = 'report' OR component = 'electrical') ORDER BY id LIMIT 30")
_v("filter_any_overlap", "chunks", "SELECT id, array_to_string(applicability, '|') AS applicability FROM chunks WHERE list_has_any(applicability, ['MSN4403', 'fleet-1']) AND equipment_model = 'A320'")
_v("filter_text_all_tokens", "chunks", "SELECT id FROM chunks WHERE contains(lower(content), 'the') AND contains(lower(content), 'und')")
_v("filter_must_should_must_not", "chunks", "SELECT id, component, equipment_model FROM chunks WHERE jev_status = 'not_applicable' AND component IN ('pump', 'valve') AND equipment_model IS DISTINCT FROM 'A320'")

_IS_ID = """length(t) >= 3 AND ((regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]')) OR (regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[-_./]')) OR (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 AND length(t) >= 5))"""
_v("identifier_tokens", "", f"""WITH raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda x: regexp_replace(x, '[.,;:]+$', '')) AS tokens FROM documents),
each AS (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM raw),
firsts AS (SELECT doc_id, t, min(i) AS i FROM each WHERE {_IS_ID} GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(f.t, '|' ORDER BY f.i), '') AS tokens FROM documents d LEFT JOIN firsts f USING (doc_id) GROUP BY d.doc_id""")

_HINTS = r"(?i)\b(?:err(?:or)?|code|pn|p/n|part|mpn|msg|fault|fail|procedure|proc|bulletin|sb|ad|tid|doc|docid|manual|amm|cmm|ipc|rev|step|assembly|assy)\b[-.:_ ]*\s*([a-z0-9][a-z0-9-]*)"


def _terms(name: str, source: str, key: str, text: str = "text") -> str:
    """The exact terms of the texts of ``source``, as the relation ``name(key, terms)``."""
    return rf"""{name}_l AS (SELECT {key}, list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda x: regexp_replace(x, '[.,;:]+$', '')), lambda t: {_IS_ID}) AS ids, list_filter(regexp_extract_all({text}, '{_HINTS}', 1), lambda h: length(h) >= 2 AND regexp_matches(h, '[0-9]')) AS hints FROM {source}),
{name}_d AS (SELECT {key}, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids, hints FROM {name}_l),
-- A hint counts unless an identifier, or a hint before it, holds it.
{name} AS (SELECT {key}, ids || list_filter(hints, lambda x, i: NOT coalesce(list_bool_or(list_transform(ids || hints[1:i - 1], lambda y: contains(lower(y), lower(x)))), false)) AS terms FROM {name}_d)"""


_SPLIT_TERMS = "list_filter(regexp_split_to_array(lower(array_to_string(terms, ' ')), '[^a-z0-9·]+'), lambda x: x <> '')"
_ASKED = f"{_terms('qterms', 'questions', 'query_id')}, asked AS (SELECT query_id, conv_id, n % (SELECT count(*) FROM embeddings) AS vec_id, scope, text, terms, {_SPLIT_TERMS} AS words FROM questions JOIN qterms USING (query_id))"
_HIT = "(list_bool_and(list_transform(words, lambda w: contains(lower(content), w))) OR list_bool_or(list_transform(keywords, lambda k: list_bool_and(list_transform(words, lambda w: contains(lower(k), w))))))"
_WHOLE = "list_filter(terms, lambda t: contains(lower(content), lower(t)) OR list_bool_or(list_transform(keywords, lambda k: contains(lower(k), lower(t)))))"


def _keyword(name: str, chunks: str, scope: str = "") -> str:
    return f"""{name}_hits AS (SELECT query_id, id, terms, content, keywords, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM {chunks}, asked WHERE len(terms) > 0 AND {_HIT}{scope}),
{name} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r) - 1 AS rank FROM {name}_hits WHERE r <= 12 AND len({_WHOLE}) > 0)"""


_v("keyword_leg", "chunks questions", f", {_ASKED}, {_keyword('k', 'chunks')} SELECT query_id, id, rank FROM k")
_v("rrf_fusion", "", """WITH legs AS (SELECT conv_id AS query_id, 's' AS leg, 'c' || turn AS id, turn AS rank, 1.0::DOUBLE AS w FROM conversations WHERE turn < 4
UNION ALL SELECT conv_id, 'k', 'c' || turn, 5 - turn, 1.2::DOUBLE FROM conversations WHERE turn BETWEEN 2 AND 5),
s AS (SELECT * FROM legs WHERE leg = 's'), k AS (SELECT * FROM legs WHERE leg = 'k')
SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.id, k.id) AS id, round(coalesce(s.w / (60 + s.rank + 1), 0) + coalesce(k.w / (60 + k.rank + 1), 0), 9) AS score, s.rank AS semantic_rank, k.rank AS keyword_rank FROM s FULL JOIN k ON s.query_id = k.query_id AND s.id = k.id""")
_v("dedupe_best_version", "chunks", """, r AS (SELECT asset_id AS query_id, component || '/' || doc_type AS id, coalesce(importance, 0) AS score, version, n AS place FROM chunks),
b AS (SELECT *, min(place) OVER (PARTITION BY query_id, id) AS first FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, version DESC, place) = 1)
SELECT query_id, id, score, version, place, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS position FROM b""")
_v("rerank_boosts", "chunks", f""", f AS (SELECT asset_id AS query_id, id, {_WHOLE.replace("terms", "['ERR-4012', 'PN-607']")} AS m, version, 1.0::DOUBLE / (61 + n % 40) AS score, CASE WHEN n % 3 <> 0 THEN n % 40 END AS sr, CASE WHEN n % 2 = 0 THEN n % 40 END AS kr, max(version) OVER (PARTITION BY asset_id) AS newest FROM chunks),
g AS (SELECT *, round(score + (CASE WHEN len(m) > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN version = newest THEN 0.1::DOUBLE ELSE 0 END), 9) AS final FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, sr ASC NULLS LAST, id) AS position FROM g)
SELECT query_id, position, id, final AS final_score, array_to_string(m, '|') AS matched FROM h WHERE position <= 6""")


def _hybrid(name: str, scope: str = "", extra: str = "") -> str:
    """Fused and reranked rows of each query, as the relation ``name``."""
    return f"""{name}_sem AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS rank FROM (SELECT query_id, c.id, round(list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s FROM chunk_vec c, asked JOIN embeddings e USING (vec_id) WHERE true{scope}{extra}) QUALIFY rank < 12),
{_keyword(name + '_kw', 'chunk_vec c', scope + extra)},
{name}_legs AS (SELECT query_id, id, rank AS sr, NULL::BIGINT AS kr, 1.0::DOUBLE / (61 + rank) AS s FROM {name}_sem
 UNION ALL SELECT query_id, id, NULL, rank, 1.2::DOUBLE / (61 + rank) FROM {name}_kw
 UNION ALL SELECT query_id, id, NULL, rank, 0.4::DOUBLE / (61 + rank) FROM {name}_sem JOIN asked USING (query_id) WHERE len(terms) = 0),
{name}_fused AS (SELECT query_id, id, min(sr) AS sr, min(kr) AS kr, sum(s) AS score FROM {name}_legs GROUP BY ALL),
{name}_all AS (SELECT f.*, c.document_id, c.source, c.version, c.asset_id, {_WHOLE} AS m, max(version) OVER (PARTITION BY query_id) AS newest FROM {name}_fused f JOIN chunk_vec c USING (id) JOIN asked USING (query_id)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score + (CASE WHEN len(m) > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN version = newest THEN 0.1::DOUBLE ELSE 0 END), 9) DESC, sr ASC NULLS LAST, id) AS position FROM {name}_all QUALIFY position <= 4)"""


_v("hybrid_retrieval", "chunk_vec questions", f", {_ASKED}, {_hybrid('h')} SELECT query_id, position, id, document_id, source, round(score, 6) AS score, sr AS semantic_rank, kr AS keyword_rank, version, array_to_string(m, '|') AS matched FROM h")
_v("fallback_unfiltered", "chunk_vec questions", f""", {_ASKED}, {_hybrid('h', ' AND (scope IS NULL OR c.asset_id = scope)')}, {_hybrid('w', '', ' AND query_id NOT IN (SELECT query_id FROM h)')}
SELECT query_id, position, id, asset_id, round(score, 6) AS score, false AS widened FROM h UNION ALL SELECT query_id, position, id, asset_id, round(score, 6), true FROM w""")
_v("citations", "chunks", """, r AS (SELECT asset_id AS q, n % 97 * 1000000 + n AS p, id, CASE WHEN n % 10 <> 0 THEN 'doc-' || (n % 60) END AS d, source, version FROM chunks),
g AS (SELECT q, coalesce('doc:' || d, 'chunk:' || id) AS k, min(p) AS first, arg_min(d, p) AS document_id, arg_min(source, p) AS source, arg_min(version, p) AS version, string_agg(id, '|' ORDER BY p) AS chunk_ids FROM r GROUP BY 1, 2)
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY first) AS position, document_id, source, version, chunk_ids FROM g""")


def _errors(*checks: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in checks) + ")"


_REQ, _BLANK = "{}: missing", "{}: blank"
_v("validate_memory", "memories", "SELECT memory_id, " + _errors(
    ("n % 17 = 0", 'memory_type: none of manual, field_observation, session_note'), ("n % 13 = 0", _BLANK.format("content")), ("n % 29 = 0", _REQ.format("asset_id")),
    ("n % 19 = 0", 'importance: no finite number'), ("n % 23 = 0", 'created_at: no time')) + " AS errors FROM memories")
_v("validate_chunk", "chunk_vec", "SELECT id, " + _errors(
    ("n % 13 = 0", 'embedding: no list of finite numbers'), ("n % 19 = 0", _BLANK.format("component")), ("n % 17 = 0", 'keywords: no list of texts that are not blank'),
    ("n % 23 = 0", 'jev_status: none of not_applicable, pending, accept_local, needs_more_evidence, flag_risk, validated, needs_human_review, rejected')) .replace("WHEN n % 13", "WHEN NOT regexp_matches(content, '\\S') THEN '" + _BLANK.format("content") + "' END, CASE WHEN n % 13", 1) + " AS errors FROM chunk_vec")
_v("validate_verdict", "memories", "SELECT memory_id, " + _errors(
    ("n % 13 = 0", 'stage: none of edge, cloud'), ("n % 17 = 0", 'verdict: none of accept_local, needs_more_evidence, flag_risk, validated, needs_human_review, rejected'),
    ("n % 7 = 0", _BLANK.format("rationale")), ("n % 19 = 0", 'risk_flags: no list of texts')) + " AS errors FROM memories")
_v("validate_event", "memories", "SELECT memory_id, " + _errors(
    ("n % 11 = 0", 'operation: none of create, update, expire'), ("n % 13 = 0", _BLANK.format("target_version")), ("n % 17 = 0", 'timestamp: no time')) + " AS errors FROM memories")
_v("validate_conflict", "memories", "SELECT memory_id, " + _errors(
    ("n % 13 = 0", _BLANK.format("cloud_version")), ("n % 17 = 0", 'jev_recommendation: missing'), ("n % 17 <> 0 AND n % 5 = 0", _BLANK.format("jev_recommendation.rationale")),
    ("n % 3 <> 0 AND n % 19 = 0", 'status: none of open, resolved'), ("n % 3 = 0 AND n % 2 <> 0", _BLANK.format("resolution")), ("n % 3 = 0 AND n % 7 = 0", _REQ.format("resolved_by")),
    ("n % 23 = 0", 'updated_at: no time'), ("n % 29 = 0", 'resolution_winner: none of edge, cloud')) + " AS errors FROM memories")

_v("fingerprint", "memories", f"SELECT memory_id, {_FP} AS fingerprint, substr({_FP}, 1, 12) AS label FROM memories")
_v("detect_changes", "memories ledger", f"SELECT m.memory_id, l.fingerprint IS NULL AS is_new FROM (SELECT *, {_FP} AS fp FROM memories) m LEFT JOIN ledger l USING (memory_id) WHERE fp IS DISTINCT FROM l.fingerprint")
_ELIGIBLE = "(memory_type = 'field_observation' AND lifecycle_status NOT IN ('new', 'expired', 'conflict', 'resolved') AND (jev_status = 'flag_risk' OR (jev_status = 'accept_local' AND lifecycle_status IN ('sync_pending', 'used', 'synced'))))"
_v("sync_eligible", "memories", f"SELECT memory_id, {_ELIGIBLE} AS eligible FROM memories")
_DELTA = f"delta AS (SELECT m.*, CASE WHEN l.fingerprint IS NULL THEN 'create' ELSE 'update' END AS operation, l.fingerprint AS base FROM (SELECT *, {_FP} AS fingerprint FROM memories) m LEFT JOIN ledger l USING (memory_id) WHERE m.fingerprint IS DISTINCT FROM l.fingerprint AND {_ELIGIBLE})"
_v("build_delta", "memories ledger", f", {_DELTA} SELECT memory_id, operation, fingerprint, jev_status = 'flag_risk' AS high_visibility FROM delta")
_v("expire_semi_join", "memories ledger", "SELECT memory_id, 'expire' AS operation, fingerprint FROM ledger WHERE memory_id IN (SELECT memory_id FROM memories WHERE n % 20 = 0)")


def _case(e: str, c: str, b: str) -> str:
    e, c, b = (f"coalesce({x}, '')" for x in (e, c, b))
    return f"CASE WHEN {e} = '' AND {c} = '' THEN 'IDENTICAL' WHEN {e} = {c} THEN 'IDENTICAL' WHEN {c} = '' THEN 'EDGE_NEW' WHEN {e} = '' THEN 'CLOUD_NEWER' WHEN {b} = '' THEN 'DIVERGED' WHEN {e} <> {b} AND {c} <> {b} THEN 'DIVERGED' WHEN {c} <> {b} THEN 'CLOUD_NEWER' WHEN {e} <> {b} THEN 'EDGE_NEW' ELSE 'DIVERGED' END"


_ALL = f"everyone AS (SELECT memory_id FROM memories WHERE n % 17 <> 0 UNION SELECT memory_id FROM ledger UNION SELECT memory_id FROM cloud_memories), classed AS (SELECT memory_id, {_case('e.fp', 'c.fp', 'l.fingerprint')} AS kase FROM everyone LEFT JOIN (SELECT memory_id, {_FP} AS fp FROM memories WHERE n % 17 <> 0) e USING (memory_id) LEFT JOIN (SELECT memory_id, {_FP} AS fp FROM cloud_memories) c USING (memory_id) LEFT JOIN ledger l USING (memory_id))"
_v("classify_versions", "memories ledger cloud_memories", f", {_ALL} SELECT memory_id, kase FROM classed")
_v("case_counts", "memories ledger cloud_memories", f", {_ALL} SELECT k.kase, count(c.memory_id) AS n FROM (VALUES ('IDENTICAL'), ('EDGE_NEW'), ('CLOUD_NEWER'), ('DIVERGED'), ('none')) k(kase) LEFT JOIN classed c USING (kase) GROUP BY 1")
_CLASSED = f"{_DELTA}, classed AS (SELECT d.*, c.fp AS cloud_fp, {_case('d.fingerprint', 'c.fp', 'd.base')} AS kase FROM delta d LEFT JOIN (SELECT memory_id, {_FP} AS fp FROM cloud_memories) c USING (memory_id))"
_v("reconcile_outcome", "memories ledger cloud_memories", f", {_CLASSED} SELECT count(*) FILTER (kase = 'EDGE_NEW') AS uploaded, count(*) FILTER (kase = 'CLOUD_NEWER') AS adopted, count(*) FILTER (kase = 'DIVERGED') AS conflicts, count(*) FILTER (kase = 'IDENTICAL') AS deduped FROM classed")
_v("conflict_records", "memories ledger cloud_memories", f", {_CLASSED} SELECT memory_id, substr(fingerprint, 1, 12) AS edge_version, substr(cloud_fp, 1, 12) AS cloud_version, 'version_divergence' AS conflict_type, 'open' AS status, 'needs_human_review' AS recommended FROM classed WHERE kase = 'DIVERGED'")
_REASON = """CASE WHEN n % 31 = 0 THEN 'item without memory_id' WHEN n % 13 = 0 THEN 'no such operation: merge' WHEN n % 8 = 5 THEN 'item without record' WHEN n % 9 = 0 THEN 'record of another memory_id' WHEN n % 5 = 0 THEN 'record breaks its contract: content: blank' END"""
_v("ingest_reject_reasons", "memories ledger", f", {_DELTA} SELECT n, {_REASON} AS reason FROM delta")
_v("sync_events", "memories ledger", f", {_DELTA} SELECT memory_id, operation, 'edge-1' AS source_device, '1' AS source_version, substr(fingerprint, 1, 12) AS target_version, '2025-01-01T00:00:00Z' AS timestamp, 'applied' AS status FROM delta WHERE ({_REASON}) IS NULL")
_v("ack_to_synced", "memories ledger", f", {_DELTA}, a AS (SELECT *, n % 3 <> 0 OR n % 6 = 3 AS acked FROM delta) SELECT memory_id, acked, CASE WHEN acked THEN 'synced' ELSE lifecycle_status END AS new_lifecycle, CASE WHEN acked THEN 'synced' ELSE sync_status END AS new_sync_status FROM a")

_v("capture_records", "memories", "SELECT 'mem-' || sha256(concat_ws(chr(0), 'field_observation', asset_id, source, content, '2025-01-01T00:00:00Z')) AS memory_id, 'field_observation' AS memory_type, 0.4::DOUBLE AS importance, 0.5::DOUBLE AS confidence, 'new' AS lifecycle_status, 'pending' AS jev_status, 'local' AS sync_status FROM memories")
_v("initial_status", "memories", "SELECT memory_id, CASE memory_type WHEN 'manual' THEN 'local' ELSE 'new' END AS life, CASE memory_type WHEN 'manual' THEN 'not_applicable' ELSE 'pending' END AS judged FROM memories")
_LIFE = "['new>local', 'new>expired', 'local>used', 'local>sync_pending', 'local>expired', 'local>conflict', 'used>sync_pending', 'used>expired', 'used>conflict', 'sync_pending>synced', 'sync_pending>conflict', 'synced>expired', 'synced>conflict', 'conflict>resolved', 'conflict>expired', 'resolved>local', 'resolved>used', 'resolved>sync_pending', 'resolved>expired']"
_JUDGED = "['not_applicable>pending', 'pending>accept_local', 'pending>needs_more_evidence', 'pending>flag_risk', 'pending>rejected', 'accept_local>validated', 'accept_local>flag_risk', 'accept_local>rejected', 'needs_more_evidence>accept_local', 'needs_more_evidence>flag_risk', 'needs_more_evidence>rejected', 'flag_risk>accept_local', 'flag_risk>validated', 'flag_risk>needs_human_review', 'flag_risk>rejected', 'needs_human_review>validated', 'needs_human_review>rejected']"
for _name, _column, _list in (("lifecycle_legal", "lifecycle_status", _LIFE), ("jev_legal", "jev_status", _JUDGED)):
    _v(_name, "memories", f", s AS (SELECT DISTINCT {_column} AS s FROM memories) SELECT a.s AS from_status, b.s AS to_status, list_contains({_list}, a.s || '>' || b.s) AS legal FROM s a, s b")
_v("transition_relation", "memories", f"""SELECT 'lifecycle' AS kind, split_part(s, '>', 1) AS from_status, split_part(s, '>', 2) AS to_status, (SELECT count(*) FROM memories WHERE lifecycle_status = split_part(s, '>', 1)) AS memories FROM (SELECT unnest({_LIFE}) AS s) UNION ALL SELECT 'jev', split_part(s, '>', 1), split_part(s, '>', 2), (SELECT count(*) FROM memories WHERE jev_status = split_part(s, '>', 1)) FROM (SELECT unnest({_JUDGED}) AS s)""")
_ROUTED = """v AS (SELECT *, CASE WHEN n % 23 = 0 THEN 'maybe' WHEN n % 19 = 0 THEN 'validated' WHEN n % 3 = 0 THEN 'flag_risk' WHEN n % 5 = 0 THEN 'needs_more_evidence' ELSE 'accept_local' END AS verdict, n % 11 = 0 AND revision_of IS NOT NULL AS upd FROM memories),
routed AS (SELECT *, CASE WHEN verdict = 'maybe' THEN NULL WHEN n % 7 = 0 THEN CASE WHEN memory_type <> 'manual' THEN 'EXPIRE' END
 WHEN upd THEN CASE WHEN memory_type <> 'session_note' AND lifecycle_status <> 'expired' THEN 'UPDATE' END WHEN verdict = 'validated' THEN NULL
 WHEN verdict = 'accept_local' AND memory_type = 'field_observation' AND lifecycle_status NOT IN ('synced', 'sync_pending') AND importance >= 0.7::DOUBLE THEN 'SYNC' ELSE 'KEEP_LOCAL' END AS action FROM v)"""
_v("route_memory", "memories", f", {_ROUTED} SELECT memory_id, action, action IS NULL AS refused FROM routed")
_v("apply_route", "memories", f""", {_ROUTED},
s1 AS (SELECT *, CASE WHEN action = 'EXPIRE' AND lifecycle_status <> 'expired' THEN 'expired' WHEN action IN ('KEEP_LOCAL', 'SYNC') AND lifecycle_status = 'new' THEN 'local' END AS a, CASE WHEN action IN ('KEEP_LOCAL', 'SYNC') AND jev_status = 'pending' THEN verdict END AS j FROM routed WHERE action IS NOT NULL),
s2 AS (SELECT *, CASE WHEN action = 'SYNC' AND coalesce(a, lifecycle_status) <> 'sync_pending' THEN 'sync_pending' END AS b FROM s1),
s3 AS (SELECT *, (a IS NULL OR list_contains({_LIFE}, lifecycle_status || '>' || a)) AND (j IS NULL OR list_contains({_JUDGED}, jev_status || '>' || j)) AND (b IS NULL OR list_contains({_LIFE}, coalesce(a, lifecycle_status) || '>' || b)) AS ok FROM s2)
SELECT memory_id, action, CASE WHEN ok THEN coalesce(b, a, lifecycle_status) ELSE lifecycle_status END AS lifecycle_status, CASE WHEN ok THEN coalesce(j, jev_status) ELSE jev_status END AS jev_status,
 CASE WHEN ok THEN concat_ws('|', 'lifecycle ' || lifecycle_status || ' → ' || a, 'jev ' || jev_status || ' → ' || j, 'lifecycle ' || coalesce(a, lifecycle_status) || ' → ' || b) ELSE '' END AS transitions, NOT ok AS illegal FROM s3""")
_REV = "w AS (SELECT n, CASE WHEN n % 5 = 0 THEN 'mem-none' ELSE revision_of END AS up, content || ' revised' AS c FROM memories WHERE revision_of IS NOT NULL), j AS (SELECT w.*, p.memory_type AS pt, p.lifecycle_status AS pl, p.version AS pv FROM w LEFT JOIN memories p ON p.memory_id = w.up)"
_v("revision_lineage", "memories", f", {_REV} SELECT n, up AS revision_of, (pv::INT + 1)::VARCHAR AS version, 'mem-' || sha256(concat_ws(chr(0), up, c, pv)) AS memory_id FROM j WHERE pt IN ('manual', 'field_observation') AND pl <> 'expired'")
_v("orphan_revisions", "memories", f", {_REV}, e AS (SELECT CASE WHEN pt IS NULL THEN 'no such parent' WHEN pt = 'session_note' THEN 'parent is not revisable' WHEN pl = 'expired' THEN 'parent is expired' END AS error FROM j) SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1")
_v("mark_used", "memories", ", u AS (SELECT *, n % 3 = 0 AND (memory_type = 'manual' OR lifecycle_status NOT IN ('new', 'local', 'used')) AS refused FROM memories) SELECT memory_id, CASE WHEN n % 3 = 0 AND NOT refused THEN 'used' ELSE lifecycle_status END AS lifecycle_status, refused FROM u")
_v("mark_sync_pending", "memories", f"SELECT memory_id, CASE WHEN lifecycle_status = 'sync_pending' OR list_contains({_LIFE}, lifecycle_status || '>sync_pending') THEN 'sync_pending' END AS marked FROM memories")

_SEL = "sel AS (SELECT *, round(coalesce(importance, 0.5::DOUBLE) * 10 + (contains(lower(content), 'the')::INT + contains(lower(content), 'und')::INT) + least(length(version), 4) * 0.05::DOUBLE, 9) AS p FROM chunks WHERE jev_status = 'not_applicable' AND component = 'pump' AND (contains(lower(content), 'the') OR contains(lower(content), 'und')))"
_v("select_knowledge", "chunks", f", {_SEL} SELECT row_number() OVER (ORDER BY p DESC, id) AS rank, id, document_id, round(p, 6) AS priority FROM sel QUALIFY rank <= 40")
_v("provision_summary", "chunks", f", {_SEL} SELECT count(*) AS total_available, least(count(*), 40) AS selected, count(*) > 40 AS truncated FROM sel")
_v("transfer_by_document", "chunks", ", s AS (SELECT document_id, row_number() OVER (ORDER BY round(coalesce(importance, 0.5::DOUBLE) * 10 + least(length(version), 4) * 0.05::DOUBLE, 9) DESC, id) AS r FROM chunks WHERE jev_status = 'not_applicable' AND component = 'pump' AND regexp_matches(content, '\\S') QUALIFY r <= 60) SELECT document_id, count(*) AS transferred, min(r) AS first_rank FROM s GROUP BY 1")
_v("keyed_upsert", "memories cloud_memories", ", new AS (SELECT memory_id, content, version FROM cloud_memories WHERE n % 7 = 0) SELECT memory_id, content, version FROM memories WHERE version <> '3' AND memory_id NOT IN (SELECT memory_id FROM new) UNION ALL SELECT * FROM new")
_v("delete_by_document", "chunks", "SELECT id, document_id FROM chunks WHERE document_id <> 'doc-8'")
_v("delete_by_ids", "memories", "SELECT memory_id FROM memories WHERE n % 4 <> 1")
_v("list_memories", "memories", "SELECT memory_id, updated_at FROM memories WHERE asset_id = 'MSN4403' ORDER BY updated_at DESC, memory_id LIMIT 25")

_JSON = "j AS (SELECT memory_id, n, try_cast(nullif(regexp_extract(raw, '(?s)\\{.*\\}', 0), '') AS JSON) AS o FROM verdict_raw), p AS (SELECT memory_id, o, json_extract_string(o, '$.verdict') AS v, trim(coalesce(json_extract_string(o, '$.rationale'), '')) AS r, least(1::DOUBLE, greatest(0::DOUBLE, json_extract_string(o, '$.confidence')::DOUBLE)) AS c, array_to_string(list_filter(list_transform(list_filter(json_extract(o, '$.risk_flags[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(json_extract_string(x, '$'))), lambda x: x <> ''), '|') AS f FROM j)"


def _coerce(allowed: str, fallback: str, keep: bool) -> str:
    good = f"coalesce(v IN ({allowed}) AND r <> '', false)"
    why = f"CASE WHEN o IS NULL THEN 'coerced: the model gave no JSON object' WHEN NOT coalesce(v IN ({allowed}), false) THEN 'coerced: no verdict of this stage' ELSE 'coerced: no rationale' END"
    flags = "coalesce(f, '')" if keep else f"CASE WHEN {good} THEN f ELSE '' END"
    return f", {_JSON} SELECT memory_id, CASE WHEN {good} THEN v ELSE '{fallback}' END AS verdict, CASE WHEN {good} THEN r ELSE {why} END AS rationale, CASE WHEN {good} THEN c ELSE 0 END AS confidence, {flags} AS flags FROM p"


_v("edge_coerce", "verdict_raw", _coerce("'accept_local', 'needs_more_evidence', 'flag_risk'", "needs_more_evidence", False))
_v("cloud_coerce", "verdict_raw", _coerce("'validated', 'needs_human_review', 'rejected'", "needs_human_review", True))
_CV = "cv AS (SELECT memory_id, CASE n % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'needs_human_review' WHEN 2 THEN 'rejected' WHEN 3 THEN 'accept_local' END AS verdict, 'because ' || content AS rationale, updated_at AS evaluated_at FROM memories WHERE n % 3 = 0)"
_v("gate_route", "memories", f""", {_CV}, k AS (SELECT m.memory_id, m.jev_status AS j, verdict, coalesce(verdict IN ('validated', 'needs_human_review', 'rejected'), false) AS known, coalesce(list_contains({_JUDGED}, m.jev_status || '>' || verdict), false) AS legal FROM memories m JOIN cv USING (memory_id))
SELECT memory_id, CASE WHEN known THEN CASE verdict WHEN 'validated' THEN 'propagate' WHEN 'needs_human_review' THEN 'review' ELSE 'hold_local' END END AS action, CASE WHEN known AND legal THEN verdict ELSE j END AS jev_status, NOT known OR (NOT legal AND j <> verdict) AS refused FROM k""")
_v("review_queue", "memories", f", {_CV} SELECT 'rev-' || memory_id AS review_id, memory_id, evaluated_at AS queued_at, 'open' AS status, content, rationale FROM memories JOIN cv USING (memory_id) WHERE verdict = 'needs_human_review'")
_v("conflict_resolution", "memories ledger cloud_memories", f""", {_CLASSED}, k AS (SELECT memory_id, n, n % 7 = 0 AS before, n % 7 = 1 AS told, n % 2 = 0 AND n % 6 <> 0 AND n % 7 <> 0 AS rec FROM classed WHERE kase = 'DIVERGED'),
e AS (SELECT *, n % 4 <> 3 AS asked, CASE WHEN n % 4 = 3 THEN NULL WHEN before THEN 'not open' WHEN NOT rec AND NOT told THEN 'no recommendation yet' WHEN n % 5 = 0 THEN 'winner must be edge or cloud' END AS error FROM k),
f AS (SELECT *, asked AND error IS NULL AS now FROM e)
SELECT memory_id, CASE WHEN now OR before THEN 'resolved' ELSE 'open' END AS status, rec AS recommended, error, CASE WHEN now THEN 'keep the edge''s' WHEN before THEN 'as agreed' ELSE '' END AS resolution, CASE WHEN now THEN 'ann' WHEN before THEN 'bob' ELSE '' END AS resolved_by,
 CASE WHEN now THEN 'edge' WHEN before THEN 'cloud' END AS resolution_winner, CASE WHEN now THEN '2025-01-01T00:00:00Z' WHEN before THEN '2024-06-01T00:00:00Z' END AS resolved_at, CASE WHEN rec THEN 'v1' WHEN before OR told THEN 'v0' END AS recommended_by_verdict, CASE WHEN rec THEN 'validated' WHEN before OR told THEN 'rejected' ELSE 'needs_human_review' END AS advised FROM f""")
_v("fleet_knn", "", """WITH s AS (SELECT c.vec_id::VARCHAR AS candidate_id, e.vec_id::VARCHAR AS memory_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s FROM embeddings e, embeddings c WHERE c.vec_id % 20 = 0 AND e.vec_id <> c.vec_id)
SELECT candidate_id, memory_id, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, memory_id) AS position, round(s, 6) AS similarity FROM s QUALIFY position <= 6""")
_JV = f"{_CV}, jv AS (SELECT 'v2-' || memory_id AS verdict_id, * FROM cv UNION ALL BY NAME SELECT 'v1-' || memory_id AS verdict_id, memory_id, 'needs_human_review' AS verdict, 'at first sight ' || content AS rationale, created_at AS evaluated_at FROM memories WHERE n % 6 = 0)"
_v("verdict_history", "memories", f", {_JV}, p AS (SELECT asset_id, jv.*, row_number() OVER (PARTITION BY asset_id ORDER BY evaluated_at DESC, memory_id, verdict_id) AS position FROM jv JOIN memories USING (memory_id) QUALIFY position <= 4) SELECT m.memory_id AS candidate_id, p.verdict_id, p.memory_id, verdict, rationale, position FROM memories m JOIN p USING (asset_id) WHERE m.memory_id <> p.memory_id")
_v("verdict_history_as_of", "memories", f""", {_JV}, p AS (SELECT asset_id, jv.* FROM jv JOIN memories USING (memory_id)), times AS (SELECT DISTINCT asset_id, updated_at AS moment FROM memories),
h AS (SELECT t.asset_id, moment, p.* EXCLUDE (asset_id), row_number() OVER (PARTITION BY t.asset_id, moment ORDER BY evaluated_at DESC, memory_id, verdict_id) AS position FROM times t JOIN p ON p.asset_id = t.asset_id AND p.evaluated_at <= moment QUALIFY position <= 4)
SELECT m.memory_id AS candidate_id, h.verdict_id, h.memory_id, verdict, rationale, position FROM memories m JOIN h ON h.asset_id = m.asset_id AND h.moment = m.updated_at WHERE m.memory_id <> h.memory_id""")

_ASSET = r"CASE WHEN regexp_matches(text, '(?i)\bMSN\s?[0-9]{3,}\b') THEN 'MSN' || regexp_extract(text, '(?i)\bMSN\s?([0-9]{3,})\b', 1) ELSE nullif(regexp_extract(text, '(?i)\b(?:asset|aircraft|vehicle|unit|truck|rig|airframe)\s+(?:id\s+)?([A-Za-z0-9][A-Za-z0-9-]{2,})', 1), '') END"
_SUB = r"lower(regexp_extract(text, '(?i)\b(hydraulics?|fuel system|electrical|avionics|landing gear|oxygen|pneumatics?|cooling|lubrication|navigation|pressurization|sensor|actuator|pump|valve|filter)\b', 1))"
_CTX = f"""named AS (SELECT session_id, seq, text, {_ASSET} AS a, nullif(CASE WHEN length({_SUB}) > 3 AND {_SUB} LIKE '%s' AND {_SUB} NOT LIKE '%ss' THEN regexp_replace({_SUB}, 's$', '') ELSE {_SUB} END, '') AS c FROM turns),
ctx AS (SELECT session_id, seq, text, last_value(a IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS asset_id, last_value(c IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS component FROM named)"""
_v("session_last_context", "turns", f", {_CTX} SELECT session_id, seq, asset_id, component FROM ctx")
_v("session_recent_buffer", "turns", "SELECT session_id, seq FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 2")
_DEP = r"(regexp_matches(text, '\S') AND (len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9-]*')) <= 6 OR regexp_matches(text, '(?i)(^|[^\pL\pN_])(it|its|this|that|these|those|the\s+same|same|also|again|still|there|their|other|about (?:the|that|this))($|[^\pL\pN_])')))"
_v("context_dependent", "turns", f"SELECT session_id, seq, {_DEP} AS context_dependent FROM turns")
_v("expand_query", "turns", f""", {_CTX}, prior AS (SELECT session_id, seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, lag(asset_id) OVER w AS pa, lag(component) OVER w AS pc FROM ctx WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
more AS (SELECT *, list_filter([pc, pa], lambda t: t IS NOT NULL AND NOT regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(t) || '($|[^A-Za-z0-9_])')) AS add FROM prior)
SELECT session_id, seq, CASE WHEN {_DEP} AND len(add) > 0 THEN text || ' (' || array_to_string(add, ', ') || ')' ELSE text END AS query FROM more""")
_v("normalize_text", "", r"""WITH r AS (SELECT doc_id, replace(replace(text, ' the ', chr(160) || 'the ' || chr(13) || chr(10)), '. ', '. ' || chr(9) || chr(13)) AS t FROM documents),
l AS (SELECT doc_id, regexp_replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \t]+\n', chr(10), 'g') AS t FROM r)
SELECT doc_id, regexp_replace(t, '[ \t]+$', '') AS text FROM l""")

_EXCERPTS = "'Excerpts:' || chr(10) || string_agg('#' || position || ' from ' || h.source || ':' || chr(10) || c.content, chr(10) ORDER BY position)"
_REPLY = "Reply from the excerpts alone, give the numbers of those you used, and say so if they hold no answer."
_v("grounded_prompt", "chunk_vec questions", f""", {_ASKED}, {_hybrid('h')}
SELECT query_id, {_EXCERPTS} || chr(10) || chr(10) || 'Asked: ' || any_value(asked.text) || chr(10) || '{_REPLY}' || chr(10) || chr(10) || 'Where they come from:' || chr(10) || string_agg('- ' || h.source || ', document ' || h.document_id, chr(10) ORDER BY position) AS prompt
FROM h JOIN chunk_vec c USING (id) JOIN asked USING (query_id) GROUP BY query_id""")
_v("hash_embed", "", """WITH texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'the pump valve filter of the hydraulic system'),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM texts),
n AS (SELECT doc_id, list_reduce(list_transform(regexp_extract_all(w, '.'), lambda c: ascii(c))::BIGINT[], lambda h, c: (h * 31 + c) % 4294967296, 0) % 32 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM n GROUP BY 1)
SELECT d.doc_id, round(coalesce((SELECT sum(a.n * q.n) FROM n a JOIN n q ON q.doc_id = -1 AND a.b = q.b WHERE a.doc_id = d.doc_id), 0) / l.len / (SELECT len FROM l WHERE doc_id = -1), 6) AS similarity FROM documents d LEFT JOIN l USING (doc_id)""")

# Contracts

_v("quarantine", "memories", "SELECT memory_id, CASE WHEN n % 13 = 0 THEN 'content: blank' ELSE '' END AS errors FROM memories")
_v("unknown_fields", "memories", "SELECT memory_id, CASE WHEN n % 7 = 0 THEN 'colour' WHEN n % 11 = 0 THEN 'Content|size' ELSE '' END AS unknown FROM memories")

# Changes, rounds and listings

_CHANGED = f"ch AS (SELECT m.*, l.fingerprint AS last, {_ELIGIBLE} AS ok, fp IS DISTINCT FROM l.fingerprint AS changed FROM (SELECT *, {_FP} AS fp FROM memories) m LEFT JOIN ledger l USING (memory_id))"
_v("change_counts", "memories ledger", f", {_CHANGED} SELECT count(*) AS scanned, count(*) FILTER (changed) AS changed, count(*) FILTER (changed AND ok) AS eligible FROM ch")
_v("pending_changes", "memories ledger", f", {_CHANGED} SELECT memory_id, CASE WHEN last IS NULL THEN 'create' ELSE 'update' END AS operation, ok AS sync_eligible FROM ch WHERE changed")
_ROUND = f"""e AS (SELECT * REPLACE (CASE WHEN n % 13 = 0 THEN ' ' ELSE asset_id END AS asset_id), {_FP} AS fp, {_ELIGIBLE} AS ok FROM memories WHERE n % 17 <> 0),
c AS (SELECT *, {_FP} AS fp FROM cloud_memories),
ids AS (SELECT memory_id FROM e UNION SELECT memory_id FROM ledger),
r AS (SELECT memory_id, e.memory_id IS NOT NULL AS here, c.memory_id IS NOT NULL AS there, e.n, e.fp AS efp, c.fp AS cfp, l.fingerprint AS base, e.ok, {_case('e.fp', 'c.fp', 'l.fingerprint')} AS kase, memory_id IN (SELECT memory_id FROM memories WHERE n % 20 = 0) AS wanted,
 e.content AS e_content, e.lifecycle_status AS e_life, e.memory_type AS e_type, c.content AS c_content, c.lifecycle_status AS c_life, c.sync_status AS c_sync, c.updated_at AS c_time FROM ids LEFT JOIN e USING (memory_id) LEFT JOIN ledger l USING (memory_id) LEFT JOIN c USING (memory_id)),
o AS (SELECT *, CASE WHEN wanted AND here AND base IS NOT NULL THEN 'expire' WHEN here AND efp IS DISTINCT FROM base AND ok THEN CASE WHEN base IS NULL THEN 'create' ELSE 'update' END END AS operation FROM r),
p AS (SELECT *, CASE WHEN operation IS NOT NULL AND kase = 'DIVERGED' AND there THEN 'conflict' WHEN operation = 'expire' THEN 'expire' WHEN kase = 'CLOUD_NEWER' AND base IS NOT NULL AND there THEN 'adopt' WHEN operation IS NULL THEN NULL WHEN kase = 'IDENTICAL' THEN 'dedupe' WHEN n % 13 = 0 THEN 'reject' ELSE 'upload' END AS outcome FROM o),
moved AS (SELECT *, (outcome = 'upload' AND e_type = 'field_observation' AND e_life IN ('synced', 'sync_pending', 'local', 'used', 'resolved')) OR (outcome = 'adopt' AND here AND c_life IN ('synced', 'sync_pending', 'local', 'used', 'resolved')) AS moves FROM p)"""
_VIEWS = "memories ledger cloud_memories"
_v("sync_round_plan", _VIEWS, f", {_ROUND} SELECT memory_id, operation, outcome, CASE WHEN outcome = 'reject' THEN 'record breaks its contract: asset_id: blank' END AS reason FROM p WHERE outcome IS NOT NULL")
_v("reconcile_adopt", _VIEWS, f", {_ROUND} SELECT memory_id, c_content AS content, CASE WHEN moves THEN 'synced' ELSE c_life END AS lifecycle_status, CASE WHEN moves THEN 'synced' ELSE c_sync END AS sync_status, CASE WHEN moves THEN '2025-01-01T00:00:00Z' ELSE c_time END AS updated_at, CASE WHEN here AND NOT moves THEN 'illegal step' END AS adopt_error FROM moved WHERE outcome = 'adopt'")
_v("sync_round_state", _VIEWS, f""", {_ROUND}, after AS (SELECT memory_id, CASE WHEN outcome = 'adopt' THEN c_content ELSE e_content END AS content, CASE WHEN moves THEN 'synced' ELSE c_life END AS lifecycle_status, CASE WHEN moves THEN 'synced' ELSE c_sync END AS sync_status FROM moved WHERE outcome = 'adopt' OR moves),
agreed AS (SELECT memory_id, CASE WHEN outcome = 'adopt' THEN cfp ELSE efp END AS fingerprint FROM p WHERE outcome IN ('upload', 'dedupe', 'adopt'))
SELECT memory_id, content, lifecycle_status, sync_status, fingerprint FROM after FULL JOIN agreed USING (memory_id)""")
_FOUND = f"{_CLASSED}, f AS (SELECT memory_id, n, k.* FROM classed, (VALUES ('cfl-', 1), ('cfl-later-', 2)) k(prefix, round) WHERE kase = 'DIVERGED' AND (round = 1 OR n % 2 = 0))"
_v("current_conflicts", _VIEWS, f", {_FOUND} SELECT memory_id, arg_max(prefix, round) || memory_id AS conflict_id FROM f WHERE n % 5 <> 0 GROUP BY memory_id")
_v("open_conflicts", _VIEWS, f", {_FOUND} SELECT row_number() OVER (ORDER BY prefix || memory_id) AS position, prefix || memory_id AS conflict_id, memory_id FROM f WHERE n % 5 <> 0 QUALIFY position <= 100")
_v("conflict_by_id", _VIEWS, f", {_FOUND} SELECT 'cfl-' || memory_id AS conflict_id, memory_id, CASE WHEN n % 5 = 0 THEN 'resolved' ELSE 'open' END AS status FROM f WHERE round = 1 AND memory_id = 'mem-000000042'")
_v("audit_trail", "memories", f"SELECT row_number() OVER (ORDER BY updated_at DESC, memory_id) AS position, 'evt-' || memory_id AS event_id, memory_id, updated_at AS timestamp, substr({_FP}, 1, 12) AS target_version FROM memories QUALIFY position <= 100")
_v("sync_counts", "memories ledger", f", {_DELTA}, a AS (SELECT n % 3 <> 0 OR n % 6 = 3 AS acked FROM delta) SELECT count(*) AS items, count(*) FILTER (acked) AS synced, count(*) FILTER (NOT acked) AS rejected FROM a")
_v("sync_results", "memories ledger", f", {_DELTA} SELECT memory_id, CASE WHEN n % 3 <> 0 OR n % 6 = 3 THEN 'synced' ELSE 'rejected' END AS outcome FROM delta")

# Capture, routes and stores

_ID = "'mem-' || sha256(concat_ws(chr(0), {kind}, asset_id, source, content, '2025-01-01T00:00:00Z'))"
_v("capture_kinds", "memories", f"""SELECT {_ID.format(kind="k.kind")} AS memory_id, k.kind AS memory_type, version, CASE WHEN n % 3 = 0 THEN 0.8::DOUBLE ELSE k.importance END AS importance, k.confidence, k.life AS lifecycle_status, k.judged AS jev_status
FROM memories, (VALUES ('session_note', 0.3::DOUBLE, 0.5::DOUBLE, 'new', 'pending'), ('manual', 0.9::DOUBLE, 1::DOUBLE, 'local', 'not_applicable')) k(kind, importance, confidence, life, judged)""")
_HEX = "list_reduce(list_transform(regexp_extract_all({}, '.'), lambda d: instr('0123456789abcdef', d) - 1)::BIGINT[], lambda a, d: a * 16 + d)"
_v("capture_and_route", "memories", f""", s AS (SELECT DISTINCT content, asset_id, source, importance FROM memories), i AS (SELECT *, {_ID.format(kind="'field_observation'")} AS memory_id FROM s),
j AS (SELECT *, {_HEX.format("substr(memory_id, 5, 8)")} % 7 AS k FROM i), v AS (SELECT *, CASE WHEN k IN (0, 3) THEN 'needs_more_evidence' WHEN k = 1 THEN 'flag_risk' WHEN k = 2 THEN 'validated' ELSE 'accept_local' END AS verdict FROM j),
a AS (SELECT *, CASE WHEN k = 2 THEN NULL WHEN verdict = 'accept_local' AND importance >= 0.7::DOUBLE THEN 'SYNC' ELSE 'KEEP_LOCAL' END AS action FROM v)
SELECT memory_id, verdict, CASE WHEN k IN (0, 3) THEN 0::DOUBLE ELSE 0.9::DOUBLE END AS verdict_confidence, action, action IS NULL AS refused, CASE WHEN action IS NULL THEN 'new' WHEN action = 'SYNC' THEN 'sync_pending' ELSE 'local' END AS lifecycle_status, CASE WHEN action IS NULL THEN 'pending' ELSE verdict END AS jev_status,
 CASE WHEN action IS NULL THEN '' ELSE concat_ws('|', 'lifecycle new → local', 'jev pending → ' || verdict, CASE WHEN action = 'SYNC' THEN 'lifecycle local → sync_pending' END) END AS transitions FROM a""")
_v("revise_and_route", "memories", """, w AS (SELECT m.n, p.memory_type, (p.version::INT + 1)::VARCHAR AS version, CASE WHEN m.n % 2 = 0 THEN 0.9::DOUBLE ELSE p.importance END AS importance, m.revision_of FROM memories m JOIN memories p ON p.memory_id = m.revision_of WHERE p.memory_type IN ('manual', 'field_observation') AND p.lifecycle_status <> 'expired'),
r AS (SELECT *, CASE WHEN memory_type <> 'manual' AND importance >= 0.7::DOUBLE THEN 'SYNC' ELSE 'KEEP_LOCAL' END AS verdict_route FROM w)
SELECT n, memory_type, version, importance, 'UPDATE' AS action, verdict_route, CASE WHEN verdict_route = 'SYNC' THEN 'sync_pending' ELSE 'local' END AS lifecycle_status, CASE WHEN memory_type = 'manual' THEN 'not_applicable' ELSE 'accept_local' END AS jev_status, revision_of FROM r""")
_v("strict_steps", "memories", "SELECT memory_id, 'conflict' AS lifecycle_status FROM memories WHERE lifecycle_status IN ('local', 'used', 'sync_pending', 'synced')")
_v("fleet_effects", "memories", f""", {_CV}, k AS (SELECT m.*, verdict, coalesce(list_contains({_JUDGED}, m.jev_status || '>' || verdict), false) AS legal FROM memories m JOIN cv USING (memory_id) WHERE verdict IN ('validated', 'rejected')),
g AS (SELECT * FROM k WHERE legal OR jev_status = verdict)
SELECT memory_id, store, CASE verdict WHEN 'validated' THEN 'propagate' ELSE 'hold_local' END AS action, verdict AS jev_status, CASE verdict WHEN 'validated' THEN 'synced' ELSE sync_status END AS sync_status, '2025-01-01T00:00:00Z' AS updated_at FROM g, (VALUES ('cloud_memories'), ('edge_memories')) s(store) WHERE store = 'edge_memories' OR verdict = 'validated'""")
_v("open_reviews", "memories", f", {_CV} SELECT row_number() OVER (ORDER BY evaluated_at, memory_id) AS position, 'rev-' || memory_id AS review_id, evaluated_at AS queued_at FROM cv WHERE verdict = 'needs_human_review' AND right(memory_id, 1) NOT IN ('1', '4') QUALIFY position <= 100")
_v("conflict_recommendations", _VIEWS, f", {_CV}, {_CLASSED} SELECT 'cfl-' || memory_id AS conflict_id, CASE verdict WHEN 'rejected' THEN 'validated' ELSE verdict END AS verdict, rationale, CASE verdict WHEN 'rejected' THEN 'v2-' ELSE 'v1-' END || memory_id AS verdict_id FROM classed JOIN cv USING (memory_id) WHERE kase = 'DIVERGED'")

# Provisioning

_PUMP = "s AS (SELECT *, row_number() OVER (ORDER BY round(coalesce(importance, 0.5::DOUBLE) * 10 + least(length(version), 4) * 0.05::DOUBLE, 9) DESC, id) AS r FROM chunk_vec WHERE jev_status = 'not_applicable' AND component = 'pump' AND regexp_matches(content, '\\S') QUALIFY r <= 60)"
_v("transferred_chunks", "chunk_vec", f", {_PUMP} SELECT id, document_id, CASE WHEN n % 5 <> 0 THEN version ELSE '1' END AS version, 'not_applicable' AS jev_status, source, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS dimensions FROM s")
_v("package_header", "chunks", f""", {_SEL} SELECT 'fieldmark-package-1' AS format, '{{"component": "pump", "job_terms": ["the", "und"]}}' AS target, count(*) AS total_available, least(count(*), 40) AS selected, count(*) > 40 AS truncated FROM sel""")
_v("package_items", "chunks", "SELECT row_number() OVER (ORDER BY round(coalesce(importance, 0.5::DOUBLE) * 10 + least(length(version), 4) * 0.05::DOUBLE, 9) DESC, id) AS rank, id, document_id, equipment_model, jev_status FROM chunks WHERE jev_status = 'not_applicable' AND equipment_model = 'A320' QUALIFY rank <= 25")
_v("embed_batches", "turns", "SELECT session_id, seq, CASE WHEN regexp_matches(text, '\\S') THEN length(text) || '|' || len(regexp_extract_all(text, '\\S+')) END AS vector FROM turns")

# Evaluation

_PLACED = """placed AS (SELECT m.*, e.embedding FROM memories m JOIN embeddings e ON e.vec_id = m.n % (SELECT count(*) FROM embeddings)), cand AS (SELECT * FROM placed WHERE n % 20 = 0)"""
# Candidates' texts hold no exact terms, so the second leg of the hybrid query repeats the first.
_DOCS = """dsem AS (SELECT m.memory_id AS cid, c.id, row_number() OVER (PARTITION BY m.memory_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], m.embedding::DOUBLE[]), 9) DESC, c.id) - 1 AS rank FROM cand m JOIN chunk_vec c ON c.asset_id = m.asset_id AND c.jev_status = 'not_applicable' QUALIFY rank < 18),
dall AS (SELECT cid, id, rank, 1::DOUBLE / (61 + rank) + 0.4::DOUBLE / (61 + rank) AS score, c.source, c.content, version = max(version) OVER (PARTITION BY cid) AS newest FROM dsem JOIN chunk_vec c USING (id)),
docs AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(score + 0.15::DOUBLE + CASE WHEN newest THEN 0.1::DOUBLE ELSE 0 END, 9) DESC, rank, id) AS position FROM dall QUALIFY position <= 6)"""
_v("fleet_documents", "memories chunk_vec", f", {_PLACED}, {_DOCS} SELECT cid AS candidate_id, id, position, round(score, 6) AS score FROM docs")
_OBS = """obs AS (SELECT a.memory_id AS cid, b.memory_id AS id, b.source, b.content, row_number() OVER (PARTITION BY a.memory_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.memory_id) AS position FROM cand a JOIN placed b ON a.memory_id <> b.memory_id QUALIFY position <= 6)"""
_HIST = f"""{_JV}, newest AS (SELECT asset_id, memory_id, verdict, rationale, row_number() OVER (PARTITION BY asset_id ORDER BY evaluated_at DESC, memory_id, verdict_id) AS position FROM jv JOIN memories USING (memory_id) QUALIFY position <= 4),
hist AS (SELECT m.memory_id AS cid, h.verdict, h.rationale, position FROM cand m JOIN newest h USING (asset_id) WHERE m.memory_id <> h.memory_id)"""
_NL = "chr(10) || chr(10)"


def _part(rows: str, title: str, none: str, line: str) -> str:
    return f"coalesce((SELECT '{title}' || chr(10) || string_agg({line}, chr(10) ORDER BY position) FROM {rows} WHERE {rows}.cid = cand.memory_id HAVING count(*) > 0), '{none}')"


def _judge(stage: str, evidence: str) -> str:
    """The prompts of ``cand``, as the relation ``asked(memory_id, n, prompt)``."""
    quote = "'#' || position || ' from ' || source || ':' || chr(10) || content"
    documents = _part("docs", "Documents:", "Documents: none", quote)
    if stage == "cloud":
        # A null verdict leaves its line out.
        middle = [_part("obs", "Other devices:", "Other devices: nothing", quote), documents, _part("hist", "Earlier verdicts:", "Earlier verdicts: none", "'- ' || verdict || ': ' || substr(rationale, 1, 200)")]
    else:
        middle = [evidence, documents]
    allowed = ", ".join(EDGE_VERDICTS if stage == "edge" else CLOUD_VERDICTS)
    head = f"'{JUDGES[stage]}' || {_NL} || 'Record (' || memory_type || ', asset ' || asset_id || ', from ' || source || '):' || chr(10) || content"
    tail = f"'Examine, in this order: {'; '.join(CHECKS[stage])}.' || {_NL} || 'Answer with one JSON object and nothing else: \"verdict\" (one of {allowed}), \"rationale\" (what decided it), \"confidence\" (0 to 1), \"risk_flags\" (a list of short texts).'"
    return f"asked AS (SELECT memory_id, n, {f' || {_NL} || '.join([head, *middle, tail])} AS prompt FROM cand)"


_WITH = "CASE WHEN n % 40 = 0 THEN 'Written with:' || chr(10) || '#1 from logbook:' || chr(10) || 'it was loose' ELSE 'Written with: nothing' END"
_v("judge_prompts", "memories chunk_vec", f", {_PLACED}, {_DOCS}, {_OBS}, {_HIST}, {_judge('cloud', '')} SELECT memory_id, prompt FROM asked")


def _evaluation(stage: str, verdict: str, used: str) -> str:
    return f"""SELECT 'vrd-' || substr(sha256(concat_ws(chr(0), memory_id, '{stage}', '2025-01-01T00:00:00Z')), 1, 32) AS verdict_id, memory_id, '{stage}' AS stage, '{verdict}' AS verdict, length(prompt) || ' characters read' AS rationale, 0.75::DOUBLE AS confidence, '' AS risk_flags, {used} AS evidence_used, 'scripted' AS model_used, '2025-01-01T00:00:00Z' AS evaluated_at FROM asked"""


_IDS = "(SELECT string_agg(id, '|' ORDER BY position) FROM {0} WHERE {0}.cid = asked.memory_id)"
_v("edge_evaluation", "memories chunk_vec", f", {_PLACED}, {_DOCS}, {_judge('edge', _WITH)} " + _evaluation("edge", "accept_local", f"concat_ws('|', CASE WHEN n % 40 = 0 THEN 'e1' END, {_IDS.format('docs')})"))
_v("cloud_evaluation", "memories chunk_vec", f", {_PLACED}, {_DOCS}, {_OBS}, {_HIST}, {_judge('cloud', '')} " + _evaluation("cloud", "validated", f"concat_ws('|', {_IDS.format('obs')}, {_IDS.format('docs')})"))

# Sessions

_VERBS = "replaced|swapped|reset|cleaned|inspected|torqued|checked|removed|installed|reinstalled|tightened|lubricated"
# The mark that ends an object is taken with it: none can begin the next one.
_SAID = rf"(?i)\b({_VERBS})\b\s+([^.,;!?]*?)(\s+and\s+|[,;!?]|$)"
_ACTIONS = rf"""said AS (SELECT session_id, seq, unnest(regexp_extract_all(text, '{_SAID}', 1)) AS verb, unnest(regexp_extract_all(text, '{_SAID}', 2)) AS obj, generate_subscripts(regexp_extract_all(text, '{_SAID}', 1), 1) AS i FROM turns),
done AS (SELECT session_id, lower(verb) || ' ' || array_to_string(list_slice(regexp_split_to_array(lower(regexp_replace(obj, '^\s+|\s+$', '', 'g')), '\s+'), 1, 2), ' ') AS action, min([seq, i]) AS spot FROM said WHERE regexp_matches(obj, '\S') GROUP BY ALL),
acts AS (SELECT session_id, action, row_number() OVER (PARTITION BY session_id ORDER BY spot, action) AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY spot DESC, action) AS newest FROM done) WHERE newest <= 10)"""
_v("actions_taken", "turns", f", {_ACTIONS} SELECT session_id, position, action FROM acts")
_EVID = "ev AS (SELECT session_id, seq, 1 AS position, 'doc-' || seq % 5 AS document_id, 's' || session_id % 3 AS source, substr(text, 1, 200) AS content FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3)"
_v("session_evidence", "turns", f", {_EVID} SELECT session_id, seq, position, document_id, content FROM ev")
_NOTED = "noted AS (SELECT conv_id AS session_id, turn, 'o-' || lpad(turn::VARCHAR, 4, '0') AS memory_id, substr(text, 1, 60) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest FROM conversations WHERE role = 'assistant')"
_v("session_observations", "turns", f", {_NOTED} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS position, memory_id, content FROM noted WHERE newest <= 2")
_BORROWED = f"{_CTX}, bctx AS (SELECT session_id, seq, asset_id, coalesce(component, CASE WHEN session_id % 4 = 0 THEN 'pump' END) AS component FROM ctx)"
_v("session_borrowed_context", "turns", f", {_BORROWED} SELECT session_id, seq, asset_id, component FROM bctx")
_STATE = f"{_BORROWED}, st AS (SELECT session_id, max_by(struct_pack(a := asset_id, c := component), seq) AS last, CASE WHEN session_id % 3 = 0 THEN 'A320' END AS model, CASE WHEN session_id % 4 = 1 THEN 'it leaks' END AS issue FROM bctx GROUP BY session_id)"
_v("suggested_filters", "turns", f", {_STATE} SELECT session_id, last.a AS asset_id, model AS equipment_model FROM st WHERE last.a IS NOT NULL OR model IS NOT NULL")
_SUMMARY = f"""{_STATE}, {_ACTIONS}, {_EVID}, {_NOTED},
q AS (SELECT session_id, seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS newest FROM turns QUALIFY newest <= 10),
n AS (SELECT session_id, sum(length(q)) > 600 AS long, count(*) AS total FROM q GROUP BY 1),
said_before AS (SELECT session_id, string_agg('  ' || q, chr(10) ORDER BY seq) AS lines FROM q JOIN n USING (session_id) WHERE NOT long OR newest <= 3 GROUP BY 1),
watched AS (SELECT session_id, string_agg('  ' || content, chr(10) ORDER BY turn) AS lines FROM noted WHERE newest <= 3 GROUP BY 1),
used AS (SELECT session_id, string_agg('  ' || source || ', document ' || document_id || ': ' || CASE WHEN long AND length(content) > 140 THEN substr(content, 1, 140) || '…' ELSE content END, chr(10) ORDER BY seq) AS lines FROM ev JOIN n USING (session_id) GROUP BY 1),
acted AS (SELECT session_id, string_agg(action, '; ' ORDER BY position) AS line FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS held FROM acts) WHERE position > held - 3 GROUP BY 1),
t AS (SELECT st.session_id, last.a AS asset_id, last.c AS component, concat_ws(chr(10), 'The session so far', concat_ws('; ', 'Concerns asset ' || coalesce(last.a, 'not known'), 'subsystem ' || coalesce(last.c, 'not known'), 'model ' || model), 'Trouble: ' || issue, 'Observed:' || chr(10) || watched.lines,
 'Asked:' || chr(10) || CASE WHEN long AND total > 3 THEN '  ' || (total - 3) || ' before these' || chr(10) ELSE '' END || said_before.lines, 'Consulted:' || chr(10) || used.lines, 'Done: ' || acted.line) AS s
 FROM st JOIN n USING (session_id) LEFT JOIN said_before USING (session_id) LEFT JOIN watched USING (session_id) LEFT JOIN used USING (session_id) LEFT JOIN acted USING (session_id)),
summaries AS (SELECT session_id, asset_id, component, CASE WHEN length(s) > 700 THEN rtrim(substr(s, 1, 699)) || '…' ELSE s END AS summary FROM t)"""
_v("session_summary", "turns", f", {_SUMMARY} SELECT * FROM summaries")

# Answers

_FLOW = rf"""{_SUMMARY},
near AS (SELECT query_id, q.text, regexp_replace(q.text, '^\s+|\s+$', '', 'g') AS trimmed, n, asset_id, component, summary FROM questions q JOIN summaries ON session_id = conv_id),
more AS (SELECT *, list_filter([component, asset_id], lambda t: t IS NOT NULL AND NOT regexp_matches(trimmed, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(t) || '($|[^A-Za-z0-9_])')) AS add, {_ASSET} AS named FROM near),
wide AS (SELECT *, CASE WHEN {_DEP} AND len(add) > 0 THEN trimmed || ' (' || array_to_string(add, ', ') || ')' ELSE trimmed END AS query FROM more),
{_terms("qterms", "wide", "query_id", "query")},
asked AS (SELECT query_id, n % (SELECT count(*) FROM embeddings) AS vec_id, CASE WHEN named IS NULL OR named = asset_id THEN asset_id END AS scope, text, query, summary, terms, {_SPLIT_TERMS} AS words FROM wide JOIN qterms USING (query_id)),
{_hybrid('h', ' AND (scope IS NULL OR c.asset_id = scope)')}, {_hybrid('w', '', ' AND query_id NOT IN (SELECT query_id FROM h)')},
both_ AS (SELECT query_id, position, id, source, document_id, version, false AS widened FROM h UNION ALL SELECT query_id, position, id, source, document_id, version, true FROM w)"""
_v("answer_question", "chunk_vec turns questions", f""", {_FLOW}, p AS (SELECT query_id, any_value(query) AS query, bool_or(widened) AS widened, any_value(summary) <> '' AS used_context, concat_ws(chr(10), {_EXCERPTS}, chr(10) || any_value(summary), chr(10) || 'Asked: ' || any_value(asked.text), '{_REPLY}') AS prompt
 FROM both_ h JOIN chunk_vec c USING (id) JOIN asked USING (query_id) GROUP BY query_id)
SELECT query_id, query, widened, used_context, prompt, 'read ' || length(prompt) || ' characters' AS answer FROM p""")
_v("answer_citations", "chunk_vec turns questions", f""", {_FLOW}, g AS (SELECT query_id, min(position) AS first, document_id, arg_min(source, position) AS source, arg_min(version, position) AS version, string_agg(id, '|' ORDER BY position) AS chunk_ids FROM both_ GROUP BY query_id, document_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS position, document_id, source, version, chunk_ids FROM g""")

# Texts

_SPLIT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '([.!?])\s+([\p{{Lu}}"''\[(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_v("sentence_split", "", f"""WITH s AS (SELECT doc_id, {_SPLIT.format("text")} AS s FROM documents) SELECT doc_id, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS sentence FROM s""")
_CHUNKED = rf"""paras AS (SELECT doc_id, generate_subscripts(p, 1) AS para, unnest(p) AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', ''), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents)),
sents AS (SELECT doc_id, para, generate_subscripts(s, 1) AS sent, unnest(s) AS s FROM (SELECT doc_id, para, CASE WHEN length(p) <= 1600 THEN [p] ELSE {_SPLIT.format("p")} END AS s FROM paras)),
-- A sentence beyond the bound is cut at its last space from 800 on, or at 1,600.
cuts AS (SELECT doc_id, para, sent, 0 AS k, s AS rest, CASE WHEN length(s) <= 1600 THEN length(s) WHEN 1601 - instr(reverse(substr(s, 1, 1601)), ' ') >= 800 AND contains(substr(s, 1, 1601), ' ') THEN 1601 - instr(reverse(substr(s, 1, 1601)), ' ') ELSE 1600 END AS n FROM sents
 UNION ALL SELECT doc_id, para, sent, k + 1, r, CASE WHEN length(r) <= 1600 THEN length(r) WHEN 1601 - instr(reverse(substr(r, 1, 1601)), ' ') >= 800 AND contains(substr(r, 1, 1601), ' ') THEN 1601 - instr(reverse(substr(r, 1, 1601)), ' ') ELSE 1600 END FROM (SELECT doc_id, para, sent, k, substr(rest, n + 1) AS r FROM cuts WHERE length(rest) > n)),
pieces AS (SELECT doc_id, para, list(piece ORDER BY sent, k) AS p FROM (SELECT doc_id, para, sent, k, trim(substr(rest, 1, n)) AS piece FROM cuts) WHERE piece <> '' GROUP BY ALL),
-- A fold with the length so far, the chunk at hand, and the chunk of each piece.
packed AS (SELECT doc_id, para, p, list_reduce(list_transform(p, lambda x: [length(x)]), lambda a, x: CASE WHEN a[1] + 1 + x[1] <= 1600 THEN [a[1] + 1 + x[1], a[2]] || a[3:] || [a[2]] ELSE [x[1], a[2] + 1] || a[3:] || [a[2] + 1] END, [1600, -1]::BIGINT[])[3:] AS c FROM pieces),
chunked AS (SELECT doc_id, para, c, string_agg(piece, ' ' ORDER BY i) AS t FROM (SELECT doc_id, para, unnest(p) AS piece, unnest(c) AS c, generate_subscripts(p, 1) AS i FROM packed) GROUP BY doc_id, para, c),
placed AS (SELECT doc_id, row_number() OVER w - 1 AS position, t, lag(t) OVER w AS before FROM chunked WINDOW w AS (PARTITION BY doc_id ORDER BY para, c)),
tails AS (SELECT *, trim(CASE WHEN contains(right(before, 200), ' ') THEN regexp_replace(right(before, 200), '^[^ ]* ', '') ELSE right(before, 200) END) AS head FROM placed),
chunk_rows AS (SELECT doc_id, position, CASE WHEN before IS NULL OR head = '' OR starts_with(t, head) THEN t ELSE head || ' ' || t END AS content FROM tails)"""
_v("chunk_text", "", f"WITH RECURSIVE {_CHUNKED} SELECT doc_id, position, content FROM chunk_rows")
_v("ingest_chunks", "", f"WITH RECURSIVE {_CHUNKED} SELECT substr(sha256(concat_ws(chr(0), doc_id::VARCHAR, '1', position::VARCHAR)), 1, 32) AS id, doc_id::VARCHAR AS document_id, content, 'not_applicable' AS jev_status, 32 AS dimensions FROM chunk_rows")
_v("exact_terms_hinted", "", f"""WITH t AS (SELECT doc_id, 'fault code ' || doc_id || ' on ERR-' || doc_id % 7 || '1: ' || text AS text FROM documents), {_terms("h", "t", "doc_id")} SELECT doc_id, array_to_string(terms, '|') AS terms FROM h""")
