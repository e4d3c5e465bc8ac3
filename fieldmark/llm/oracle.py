"""SQL for DuckDB that must give the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_HEX = "list_reduce(list_transform(regexp_extract_all({}, '.'), lambda d: instr('0123456789abcdef', d) - 1)::BIGINT[], lambda a, d: a * 16 + d)"


def _closure(edges: str, nodes: str) -> str:
    """The smallest node that each node of ``nodes(id)`` reaches by ``edges(a, b)``, as the relation ``comp(id, comp)``."""
    return f"""twoway AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach AS (SELECT DISTINCT a AS id, a AS r FROM twoway UNION SELECT reach.id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.r),
comp AS (SELECT n.id, coalesce(min(r), n.id) AS comp FROM {nodes} n LEFT JOIN reach USING (id) GROUP BY n.id)"""


OP1 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT doc_id, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(i) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(k) OVER o AS k1, lead(k, 2) OVER o AS k2, lag(i) OVER o IS NULL AS head FROM k WHERE k <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
-- Three lines; all of a text of fewer; a long line by itself.
w AS (SELECT doc_id, i, [i, i1, i2] AS own, '3' || k || chr(10) || k1 || chr(10) || k2 AS win FROM f WHERE i2 IS NOT NULL
 UNION ALL SELECT doc_id, i, list_filter([i, i1], lambda x: x IS NOT NULL), 'all' || concat_ws(chr(10), k, k1) FROM f WHERE n < 3 AND head
 UNION ALL SELECT doc_id, i, [i], '1' || k FROM f WHERE length(k) - length(replace(k, ' ', '')) >= 50),
later AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(own) AS i FROM later)
SELECT l.doc_id, count(*)::INT AS n_lines, coalesce(string_agg(g.i, ',' ORDER BY g.i), '') AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id"""

OP3 = r"""WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{_closure("links", "(SELECT doc_id AS id FROM documents)")}
SELECT doc_id, len(s) AS n_shingles, comp AS component_id, doc_id = comp AS kept FROM s JOIN comp ON comp.id = doc_id"""

OP6 = f"""WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93::DOUBLE),
{_closure("links", "(SELECT vec_id AS id FROM embeddings)")}
SELECT comp.id AS vec_id, (SELECT count(*) FROM twoway WHERE twoway.a = comp.id) AS n_links, comp AS component_id, comp.id = comp AS kept FROM comp"""

OP9 = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
h AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, {_HEX.format("substr(md5(doc_id::VARCHAR), 1, 15)")} AS h, xor(list_reduce(list_transform(regexp_extract_all(lower(hex(encode(text))), '..'), lambda x: (instr('0123456789abcdef', x[1]) - 1) * 16 + instr('0123456789abcdef', x[2]) - 1)::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, tab),
ordered AS (SELECT *, md5(concat_ws('|', doc_id::VARCHAR, crc::VARCHAR, size::VARCHAR)) AS o FROM h),
jump AS (SELECT doc_id, h::HUGEINT AS key, 0::BIGINT AS b, 0::BIGINT AS j, n FROM h, (VALUES (40), (41)) s(n)
 UNION ALL SELECT doc_id, k, j, floor((j + 1) * (2147483648::DOUBLE / (k // 8589934592 + 1)::DOUBLE))::BIGINT, n FROM (SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k, j, n FROM jump WHERE j < n)),
placed AS (SELECT doc_id, max(b) FILTER (n = 40) AS shard, max(b) FILTER (n = 41) AS grown FROM jump WHERE j >= n GROUP BY 1)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(o, 16, 15), doc_id) - 1 AS slot, grown::INT AS grown_shard FROM ordered JOIN placed USING (doc_id)"""

OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, {_HEX.format("substr(md5(doc_id::VARCHAR), 1, 15)")} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
-- Shares by weight; whoever is above three times their size is held there, and the rest shared again.
share AS (SELECT 0 AS round, source, source_size, w, false AS held, NULL::DOUBLE AS target FROM s
 UNION ALL SELECT round + 1, source, source_size, w, held OR free * w > 3 * source_size, CASE WHEN held OR free * w > 3 * source_size THEN 3::DOUBLE * source_size ELSE w * free END
 FROM (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - sum(CASE WHEN held THEN 3::DOUBLE * source_size ELSE 0 END) OVER (PARTITION BY round)) / nullif(sum(CASE WHEN held THEN 0 ELSE w END) OVER (PARTITION BY round), 0) AS free FROM share) WHERE round < 40),
t AS (SELECT source, source_size, coalesce(target, 3::DOUBLE * source_size) AS target, CASE WHEN source_size > 0 THEN floor(coalesce(target, 3::DOUBLE * source_size) / source_size)::BIGINT ELSE 0 END AS whole FROM share WHERE round = 40),
c AS (SELECT d.*, t.source_size, t.target, t.whole, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS g FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN 2 * (upto - g) + g <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

OP11 = rf"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ascii(x))::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM documents, tab),
a AS (SELECT *, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a FROM h),
p AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM a),
e AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM p),
-- Words q apart are alike over six places at least in any run of twelve: six words that recur q places later.
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM p WHERE n >= 12)),
alike AS (SELECT a.doc_id, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM alike GROUP BY doc_id, q, island HAVING count(*) + 5 >= q),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= 12 GROUP BY doc_id, start, length),
top AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'l': -length, 's': start, 'p': period}}) AS r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS text FROM e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, r.s::BIGINT AS start, r.l::BIGINT AS length, r.p::BIGINT AS period, (1000 * r.l // r.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM p LEFT JOIN top USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

OP12 = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM t WINDOW g AS (PARTITION BY t)"""

OP13 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM f GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, letters WHERE length(o) < 5 AND instr(o, x) = 0),
steps AS (SELECT o AS filter_order, s AS step, o[s] AS x, o[:s - 1] AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
met AS (SELECT part, filter_order, step, x, n, good, toxic, fails, instr(fails, x) > 0 AS bad, regexp_matches(fails, '[' || earlier || '0]') AS gone FROM cells, steps),
seen AS (SELECT part, filter_order, step, x, sum(CASE WHEN bad OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM seen"""

SQL = {"op1_line_dedup": OP1, "op3_url_filter": OP3, "op4_minhash_near_dedup": OP4, "op6_pq_vector_dedup": OP6, "op9_jump_sharding": OP9, "op10_source_mix": OP10, "op11_periodic_runs": OP11, "op12_exact_dedup": OP12, "op13_filter_audit": OP13}
