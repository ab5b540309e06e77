"""The queries in DuckDB's SQL, where SQL can say them over whole tables."""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT doc, p.n, s, item_id FROM places p JOIN windows i ON p.n = i.n AND p.phrase = i.phrase),
hits AS (SELECT doc, count(DISTINCT pos) AS n_hit FROM (SELECT doc, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc),
held AS (SELECT doc, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc, item_id::VARCHAR AS id FROM found) GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc) LEFT JOIN held USING (doc)
"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
WHERE rank <= 5
"""

OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS response FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to
FROM p LEFT JOIN g USING (d)
"""

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT x AS node, x AS other FROM (SELECT DISTINCT x FROM links) UNION SELECT node, y FROM reach JOIN links ON other = x),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON node = doc_id
"""

OP11 = "WITH v AS (" + """
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS k, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 40))"""
for _r in range(6):
    OP11 += f""",
a{_r} AS MATERIALIZED (
  SELECT i, vec_id, v.q, k, (list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q))::BIGINT AS d
  FROM v, c{_r} c QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k) = 1),
m{_r} AS (SELECT k, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS p, unnest(q)::BIGINT AS x FROM a{_r}) GROUP BY k, p),
c{_r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.q, c.q) AS q FROM c{_r} c
  LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY p) AS q FROM m{_r} GROUP BY k) n USING (k))"""
OP11 += """
SELECT vec_id, a5.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c5.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (k)
"""

_CRC = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda c, b:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295))"""
_FIELD = "coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(x=x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _climb(name: str, key: str) -> str:
    """The levels above a CTE's rows (idx, n, d), which are each other's siblings in pairs."""
    return f"""
{name} AS (
  SELECT {key} 0 AS level, idx, n, d FROM {name}_0
  UNION ALL SELECT {key} any_value(level) + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY {key} idx // 2)"""


OP13 = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS i, doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS held
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, i) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM base),
nodes_0 AS (SELECT tree, idx, n, leaf AS d FROM placed), {_climb('nodes', 'tree,')},
tops_0 AS (SELECT tree AS idx, count(*) OVER () AS n, d FROM nodes WHERE n = 1), {_climb('tops', '')},
steps AS (
  SELECT i, row_number() OVER (PARTITION BY i ORDER BY upper, level) AS s, place, coalesce(d, '') AS d FROM (
    SELECT i, 0 AS upper, l.level, (p.idx >> l.level) & 1 AS place, s.d
    FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l USING (tree)
    LEFT JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.idx = xor(p.idx >> l.level, 1)
    UNION ALL
    SELECT i, 1, l.level, (p.tree >> l.level) & 1, s.d
    FROM placed p, (SELECT DISTINCT level FROM tops WHERE n > 1) l
    LEFT JOIN tops s ON s.level = l.level AND s.idx = xor(p.tree >> l.level, 1))),
fold AS (
  SELECT i, 0 AS s, held AS x FROM placed
  UNION ALL SELECT f.i, f.s + 1, sha256(CASE place WHEN 1 THEN d || x ELSE x || d END) FROM fold f JOIN steps t ON t.i = f.i AND t.s = f.s + 1),
folded AS (SELECT i, arg_max(x, s) AS folded_root FROM fold GROUP BY i),
proofs AS (SELECT i, string_agg(d, '' ORDER BY s) AS p FROM steps GROUP BY i)
SELECT doc_id, leaf, r.d AS subroot, t.d AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = t.d AS verified
FROM placed JOIN folded USING (i) LEFT JOIN proofs USING (i) JOIN nodes r ON r.tree = placed.tree AND r.n = 1 JOIN tops t ON t.n = 1
"""

ORACLES: dict[str, str] = {
    "op1_topk": OP1,
    "op2_minhash": OP2,
    "op3_warc": OP3,
    "op10_decontamination": OP10,
    "op11_centroids": OP11,
    "op13_manifest": OP13,
}
