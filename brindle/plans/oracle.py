"""The same queries in DuckDB's SQL, written for themselves: nothing of the Spark plans is used."""

from __future__ import annotations

#: Topics that stand for known chains, and what must not stand anywhere in the output.
TOPICS = {"quantum_biology": "quantum biology"} | {
    f"quantum_biology_H{k}": f"quantum biology {name}"
    for k, name in enumerate(("photosynthesis", "coherence", "algorithm", "density", "thermoregulation", "energy computing", "sensor", "evolution", "communication", "navigation"), 1)
}
SENSITIVE = ("bisociation", "falsifiable_test", "doi_urgency", "dvu_estimate", "ip_owner", "patent-candidate", "Thermal-Substrate")
BITS = (128, 256, 512, 1024)
TEXT, OTHER = "BRAZIL supplier", "AUTOMOBILE part"

NODES = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS text FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, '')) FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', concat_ws(' ', nullif(p_name, ''), nullif(p_type, ''), nullif(p_brand[:100], '')) FROM part)
"""
EDGES = """
edges AS (
  SELECT source, target, type, source || '|' || target || '|' || type AS edge_seq FROM (
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in_region' AS type FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in' FROM customer
    UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies' FROM lineitem)),
ends AS (SELECT source AS id, target AS nbr FROM edges UNION ALL SELECT target, source FROM edges),
truth AS (SELECT DISTINCT id, nbr FROM ends)
"""
ELIGIBLE = "eligible AS (SELECT id AS query_id, count(*) AS n_true FROM truth JOIN nodes USING (id) GROUP BY id HAVING count(*) >= 2)"
DIGEST = "('0x' || substr(sha256({text}), {at}, 16))::UBIGINT"


def samples(seeds: int, n: int) -> str:
    return f"""
picks AS (
  SELECT seed::INTEGER AS seed, query_id, n_true FROM (
    SELECT seed, query_id, n_true, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || query_id), query_id) AS place FROM eligible, range({seeds}) t(seed))
  WHERE place <= {n})"""


def digest(text: str, j: int) -> str:
    return DIGEST.format(text=text, at=49 - 16 * j)


def simhash(source: str, name: str) -> str:
    """CTEs: `name` has id and four unsigned limbs of a table (id, text)."""
    each = ", ".join(f"{digest('s || w', j)} AS u{j}" for j in range(4))
    sums = ", ".join(f"(sum(n * ((u{j} >> {b}) & 1)) * 2 > sum(n))::INTEGER AS b{j}_{b}" for j in range(4) for b in range(64))
    limbs = ", ".join(" + ".join(f"coalesce(b{j}_{b}, 0)::UBIGINT * {1 << b}::UBIGINT" for b in range(64)) + f" AS u{j}" for j in range(4))
    return rf"""
{name}_words AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL),
{name}_hashes AS (SELECT id, n, {each} FROM {name}_words, (VALUES ('h1'), ('h2'), ('h3'), ('h4')) seeds(s)),
{name}_bits AS (SELECT id, {sums} FROM {name}_hashes GROUP BY id),
{name} AS (SELECT id, {limbs} FROM (SELECT id FROM {source}) LEFT JOIN {name}_bits USING (id))"""


def topology() -> str:
    sums = ", ".join(f"((sum(weight * ((u{j} >> {b}) & 1)) * 2) >= sum(one) + 2)::INTEGER AS b{j}_{b}" for j in range(4) for b in range(64))
    limbs = ", ".join(" + ".join(f"b{j}_{b}::UBIGINT * {1 << b}::UBIGINT" for b in range(64)) + f" AS u{j}" for j in range(4))
    return f"""
votes AS (
  SELECT id, 2 AS weight, 0 AS one, u0, u1, u2, u3 FROM content
  UNION ALL SELECT e.id, 1, 1, u0, u1, u2, u3 FROM ends e JOIN content c ON c.id = e.nbr),
address_bits AS (SELECT id, {sums} FROM votes GROUP BY id),
address AS (SELECT id, {limbs} FROM address_bits)"""


SIGNED = ", ".join(f"(u{j}::BIT)::BIGINT AS l{j}" for j in range(4))
CONTENT = f"{NODES.strip()}, {simhash('nodes', 'content')}"
GRAPH = f"{NODES.strip()}, {EDGES}"
ADDRESS = f"{GRAPH}, {simhash('nodes', 'content')}, {topology()}"


def hamming(a: str, b: str, limbs=range(4)) -> str:
    return " + ".join(f"bit_count(xor({a}u{j}, {b}u{j}))::INTEGER" for j in limbs)


def of_text(text: str, name: str) -> str:
    return f"{name}_t AS (SELECT 'q' AS id, '{text}' AS text), {simhash(f'{name}_t', name)}"


def scores(index: str, queries: str, name: str, dist: str | None = None) -> str:
    return f"""
{name}_ranked AS (
  SELECT q.query_id, a.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {dist or hamming('a.', 'b.')}, a.id) AS rank
  FROM (SELECT DISTINCT query_id FROM {queries}) q JOIN {index} b ON b.id = q.query_id JOIN {index} a ON a.id <> q.query_id),
{name} AS (
  SELECT q.query_id, coalesce(1.0 / min(rank) FILTER (t.nbr IS NOT NULL), 0.0) AS rr,
         count(*) FILTER (t.nbr IS NOT NULL AND rank <= 5) / any_value(n_true) AS recall
  FROM {name}_ranked q LEFT JOIN truth t ON t.id = q.query_id AND t.nbr = q.id JOIN eligible e ON e.query_id = q.query_id GROUP BY q.query_id)"""


MULTISEED = f"""
WITH {ADDRESS}, {ELIGIBLE}, {samples(10, 50)}, {scores('content', 'picks', 'by_content')}, {scores('address', 'picks', 'by_topology')},
seeds AS (
  SELECT seed, 'content' AS method, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall_5 FROM picks JOIN by_content USING (query_id) GROUP BY seed
  UNION ALL SELECT seed, 'topology', round(avg(rr), 9), round(avg(recall), 9) FROM picks JOIN by_topology USING (query_id) GROUP BY seed)
"""


def width(b: int) -> str:
    n = -(-b // 64)
    return "lower(" + " || ".join(f"lpad(to_hex(u{j % 4}), 16, '0')" for j in reversed(range(n))) + ")"


def hops(n: int) -> str:
    """Nodes within n hops of one seed's queries, with their distance."""
    out = "reach0 AS (SELECT query_id, query_id AS node, 0 AS dist FROM picks)"
    for k in range(1, n + 1):
        out += f", reach{k} AS (SELECT query_id, node, min(dist) AS dist FROM (SELECT * FROM reach{k - 1} UNION ALL SELECT query_id, nbr, {k} FROM reach{k - 1} JOIN truth ON id = node) GROUP BY ALL)"
    return out + f", sub AS (SELECT query_id, node, dist FROM reach{n})"


def ranking(column: str, order: str) -> str:
    return f"SELECT query_id, node, {column} AS score, (row_number() OVER (PARTITION BY query_id ORDER BY {order}, node))::INTEGER AS rank FROM scored WHERE node <> query_id"


EGO = f"{GRAPH}, {ELIGIBLE}, {samples(1, 20)}"
INSIDE = "inside AS (SELECT a.query_id, e.source, e.target FROM edges e JOIN sub a ON a.node = e.source JOIN sub b ON b.node = e.target AND b.query_id = a.query_id)"
PRIVATE = """
private AS (
  SELECT 'supplier:' || s_suppkey AS id, 'spec' AS type, s_name || '—x' AS label,
         CASE WHEN s_nationkey % 3 = 0 THEN 'quantum_biology_H' || (s_nationkey + 1) END AS chain,
         CASE WHEN s_nationkey % 2 = 0 THEN 'active' ELSE 'unheard' END AS status, CASE WHEN s_acctbal > 0 THEN 'title' END AS title FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, NULL, '', NULL, NULL, '' FROM customer)
"""
TOPIC = "CASE chain " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOPICS.items()) + " END"
SANITIZED = f"""{PRIVATE}, clean AS (
  SELECT id, coalesce(type, 'unknown') AS type,
         coalesce({TOPIC}, CASE WHEN label <> '' AND label <> id THEN replace(label, '—', '-')[:80] END, id) AS label,
         coalesce(status, '') AS status, CASE WHEN {TOPIC} IS NOT NULL THEN chain END AS cluster FROM private)"""
def capped(levels: int = 5, most: int = 50) -> str:
    """Breadth-first subgraphs in queue order, a pair of CTEs for each level."""
    out = """ways AS (SELECT source AS id, target AS nbr, edge_seq, 0 AS side FROM edges UNION ALL SELECT target, source, edge_seq, 1 FROM edges),
front0 AS (SELECT query_id, query_id AS node, 1::BIGINT AS bfs_order, 0 AS dist FROM picks), seen0 AS (SELECT * FROM front0)"""
    for k in range(1, levels + 1):
        out += f""",
near{k} AS (SELECT f.query_id, b.nbr AS node, min({{'a': f.bfs_order, 'b': b.edge_seq, 'c': b.side}}) AS key FROM front{k - 1} f JOIN ways b ON b.id = f.node
  WHERE NOT EXISTS (SELECT 1 FROM seen{k - 1} s WHERE s.query_id = f.query_id AND s.node = b.nbr) GROUP BY ALL),
front{k} AS (SELECT query_id, node, have + place AS bfs_order, {k} AS dist FROM (
  SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY key, node) AS place FROM near{k}) JOIN (SELECT query_id, max(bfs_order) AS have FROM seen{k - 1} GROUP BY query_id) USING (query_id)
  WHERE have + place <= {most}),
seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT * FROM front{k})"""
    return out + f", sub AS (SELECT query_id, node, bfs_order::INTEGER AS bfs_order, dist::INTEGER AS dist FROM seen{levels})"


STEP = """
step AS (SELECT DISTINCT query_id, a, b FROM (SELECT query_id, source AS a, target AS b FROM inside UNION ALL SELECT query_id, target, source FROM inside)),
sums AS (SELECT query_id, a, count(*) AS n FROM step GROUP BY ALL)"""
WALKED = """
walk AS (
  SELECT query_id, node, 0 AS k, CASE WHEN node = query_id THEN 1.0::DOUBLE ELSE 0.0 END AS p FROM sub
  UNION ALL
  SELECT s.query_id, s.node, w.k, 0.85 * coalesce(w.p, 0) + CASE WHEN s.node = s.query_id THEN 0.15 ELSE 0 END
  FROM sub s JOIN (
    SELECT x.query_id, x.node, any_value(y.k) + 1 AS k, sum(CASE WHEN t.b IS NOT NULL THEN y.p / n ELSE 0 END) AS p
    FROM sub x JOIN walk y ON y.query_id = x.query_id LEFT JOIN step t ON t.query_id = x.query_id AND t.b = x.node AND t.a = y.node
    LEFT JOIN sums u ON u.query_id = y.query_id AND u.a = y.node GROUP BY x.query_id, x.node) w
  ON w.query_id = s.query_id AND w.node = s.node WHERE w.k <= 50)"""
#: exp(iAt) e as a power series of eighty terms: the subgraphs' matrices have eigenvalues of a few tens at most.
SERIES = """
series AS (
  SELECT query_id, node, 0 AS k, CASE WHEN node = query_id THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM sub
  UNION ALL
  SELECT x.query_id, x.node, any_value(y.k) + 1, sum(CASE WHEN t.b IS NOT NULL THEN y.v ELSE 0 END) * 0.5 / (any_value(y.k) + 1)
  FROM sub x JOIN series y ON y.query_id = x.query_id LEFT JOIN step t ON t.query_id = x.query_id AND t.b = x.node AND t.a = y.node
  WHERE y.k < 80 GROUP BY x.query_id, x.node),
amplitude AS (SELECT query_id, node, sum(CASE k % 4 WHEN 0 THEN v WHEN 2 THEN -v ELSE 0 END) AS re, sum(CASE k % 4 WHEN 1 THEN v WHEN 3 THEN -v ELSE 0 END) AS im FROM series GROUP BY ALL),
likely AS (SELECT query_id, node, bfs_order, round(re * re + im * im, 12) AS p FROM amplitude JOIN sub USING (query_id, node)),
walked AS (SELECT query_id, node, p AS score, (row_number() OVER (PARTITION BY query_id ORDER BY p DESC, bfs_order))::INTEGER AS rank FROM likely WHERE node <> query_id)"""
DEGREES = """
both_ends AS (SELECT query_id, source AS node FROM inside UNION ALL SELECT query_id, target FROM inside),
degrees AS (SELECT s.query_id, s.node, count(b.node)::DOUBLE AS d FROM sub s LEFT JOIN both_ends b ON b.query_id = s.query_id AND b.node = s.node GROUP BY ALL)"""
CAPPED = f"{EGO}, {capped()}, {INSIDE}, {STEP}"
PAGERANK = f"WITH RECURSIVE {CAPPED}, {WALKED} SELECT query_id, node, round(round(p, 12), 9) AS pagerank FROM walk WHERE k = 50"
ABLATION = f"""
WITH RECURSIVE {CAPPED}, {WALKED}, {SERIES}, {DEGREES},
every AS (
  SELECT 'bfs_distance' AS ranker, query_id, node, dist::DOUBLE AS s FROM sub
  UNION ALL SELECT 'local_degree', query_id, node, -d FROM degrees
  UNION ALL SELECT 'local_pagerank', query_id, node, -round(p, 12) FROM walk WHERE k = 50
  UNION ALL SELECT 'ctqw', query_id, node, -p FROM likely),
placed AS (SELECT ranker, query_id, node, row_number() OVER (PARTITION BY ranker, query_id ORDER BY s, node) AS rank FROM every WHERE node <> query_id),
each AS (
  SELECT ranker, p.query_id, coalesce(1.0 / min(rank) FILTER (t.nbr IS NOT NULL), 0.0) AS rr, count(*) FILTER (t.nbr IS NOT NULL AND rank <= 5) / any_value(n_true) AS recall
  FROM placed p LEFT JOIN truth t ON t.id = p.query_id AND t.nbr = p.node JOIN picks k ON k.query_id = p.query_id GROUP BY ALL)
SELECT ranker, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall_5 FROM each GROUP BY ranker
"""
HYBRID = f"""
WITH RECURSIVE {ADDRESS}, {ELIGIBLE}, {samples(1, 20)}, {capped()}, {INSIDE}, {STEP}, {SERIES},
near AS (SELECT * FROM (
  SELECT b.id AS query_id, a.id, row_number() OVER (PARTITION BY b.id ORDER BY {hamming('a.', 'b.')}, a.id) AS rank FROM picks JOIN address b ON b.id = picks.query_id JOIN address a ON a.id <> b.id) WHERE rank <= 50),
parts AS (
  SELECT query_id, node AS id, rank, 0 AS part FROM walked WHERE rank <= 10
  UNION ALL SELECT n.query_id, n.id, n.rank, 1 FROM near n WHERE NOT EXISTS (SELECT 1 FROM walked w WHERE w.rank <= 10 AND w.query_id = n.query_id AND w.node = n.id))
SELECT query_id, place::INTEGER AS rank, CASE part WHEN 0 THEN 'ctqw' ELSE 'signature' END AS source, id
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS place FROM parts) WHERE place <= 10
"""
SIM = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT id, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM v),
sims AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 9) AS sim FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 20 = 0)
SELECT * FROM (SELECT query_id, id, sim, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id))::INTEGER AS rank FROM sims) WHERE rank <= 10
"""

BY_LABEL = """
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT id, label, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM v),
r AS (
  SELECT a.id AS query_id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.id) AS rank
  FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 20 = 0)
SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (same), 0.0), 9) AS rr,
       round(coalesce(count(*) FILTER (same AND rank <= 5) / nullif(count(*) FILTER (same), 0), 0.0), 9) AS recall FROM r GROUP BY query_id
"""

#: Vectors of the nodes whose number is that of a vector: the third method beside both kinds of address.
ENCODER = f"""
WITH {GRAPH}, {ELIGIBLE}, {samples(10, 50)},
v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM nodes JOIN embeddings ON vec_id = split_part(id, ':', 2)::BIGINT),
n AS (SELECT id, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS v FROM v),
r AS (
  SELECT q.query_id, a.id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, a.id) AS rank
  FROM (SELECT DISTINCT query_id FROM picks) q JOIN n b ON b.id = q.query_id JOIN n a ON a.id <> q.query_id),
each AS (
  SELECT p.query_id, coalesce(1.0 / min(rank) FILTER (t.nbr IS NOT NULL), 0.0) AS rr, count(*) FILTER (t.nbr IS NOT NULL AND rank <= 5) / any_value(n_true) AS recall
  FROM (SELECT DISTINCT query_id, n_true FROM picks) p LEFT JOIN r USING (query_id) LEFT JOIN truth t ON t.id = p.query_id AND t.nbr = r.id GROUP BY p.query_id)
SELECT seed, 'vector' AS method, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall_5 FROM picks JOIN each USING (query_id) GROUP BY seed"""

NEAR = f"""WITH d AS (SELECT doc_id AS id, text FROM documents), {simhash('d', 'content')},
one AS (SELECT min(id) AS id, u0, u1, u2, u3 FROM content GROUP BY u0, u1, u2, u3),
near AS (SELECT a, b, dist FROM (SELECT x.id AS a, y.id AS b, {hamming('x.', 'y.')} AS dist FROM one x JOIN one y ON x.id < y.id) WHERE dist <= 15)"""
SENSED, DECAY = (64, 128, 256, 512, 1024), ((1,), (2, 1), (4, 2, 1), (8, 4, 2, 1))


def sensed(widths=SENSED) -> str:
    """CTEs sensed{bits} (id, u0, ...): signs of sixteen hashed places of each member of an adjacency row."""
    out = """
members AS (SELECT id, nbr FROM truth JOIN nodes USING (id) UNION SELECT id, id FROM nodes),
words AS (SELECT id, ('0x' || substr(sha256('row:' || nbr), 4 * k + 1, 4))::UBIGINT AS w FROM members, range(16) t(k))"""
    for b in widths:
        limbs = ", ".join(f"coalesce(bit_or(1::UBIGINT << (place & 63)) FILTER (place >> 6 = {j}), 0) AS u{j}" for j in range(b // 64))
        out += f""",
places{b} AS (SELECT id, w & {b - 1} AS place FROM words GROUP BY ALL HAVING sum(CASE WHEN w < 32768 THEN 1 ELSE -1 END) > 0),
sensed{b} AS (SELECT id, {limbs} FROM nodes LEFT JOIN places{b} USING (id) GROUP BY id)"""
    return out


def deep(weights: tuple[int, ...]) -> str:
    """CTEs walk0, walk1, ... of all 256 counters, and deep{depth} (id, u0, ...): weighted votes of walks that don't turn back."""
    every = range(256)
    out = "walk0 AS (SELECT id, 1::BIGINT AS n, " + ", ".join(f"((u{k // 64} >> {k % 64}) & 1)::BIGINT AS p{k}" for k in every) + " FROM content)"
    for d in range(1, 4):
        back = "" if d == 1 else f" UNION ALL SELECT b.id, -(g.n - {int(d > 2)}) * b.n, " + ", ".join(f"-(g.n - {int(d > 2)}) * b.p{k}" for k in every) + f" FROM walk{d - 2} b JOIN walk1 g USING (id)"
        names = ", ".join(f"p{k}" for k in every)
        out += f""",
walk{d} AS (SELECT id, sum(n)::BIGINT AS n, {", ".join(f"sum(p{k})::BIGINT AS p{k}" for k in every)} FROM (
  SELECT e.id, n, {names} FROM ends e JOIN walk{d - 1} w ON w.id = e.nbr JOIN content c ON c.id = e.id{back}) GROUP BY id)"""
    for d, some in enumerate(weights):
        parts = " UNION ALL ".join(f"SELECT id, {w} * n AS n, " + ", ".join(f"{w} * p{k} AS p{k}" for k in every) + f" FROM walk{step}" for step, w in enumerate(some))
        limbs = ", ".join(" + ".join(f"(2 * sum(p{64 * j + b}) >= sum(n))::INTEGER::UBIGINT * {1 << b}::UBIGINT" for b in range(64)) + f" AS u{j}" for j in range(4))
        out += f", deep{d} AS (SELECT id, {limbs} FROM ({parts}) GROUP BY id)"
    return out


def sweep(parts: list[tuple[str, str]]) -> str:
    """MRR and recall of each index of scores, with the columns that tell it apart."""
    return " UNION ALL ".join(f"SELECT {what}, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall_5 FROM {name}" for name, what in parts)


TRADE = """
sold AS (SELECT 'customer:' || o_custkey AS c, 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
trade AS (SELECT c AS source, p AS target, 'buys' AS type FROM sold UNION SELECT c, s, 'orders_from' FROM sold UNION SELECT s, p, 'supplies' FROM sold),
degrees AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM trade UNION ALL SELECT target FROM trade) GROUP BY id),
triangles AS (
  SELECT b.source AS c, b.target AS p, o.target AS s
  FROM trade b JOIN trade o ON o.source = b.source AND o.type = 'orders_from' JOIN trade u ON u.source = o.target AND u.target = b.target AND u.type = 'supplies' WHERE b.type = 'buys')"""

RECORDS = """
SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS title, NULL::VARCHAR AS cluster, NULL::VARCHAR AS description FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL, NULL FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, NULL, NULL FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, c_mktsegment, NULL FROM customer
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_type, p_brand FROM part"""
#: Distances from the four nodes with most edges: ways of up to twelve edges, of which the shortest counts.
LANDMARKS = """
best AS (SELECT id AS landmark FROM ends GROUP BY id ORDER BY count(*) DESC, id LIMIT 4),
way AS (SELECT landmark, landmark AS id, 0 AS dist FROM best UNION SELECT landmark, nbr, dist + 1 FROM way JOIN truth USING (id) WHERE dist < 12),
reached AS (SELECT landmark, id, min(dist)::BIGINT AS dist FROM way GROUP BY landmark, id)"""
ITEMS = """
items AS (SELECT o_custkey AS custkey, l_orderkey AS orderkey, l_linenumber AS linenumber, l_suppkey AS suppkey, o_orderdate AS ordered, l_shipdate AS shipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

ORACLES: dict[str, str] = {
    "multiseed_encoder": f"{MULTISEED} SELECT * FROM seeds UNION ALL SELECT * FROM ({ENCODER})",
    "kg_nodes": f"WITH {NODES} SELECT id, type, text FROM nodes",
    "kg_edges": f"WITH {EDGES} SELECT * FROM edges",
    "node_texts": rf"WITH {NODES} SELECT id, coalesce(nullif(text, ''), '(empty)') AS text, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))::INTEGER AS n_tokens FROM nodes",
    "undirected_degree": f"WITH {EDGES} SELECT id, count(*) AS degree, count(DISTINCT nbr) AS n_true FROM ends GROUP BY id",
    "truth_neighbors": f"WITH {EDGES} SELECT id, nbr FROM truth",
    "eligible_queries": f"WITH {GRAPH}, {ELIGIBLE} SELECT * FROM eligible",
    "sample_queries": f"WITH {GRAPH}, {ELIGIBLE}, {samples(10, 50)} SELECT * FROM picks",
    "digest_baseline": f"WITH {NODES} SELECT id, " + ", ".join(f"({digest('text', j)}::BIT)::BIGINT AS l{j}" for j in range(4)) + " FROM nodes",
    "content_address": f"WITH {CONTENT} SELECT id, {SIGNED} FROM content",
    "topology_address": f"WITH {ADDRESS} SELECT id, {SIGNED} FROM address",
    "address_widths": f"WITH {ADDRESS} " + " UNION ALL ".join(f"SELECT id, {b}::INTEGER AS bits, {width(b)} AS address FROM address" for b in BITS),
    "documents_simhash": f"WITH d AS (SELECT doc_id AS id, text FROM documents), {simhash('d', 'content')} SELECT id, {SIGNED} FROM content",
    "documents_near": f"{NEAR} SELECT * FROM near",
    "documents_near_members": f"""{NEAR},
links AS (SELECT id AS representative, count(*) AS links FROM (SELECT a AS id FROM near UNION ALL SELECT b FROM near) GROUP BY id)
SELECT c.id, o.id AS representative, coalesce(links, 0) AS links FROM content c JOIN one o USING (u0, u1, u2, u3) LEFT JOIN links ON links.representative = o.id""",
    "hamming_topk_text": f"WITH {ADDRESS}, {of_text(TEXT, 'q')} SELECT a.id, {hamming('a.', 'q.')} AS dist FROM address a, q ORDER BY dist, a.id LIMIT 10",
    "hamming_topk_node": f"""WITH {ADDRESS} SELECT id, dist, coalesce(nullif(text, ''), '')[:60] AS name FROM (
SELECT a.id, {hamming('a.', 'b.')} AS dist FROM address a, address b WHERE b.id = 'nation:3' AND a.id <> 'nation:3' ORDER BY dist, a.id LIMIT 10) JOIN (
SELECT 'region:' || r_regionkey AS id, r_name AS text FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer
UNION ALL SELECT 'part:' || p_partkey, p_name FROM part) USING (id)""",
    "hamming_topk_exclude": f"WITH {ADDRESS}, {of_text(TEXT, 'q')} SELECT a.id, {hamming('a.', 'q.')} AS dist FROM address a, q WHERE a.id NOT LIKE 'supplier:%' ORDER BY dist, a.id LIMIT 10",
    "hamming_topk_batch": (BATCH := f"""WITH {ADDRESS} SELECT * FROM (
SELECT query_id, id, dist, (row_number() OVER (PARTITION BY query_id ORDER BY dist, id))::INTEGER AS rank FROM (
SELECT b.id AS query_id, a.id, {hamming('a.', 'b.')} AS dist FROM address a JOIN address b ON a.id <> b.id WHERE split_part(b.id, ':', 2)::BIGINT % 20 = 0)) WHERE rank <= 10"""),
    "hamming_index_topk": BATCH,
    "sensed_address": f"WITH {GRAPH}, {sensed((64, 128))} SELECT id, 64::INTEGER AS bits, {width(64)} AS address FROM sensed64 UNION ALL SELECT id, 128::INTEGER, {width(128)} FROM sensed128",
    "sensed_sweep": f"WITH {ADDRESS}, {ELIGIBLE}, {samples(1, 50)}, {sensed()}, {scores('address', 'picks', 'topo')}"
    + "".join(f", {scores(f'sensed{b}', 'picks', f's{b}', hamming('a.', 'b.', range(b // 64)))}" for b in SENSED)
    + " " + sweep([("topo", "'topology' AS method, 256::INTEGER AS bits"), *[(f"s{b}", f"'sensed', {b}::INTEGER") for b in SENSED]]),
    "depth_address": f"WITH {GRAPH}, {simhash('nodes', 'content')}, {deep(DECAY)} SELECT id, {SIGNED} FROM deep2",
    "depth_sweep": f"WITH {GRAPH}, {simhash('nodes', 'content')}, {deep(DECAY)}, {ELIGIBLE}, {samples(1, 50)}"
    + "".join(f", {scores(f'deep{d}', 'picks', f's{d}')}" for d in range(4))
    + " " + sweep([(f"s{d}", f"{d}::INTEGER AS depth") for d in range(4)]),
    "trade_clustering": f"""WITH {TRADE},
corners AS (SELECT id, count(*) AS n FROM (SELECT c AS id FROM triangles UNION ALL SELECT p FROM triangles UNION ALL SELECT s FROM triangles) GROUP BY id)
SELECT id, d AS degree, coalesce(n, 0) AS triangles, round(CASE WHEN d > 1 THEN 2.0 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, 9) AS clustering FROM degrees LEFT JOIN corners USING (id)""",
    "trade_census": f"""WITH {TRADE}, t AS (SELECT count(*) AS n FROM triangles), g AS (SELECT count(*) AS nodes, sum(d) // 2 AS edges, sum(d * (d - 1)) // 2 AS wedges, sum(d * (d - 1) * (d - 2)) // 6 AS stars FROM degrees)
SELECT 'nodes' AS motif, nodes::BIGINT AS n FROM g UNION ALL SELECT 'edges', edges::BIGINT FROM g UNION ALL SELECT 'wedges', wedges::BIGINT FROM g UNION ALL SELECT 'stars', stars::BIGINT FROM g
UNION ALL SELECT 'triangles', n FROM t UNION ALL SELECT 'open wedges', (wedges - 3 * n)::BIGINT FROM g, t UNION ALL SELECT 'buys+orders_from+supplies', n FROM t WHERE n > 0""",
    "landmark_distances": f"WITH RECURSIVE {EDGES}, {LANDMARKS} SELECT * FROM reached",
    "pair_distance_bounds": f"""WITH RECURSIVE {GRAPH}, {ELIGIBLE}, {samples(2, 50)}, {LANDMARKS},
placed AS (SELECT seed, query_id, row_number() OVER (PARTITION BY seed ORDER BY query_id) AS place FROM picks),
pairs AS (SELECT DISTINCT x.query_id AS a, y.query_id AS b FROM placed x JOIN placed y USING (place) WHERE x.seed = 0 AND y.seed = 1),
told AS (
  SELECT a, b, max(abs(x.dist - y.dist)) AS low, min(x.dist + y.dist) AS high, bool_or((x.dist IS NULL) <> (y.dist IS NULL)) AS apart
  FROM pairs CROSS JOIN best LEFT JOIN reached x ON x.landmark = best.landmark AND x.id = a LEFT JOIN reached y ON y.landmark = best.landmark AND y.id = b GROUP BY a, b),
bounds AS (SELECT a, b, CASE WHEN a = b THEN 0 WHEN NOT apart THEN low END AS lower, CASE WHEN a = b THEN 0 WHEN NOT apart THEN high END AS upper, a <> b AND apart AS apart FROM told)
SELECT a, b, lower, upper, coalesce(lower = upper, false) AS exact, apart FROM bounds""",
    "neighbour_rollup": f"""WITH {EDGES},
near AS (SELECT source AS id, target AS nbr, type, split_part(source, ':', 1) AS kind FROM edges UNION ALL SELECT target, source, type, split_part(target, ':', 1) FROM edges),
nodes AS (SELECT kind, type, id, count(*) AS degree FROM near GROUP BY ALL),
a AS (SELECT kind, type, grouping_id(kind, type) AS level, sum(degree)::BIGINT AS edges, count(*) AS nodes FROM nodes GROUP BY GROUPING SETS ((kind, type), (kind), (type), ())),
b AS (SELECT kind, type, grouping_id(kind, type) AS level, count(DISTINCT nbr) AS neighbours FROM near GROUP BY GROUPING SETS ((kind, type), (kind), (type), ()))
SELECT a.kind, a.type, a.level::INTEGER AS level, edges, nodes, neighbours, true AS close FROM a JOIN b ON a.level = b.level AND a.kind IS NOT DISTINCT FROM b.kind AND a.type IS NOT DISTINCT FROM b.type""",
    "order_at_shipping": f"""WITH {ITEMS}, days AS (SELECT o_custkey AS custkey, o_orderdate AS day, max(o_orderkey) AS key FROM orders GROUP BY ALL)
SELECT i.custkey, i.orderkey, i.linenumber, i.shipped, d.key AS latest_key, d.day AS latest_day FROM items i ASOF LEFT JOIN days d ON d.custkey = i.custkey AND d.day <= i.shipped""",
    "overlapping_edges": f"""WITH {ITEMS}, valid AS (SELECT custkey, suppkey, least(ordered, shipped) AS since, greatest(ordered, shipped) AS until FROM items)
SELECT a.custkey, count(*) AS pairs, count(DISTINCT (a.suppkey, b.suppkey)) AS suppliers FROM valid a JOIN valid b ON a.custkey = b.custkey AND a.suppkey < b.suppkey
WHERE a.since < a.until AND b.since < b.until AND greatest(a.since, b.since) < least(a.until, b.until) GROUP BY a.custkey""",
    "compose_xor_topk": f"""WITH {ADDRESS}, {of_text(TEXT, 'q')}, {of_text(OTHER, 'r')}, b AS (SELECT {", ".join(f"xor(q.u{j}, r.u{j}) AS u{j}" for j in range(4))} FROM q, r)
SELECT a.id, {hamming('a.', 'b.')} AS dist FROM address a, b ORDER BY dist, a.id LIMIT 10""",
    "bind_unbind_errors": f"""WITH {CONTENT}, k AS (SELECT *, {", ".join(f"{digest(chr(39) + 'key' + chr(39) + ' || id', j)} AS k{j}" for j in range(4))} FROM content),
b AS (SELECT *, {", ".join(f"xor(xor(u{j}, k{j}), k{j}) AS v{j}" for j in range(4))} FROM k)
SELECT count(*) AS trials, count(*) FILTER ({" OR ".join(f"u{j} <> v{j}" for j in range(4))}) AS errors FROM b""",
    "cosine_topk": SIM,
    "vector_lengths": "SELECT vec_id, round(list_inner_product(v, v), 6) AS before, round(list_inner_product(list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END), list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END)), 6) AS after FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
    "vectors_by_label": BY_LABEL,
    "multiseed": f"{MULTISEED} SELECT * FROM seeds",
    "multiseed_stats": f"""{MULTISEED} SELECT method, n, round(m, 7) AS mean, round(s, 7) AS std, round(m - 1.96 * s / sqrt(n), 7) AS low, round(m + 1.96 * s / sqrt(n), 7) AS high
FROM (SELECT method, count(*) AS n, avg(mrr) AS m, stddev_samp(mrr) AS s FROM seeds GROUP BY method)""",
    "multiseed_paired_t": f"""{MULTISEED}, d AS (SELECT a.mrr AS a, b.mrr AS b FROM seeds a JOIN seeds b USING (seed) WHERE a.method = 'topology' AND b.method = 'content'),
s AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s, avg(a) AS a, avg(b) AS b FROM d)
SELECT n, n - 1 AS df, round(m, 5) AS mean_diff, round(s, 5) AS std_diff, round(m / (s / sqrt(n)), 5) AS t, round(a / b, 5) AS ratio,
CASE WHEN n - 1 < 9 THEN '' WHEN abs(m / (s / sqrt(n))) > 4.781 THEN '***' WHEN abs(m / (s / sqrt(n))) > 3.250 THEN '**' WHEN abs(m / (s / sqrt(n))) > 2.262 THEN '*' ELSE '' END AS stars FROM s""",
    "bits_sweep": f"WITH {ADDRESS}, {ELIGIBLE}, {samples(1, 50)}, {scores('address', 'picks', 's128', hamming('a.', 'b.', range(2)))}, {scores('address', 'picks', 's256')}, {scores('address', 'picks', 's512', hamming('a.', 'b.', [*range(4)] * 2))}, {scores('address', 'picks', 's1024', hamming('a.', 'b.', [*range(4)] * 4))} "
    + "SELECT 128::INTEGER AS bits, round(avg(rr), 9) AS mrr, round(avg(recall), 9) AS recall_5 FROM s128"
    + "".join(f" UNION ALL SELECT {b}::INTEGER, round(avg(rr), 9), round(avg(recall), 9) FROM s{b}" for b in BITS[1:]),
    "bfs_two_hops": f"WITH {EGO}, {hops(2)} SELECT query_id, node, dist FROM sub",
    "induced_subgraph": f"WITH {EGO}, {hops(2)}, {INSIDE} SELECT query_id, count(*) AS edges FROM inside GROUP BY query_id",
    "bfs_capped": f"WITH {EGO}, {capped()} SELECT * FROM sub",
    "rank_bfs_distance": f"WITH {EGO}, {capped()}, scored AS (SELECT query_id, node, dist::DOUBLE AS d FROM sub) {ranking('d', 'd')}",
    "rank_degree": f"WITH {CAPPED}, {DEGREES}, scored AS (SELECT * FROM degrees) {ranking('d', 'd DESC')}",
    "local_pagerank": PAGERANK,
    "ctqw_topk": f"WITH RECURSIVE {CAPPED}, {SERIES} SELECT query_id, node, round(score, 9) AS score, rank FROM walked WHERE rank <= 10",
    "hybrid_topk": HYBRID,
    "ranker_ablation": ABLATION,
    "walk_scores": f"""WITH RECURSIVE {CAPPED}, {SERIES}
SELECT k.query_id, round(coalesce(1.0 / min(rank) FILTER (t.nbr IS NOT NULL), 0.0), 9) AS rr, round(count(*) FILTER (t.nbr IS NOT NULL AND rank <= 5) / any_value(n_true), 9) AS recall
FROM picks k LEFT JOIN (SELECT * FROM walked WHERE rank <= 100) w USING (query_id) LEFT JOIN truth t ON t.id = w.query_id AND t.nbr = w.node GROUP BY k.query_id""",
    "ablation_verdict": f"""WITH r AS ({ABLATION}),
w AS (SELECT max(mrr) FILTER (ranker = 'bfs_distance') AS bfs_distance, max(mrr) FILTER (ranker = 'ctqw') AS ctqw FROM r),
b AS (SELECT ranker, mrr FROM r WHERE ranker <> 'ctqw' ORDER BY mrr DESC, ranker LIMIT 1)
SELECT bfs_distance, ctqw, CASE WHEN bfs_distance >= 0.95 * ctqw THEN 'marginal' WHEN ctqw > bfs_distance + 0.05 THEN 'substantial' ELSE 'close' END AS verdict, ranker AS best_baseline, mrr AS best_mrr FROM w, b""",
    "method_verdict": f"""{MULTISEED}, m AS (SELECT method, avg(mrr) AS mean, avg(recall_5) AS recall FROM seeds GROUP BY method),
w AS (SELECT max(mean) FILTER (method = 'topology') AS t, max(mean) FILTER (method = 'content') AS c, max(recall) FILTER (method = 'topology') AS r FROM m)
SELECT method AS best, round(mean, 9) AS mean, CASE WHEN t > c + 0.05 THEN 'signature' WHEN c > t + 0.05 THEN 'encoder' ELSE 'close' END AS ahead, t > 0.0 AND t < 1.0 AS mrr_in_range, r > 0.5 AND r < 1.0 AS recall_in_range
FROM m, w ORDER BY mean DESC, method DESC LIMIT 1""",
    "storage_table": f"WITH {NODES} SELECT type, count(*) AS nodes, 32 * count(*) AS signature_bytes, 1536 * count(*) AS vector_bytes, 48.0::DOUBLE AS ratio FROM nodes GROUP BY type",
    "lines_nodes": RECORDS,
    "lines_edges": f"WITH {EDGES} SELECT source, target, type FROM edges",
    "line_files_parts": "SELECT 'part:' || p_partkey AS id, p_name AS title, p_brand AS description FROM part",
    "results_csv": f"WITH {EDGES}, d AS (SELECT id, count(*) AS n FROM ends GROUP BY id) SELECT split_part(id, ':', 1) AS type, count(*) AS nodes, printf('%.4f', avg(n))::DOUBLE AS degree FROM d GROUP BY ALL",
    "sql_nearest": f"WITH {ADDRESS}, {of_text(TEXT, 'q')} SELECT a.id, {hamming('a.', 'q.')} AS dist FROM address a, q ORDER BY dist, a.id LIMIT 10",
    "sanitize_nodes": f"WITH {SANITIZED} SELECT * FROM clean",
    "sanitize_edges": f"WITH {EDGES} SELECT source, target, type FROM edges",
    "edge_integrity": f"WITH {GRAPH} SELECT DISTINCT id FROM ends WHERE id NOT IN (SELECT id FROM nodes WHERE type <> 'region')",
    "field_counts": f"WITH {PRIVATE} SELECT count(*) FILTER (title <> '') AS titles, count(*) FILTER (chain <> '' OR status <> '') AS placed FROM private",
    "sensitive_scan": f"WITH {SANITIZED} SELECT pattern, coalesce((SELECT bool_or(contains(concat_ws(' ', id, type, label, status, cluster), pattern)) FROM clean), false) AS found FROM (VALUES "
    + ", ".join(f"('{p}')" for p in (*SENSITIVE, "Supplier#", "unheard"))
    + ") t(pattern)",
}
