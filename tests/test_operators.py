"""Micro-graphs with answers by hand, and comparisons with plain Python."""

import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import bits
from brindle.operators import evaluate, graph, retrieval, sanitize, signatures, walk
from brindle.plans import queries

EDGES = "source string, target string, type string, edge_seq int"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "t", k) for k, (a, b) in enumerate(pairs)], EDGES)


def index_of(spark, texts, pairs):
    nodes = spark.createDataFrame(list(texts.items()), "id string, text string")
    found = signatures.build_addresses(nodes, graph.undirected(edges_of(spark, pairs)))
    return {r[0]: sum((x & (1 << 64) - 1) << 64 * j for j, x in enumerate(r[1:])) for r in found.collect()}


def number(text):
    return sum((x & (1 << 64) - 1) << 64 * j for j, x in enumerate(bits.address_of(text)))


TEXTS = {"a": "alpha one", "b": "beta two", "c": "gamma three", "d": ""}


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([], lambda n: dict(n)),
        ([("a", "b")], lambda n: dict(n)),
        ([("a", "b"), ("b", "c")], lambda n: dict(n) | {"b": n["b"] | n["a"] & n["c"]}),
        ([("a", "b"), ("a", "b")], lambda n: dict(n) | {"a": n["a"] | n["b"], "b": n["a"] | n["b"]}),
        ([("a", "a")], lambda n: dict(n)),
        ([("a", "ghost"), ("", "a"), (None, "b")], lambda n: dict(n)),
    ],
)
def test_topology_micro_graphs(spark, pairs, want):
    assert index_of(spark, TEXTS, pairs) == want({k: number(t) for k, t in TEXTS.items()})


def test_topology_star(spark):
    texts = {"hub": "hub"} | {f"x{k}": f"leaf {k}" for k in range(5)}
    got = index_of(spark, texts, [("hub", f"x{k}") for k in range(5)])
    base = {k: number(t) for k, t in texts.items()}
    want = sum(1 << b for b in range(256) if 2 * (2 * (base["hub"] >> b & 1) + sum(base[f"x{k}"] >> b & 1 for k in range(5))) >= 7)
    assert got["hub"] == want


def test_top_k_and_ties(spark):
    nodes = spark.createDataFrame([("b", "same", 0), ("a", "same", 1), ("c", "other", 2)], "id string, text string, node_seq int")
    index = signatures.simhash(nodes).join(nodes.select("id", "node_seq"), "id")
    query = bits.literal(bits.address_of("same"))
    assert [r["id"] for r in retrieval.top_k(index, query, 2).collect()] == ["a", "b"]
    assert [r["id"] for r in retrieval.top_k(index, query, 2, order=("node_seq",)).collect()] == ["b", "a"]
    assert [r["id"] for r in retrieval.top_k(index, query, 9, exclude=["a"]).collect()] == ["b", "c"]
    assert [r["id"] for r in retrieval.text_query(index, "same", 1).collect()] == ["a"]
    assert [r["id"] for r in retrieval.node_query(index, "a", 1).collect()] == ["b"]
    assert retrieval.node_query(index, "nobody").count() == 0
    assert retrieval.top_k(index.limit(0), query).count() == 0


def test_batch_equals_single(spark):
    r = random.Random(3)
    rows = [(f"n{k:03d}", *[r.getrandbits(64) - (1 << 63) for _ in range(4)]) for k in range(120)] + [("twin", *([7] * 4)), ("twin2", *([7] * 4))]
    index = spark.createDataFrame(rows, "id string, l0 long, l1 long, l2 long, l3 long").repartition(3)
    asked = index.where("id in ('n000', 'n050', 'twin')").withColumnRenamed("id", "query_id")
    got = defaultdict(list)
    for x in retrieval.top_k_batch(index, asked, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["dist"], x["id"]))
    table = {x[0]: x[1:] for x in rows}
    for q, found in got.items():
        want = sorted((sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(v, table[q], strict=True)), i) for i, v in table.items() if i != q)[:5]
        assert found == want


def test_cosine(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    r = random.Random(8)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(90)] + [(200, [0.0] * 6), (201, None), (202, [2.0] + [0.0] * 5), (203, [3.0] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = df.where("id in (0, 5, 200, 201, 202)").withColumnRenamed("id", "query_id")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v}
    want = {(q, i, n) for q in (0, 5, 200, 202) for n, (_, i) in enumerate(sorted((-round(float(unit[q] @ v), 9) + 0.0, i) for i, v in unit.items() if i != q)[:4], 1)}
    assert {(x["query_id"], x["id"], x["rank"]) for x in retrieval.cosine_top_k(df, asked, 4).collect()} == want


def test_members_of_near_documents(spark, tmp_path):
    """Every document is told, copies with and without other neighbours too."""
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(300)) for _ in range(6)]
    texts = [base[0], base[0] + " w1", base[0], base[1], base[1].upper(), base[1], base[2], base[3], "", ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    address = {k: bits.address_of(t) for k, t in enumerate(texts)}
    first = {k: min(j for j in address if address[j] == address[k]) for k in address}
    dist = lambda x, y: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(address[x], address[y], strict=True))
    links = {k: sum(j != k and dist(j, k) <= 15 for j in set(first.values())) for k in set(first.values())}
    got = queries.QUERIES["documents_near_members"](spark, str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == [(k, first[k], links[first[k]]) for k in sorted(address)]
    assert (links[0], links[3]) == (1, 0) and [first[k] for k in (2, 5, 9)] == [0, 3, 8]


def queue_bfs(pairs, query, most):
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    order, seen, queue = [query], {query}, deque([query])
    while queue and len(order) < most:
        for n in near[queue.popleft()]:
            if n not in seen and len(order) < most:
                seen.add(n)
                order.append(n)
                queue.append(n)
    return order


def test_bfs_is_a_queue(spark):
    r = random.Random(11)
    for most in (1, 2, 7, 50):
        pairs = [(f"v{r.randrange(14)}", f"v{r.randrange(14)}") for _ in range(22)]
        near = graph.undirected(edges_of(spark, pairs))
        queries = spark.createDataFrame([("v0",), ("v5",), ("nobody",)], "query_id string")
        got = defaultdict(list)
        for x in graph.bfs_subgraph(queries, near, most).orderBy("query_id", "bfs_order").collect():
            got[x["query_id"]].append(x["node"])
        assert got == {q: queue_bfs(pairs, q, most) for q in ("v0", "v5", "nobody")}


def test_bfs_cap_on_a_star(spark):
    near = graph.undirected(edges_of(spark, [("hub", f"x{k:02d}") for k in range(60)]))
    got = graph.bfs_subgraph(spark.createDataFrame([("hub",)], "query_id string"), near, 50).orderBy("bfs_order").collect()
    assert [x["node"] for x in got] == ["hub"] + [f"x{k:02d}" for k in range(49)]


def test_bfs_without_a_cap(spark):
    near = graph.undirected(edges_of(spark, [("hub", f"x{k:02d}") for k in range(60)] + [("x07", f"y{k}") for k in range(9)]))
    asked = spark.createDataFrame([("hub",), ("y0",)], "query_id string")
    got = graph.bfs_subgraph(asked, near, None, 2).groupBy("query_id").agg(F.count("*"), F.max("dist"), F.max("bfs_order")).collect()
    assert {tuple(x) for x in got} == {("hub", 70, 2, 70), ("y0", 11, 2, 11)}


def test_registered_subgraphs_have_no_cap(spark, monkeypatch):
    given = []
    monkeypatch.setattr(graph, "bfs_subgraph", lambda asked, near, most, hops: given.append((most, hops)) or asked)
    monkeypatch.setattr(queries, "samples", lambda *_: spark.createDataFrame([("a",)], "query_id string"))
    monkeypatch.setattr(queries, "kg_edges", lambda *_: edges_of(spark, [("a", "b")]))
    queries.ego(spark, "", 2)
    assert given == [(None, 2)]


def test_vector_scores_at_any_depth(spark):
    r = random.Random(13)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(3)], r.choice("ab")) for k in range(200)] + [(k, [-1.0, 0.0, 0.01 * (k - 1200)], "c") for k in range(200, 1400)]
    rows += [(1400, [1.0, 0.0, 0.0], "d"), (1401, [-1.0, 0.0, 0.0], "d"), (1402, None, "a"), (1403, [0.0, 0.0, 0.0], "e")]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label string").repartition(3)
    asked = v.where("id in (3, 4, 5, 300, 1400, 1401, 1402, 1403)").withColumnRenamed("id", "query_id")
    truth = asked.select(F.col("query_id").alias("id"), "label").join(v.select(F.col("id").alias("nbr"), "label"), "label").where("id <> nbr").select("id", "nbr")
    unit = {k: np.array(x) / (np.linalg.norm(x) or 1) for k, x, _ in rows if x}
    label, want = {k: c for k, _, c in rows}, {}
    for q in (3, 4, 5, 300, 1400, 1401, 1402, 1403):
        order = sorted((-round(float(unit[q] @ unit[k]), 9) + 0.0, k) for k in unit if k != q) if q in unit else []
        hits = [n + 1 for n, (_, k) in enumerate(order) if label[k] == label[q]]
        true = sum(c == label[q] for k, c in label.items() if k != q)
        want[q] = (round(1 / hits[0], 9) if hits else 0.0, round(sum(h <= 5 for h in hits) / true, 9) if true else 0.0)
    got = {x["query_id"]: (round(x["rr"], 9), round(x["recall"], 9)) for x in evaluate.vector_scores(v, asked, truth).collect()}
    assert got == want and 0 < got[1400][0] < 1 / 1000


def test_walks_by_hand():
    k2, path3 = np.array([[0, 1], [1, 0]], float), np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], float)
    assert walk.ctqw(k2, 0)[1] == pytest.approx(math.sin(0.5) ** 2)
    assert walk.ctqw(path3, 1) == pytest.approx([0.2110140763086564, 0.5779718473826871, 0.2110140763086564])
    assert walk.pagerank(path3, 0) == pytest.approx([0.34533822, 0.45932357, 0.19533822], abs=1e-8)
    k50 = np.ones((50, 50)) - np.eye(50)
    assert walk.ctqw(k50, 0).sum() == pytest.approx(1)


def test_local_rankers(spark):
    pairs = [("a", "b"), ("b", "c"), ("b", "c"), ("c", "c"), ("x", "y")]
    edges = edges_of(spark, pairs)
    sub = graph.bfs_subgraph(spark.createDataFrame([("a",), ("lone",)], "query_id string"), graph.undirected(edges), 50)
    scores = walk.local_scores(sub, edges)
    assert {(x["node"], x["degree"]) for x in scores.where("query_id = 'a'").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert [x["node"] for x in walk.ranked(scores, "local_degree").where("query_id = 'a'").orderBy("rank").collect()] == ["c", "b"]
    assert [x["node"] for x in walk.ranked(scores, "bfs_distance").where("query_id = 'a'").orderBy("rank").collect()] == ["b", "c"]
    assert walk.walk_top_k(scores).where("query_id = 'lone'").count() == 0


def test_hybrid(spark):
    walked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, node string, rank int")
    near = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("q", "d", 3)], "query_id string, id string, rank int")
    got = walk.hybrid(walked, near, 3).orderBy("rank").collect()
    assert [(x["source"], x["id"]) for x in got] == [("ctqw", "a"), ("ctqw", "b"), ("signature", "c")]


def test_scores_and_truth(spark):
    edges = edges_of(spark, [("a", "b"), ("a", "ghost"), ("a", "a"), ("b", "c")])
    truth = graph.true_neighbors(edges)
    assert {r["nbr"] for r in truth.where("id = 'a'").collect()} == {"b", "ghost", "a"}
    index = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 3, 0, 0, 0), ("c", 1, 0, 0, 0)], "id string, l0 long, l1 long, l2 long, l3 long")
    got = evaluate.query_scores(index, spark.createDataFrame([("a",)], "query_id string"), truth).first()
    assert (got["rr"], got["recall"]) == (0.5, pytest.approx(1 / 3))
    nodes = index.select("id")
    assert {r["query_id"]: r["n_true"] for r in graph.eligible(nodes, edges).collect()} == {"a": 3, "b": 2}
    assert [r["id"] for r in graph.endpoints_missing(nodes, edges).collect()] == ["ghost"]


def test_statistics(spark):
    rows = [(0, 1.0, 0.5), (1, 1.0, 0.25), (2, 0.5, 0.5), (3, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "seed int, a double, b double")
    got = evaluate.paired_t(df, "a", "b").first()
    d = [0.5, 0.75, 0.0, 1.0]
    m, s = np.mean(d), np.std(d, ddof=1)
    assert (got["n"], got["df"], got["stars"]) == (4, 3, "")
    assert (got["mean_diff"], got["t"]) == (pytest.approx(m), pytest.approx(m / (s / 2)))
    one = evaluate.spread(spark.createDataFrame([("x", 0.5)], "method string, mrr double"), "method", "mrr").first()
    assert (one["std"], one["low"], one["high"]) == (0.0, 0.5, 0.5)
    assert evaluate.paired_t(df.withColumn("b", F.col("a")), "a", "b").first()["t"] is None
    assert evaluate.paired_t(df.withColumn("b", F.lit(0.0)), "a", "b").first()["ratio"] == float("inf")


def test_published_t(spark):
    a = [0.8987, 0.9124, 0.9033, 0.9301, 0.8551, 0.8763, 0.9900, 0.8961, 0.9412, 0.9350]
    b = [0.2880, 0.2967, 0.2308, 0.3465, 0.2674, 0.2217, 0.3144, 0.2413, 0.2432, 0.2002]
    got = evaluate.paired_t(spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double"), "a", "b").first()
    assert (round(got["t"], 3), got["df"], got["stars"], round(got["ratio"], 3)) == (41.785, 9, "***", 3.448)


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.95, 1.0), (0.9, 1.0), (0.7, 0.74)], "d double, w double")
    assert [r[0] for r in rows.select(evaluate.walk_verdict(F.col("d"), F.col("w"))).collect()] == ["marginal", "substantial", "close"]
    assert [r[0] for r in rows.select(evaluate.encoder_verdict(F.col("w"), F.col("d"))).collect()] == ["close", "signature", "close"]
    means = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "method string, mean double")
    assert evaluate.best_of(means, ["a", "b", "c"]).first()["method"] == "a"


def test_shuffle_compatibility():
    digits = [str(k) for k in range(10)]
    assert evaluate.sampled_shuffle(digits, 0, 10) == list("7815342096")
    assert evaluate.sampled_shuffle(digits, 33, 10) == list("0451786329")


def test_sanitize(spark):
    rows = [("n1", None, "n1", "quantum_biology_H3", "active"), ("n2", "gap", "a—b", None, "odd"), ("n3", None, "", "unknown", None), ("n4", "x", "n4", None, "")]
    nodes = spark.createDataFrame(rows, "id string, type string, label string, chain string, status string")
    got = {r["id"]: tuple(r)[1:] for r in sanitize.sanitized_nodes(nodes).collect()}
    assert got == {"n1": ("unknown", "quantum biology algorithm", "active", "quantum_biology_H3"), "n2": ("gap", "a-b", "odd", None), "n3": ("unknown", "n3", "", None), "n4": ("x", "n4", "", None)}
    assert {r["pattern"]: r["found"] for r in sanitize.pattern_scan(nodes, ("quantum", "nothing")).collect()} == {"quantum": True, "nothing": False}
    assert not any(r["found"] for r in sanitize.pattern_scan(nodes.limit(0).select("id")).collect())
    assert tuple(sanitize.field_counts(nodes, {"a": ("type",), "b": ("chain", "status")}).first()) == (2, 3)


def test_vectors_that_take_no_part(spark):
    """Null, NaN and infinite components, empty vectors and other dimensions give no NaN and hide no sound vector."""
    r = np.random.default_rng(4)
    sound = [(k, r.normal(size=3).tolist()) for k in range(40)]
    odd = [(100 + k, [1.0, None, 2.0]) for k in range(12)] + [(200, None), (201, []), (202, [float("nan"), 1.0, 0.0]), (203, [float("inf"), 1.0, 0.0]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (302, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(sound + odd, "id long, vector array<double>").repartition(3)
    asked = df.where("id in (0, 7, 100, 201, 203, 300)").withColumnRenamed("id", "query_id").selectExpr("*", "1 as id", "2 as sim")
    got = {}
    for x in retrieval.cosine_top_k(df.selectExpr("*", "7 as v"), asked, 10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["id"], x["sim"]))
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in [*sound, (302, [0.0, 0.0, 0.0])]}
    for q in (0, 7):
        want = sorted((-round(float(unit[q] @ v), 9) + 0.0, k) for k, v in unit.items() if k != q)[:10]
        assert [(k, s) for _, k, s in sorted(got[q])] == [(k, pytest.approx(-s, abs=2e-9)) for s, k in want]
    assert [k for _, k, _ in got[300]] == [301] and set(got) == {0, 7, 300}
    assert retrieval.cosine_top_k(df.limit(0), asked).collect() == []


def test_columns_like_limbs(spark):
    nodes = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "alpha")], "id string, text string")
    plain = signatures.simhash(nodes)
    more = plain.selectExpr("*", "5L as l9", "'x' as l10", "3 as l_1")
    for found in (retrieval.text_query(more, "alpha", 3), retrieval.node_query(more, "a", 2), retrieval.composed_query(more, "alpha", "beta", 3)):
        assert max(r["dist"] for r in found.collect()) <= 256
    assert [(r["id"], r["dist"]) for r in retrieval.text_query(more, "alpha", 3).collect()] == [(r["id"], r["dist"]) for r in retrieval.text_query(plain, "alpha", 3).collect()]
    wide = plain.selectExpr("*", "7L as l4")
    assert [tuple(r) for r in retrieval.text_query(wide, "alpha", 3, bits=256).collect()] == [tuple(r) for r in retrieval.text_query(plain, "alpha", 3).collect()]


def test_sparse_pagerank():
    r = random.Random(5)
    for n in (1, 2, 7, 30):
        pairs = np.array([(r.randrange(n), r.randrange(n)) for _ in range(2 * n)], np.int64).reshape(-1, 2)
        assert walk.sparse_pagerank(n, pairs, 0) == pytest.approx(walk.pagerank(walk.adjacency(n, pairs), 0))
    assert walk.sparse_pagerank(3, np.zeros((0, 2), np.int64), 1) == pytest.approx(walk.pagerank(np.zeros((3, 3)), 1))


def test_walk_refuses_large_subgraphs(spark, monkeypatch):
    monkeypatch.setattr(walk, "WALK_NODES", 2)
    near = graph.undirected(edges_of(spark, [("a", "b"), ("a", "c")]))
    sub = graph.bfs_subgraph(spark.createDataFrame([("a",)], "query_id string"), near)
    with pytest.raises(Exception, match="at most 2 nodes"):
        walk.local_scores(sub, edges_of(spark, [("a", "b"), ("a", "c")])).collect()
    assert walk.local_scores(sub, edges_of(spark, [("a", "b"), ("a", "c")]), walked=False).count() == 3


def test_hamming_rate():
    assert evaluate.hamming_rate(1000) > 0
