"""python -m brindle.cli: queries over a graph in JSON lines."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import node_text
from .operators import evaluate, graph, retrieval, signatures, walk
from .sources.jsonl import load_graph
from .storage import written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brindle")
    top.add_argument("--nodes", required=True)
    top.add_argument("--edges", required=True)
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="nearest nodes; two texts take precedence over one, one over a node")
    search.add_argument("--bits", type=int, default=256)
    search.add_argument("--query")
    search.add_argument("--query-and", nargs=2, metavar=("A", "B"))
    search.add_argument("--node")
    search.add_argument("--k", type=int, default=10)
    local = commands.add_parser("walk", help="likeliest nodes of a walk from a node")
    local.add_argument("--query-id", required=True)
    local.add_argument("--subgraph-size", type=int, default=50)
    local.add_argument("--k", type=int, default=10)
    local.add_argument("--t", type=float, default=0.5)
    bench = commands.add_parser("evaluate", help="MRR and recall of both kinds of address")
    bench.add_argument("--seed", type=int, default=33)
    bench.add_argument("--queries", type=int, default=50)
    return top


def run(spark: SparkSession, args: Sequence[str] | None = None) -> DataFrame:
    """The result of a command line."""
    a = parser().parse_args(args)
    nodes, edges = load_graph(spark, a.nodes, a.edges)
    fields = ("title", "label", "cluster", "description", "domain_a", "domain_b", "falsifiable_test")
    texts, near = nodes.select("id", node_text(*[F.col(c) for c in fields]).alias("text")), graph.undirected(edges)
    if a.command == "walk":
        sub = graph.bfs_subgraph(spark.createDataFrame([(a.query_id,)], "query_id string"), near, a.subgraph_size)
        found = walk.walk_top_k(walk.local_scores(sub, edges, t=a.t), a.k).withColumnRenamed("node", "id")
        return retrieval.decorated(found, nodes).orderBy("rank")
    plain = written(signatures.simhash_arrow(texts), "content")
    index = written(signatures.topology(plain, near), "index")
    if a.command == "evaluate":
        chosen, truth = written(evaluate.sampled(graph.eligible(nodes, edges), (a.seed,), a.queries), "samples"), graph.true_neighbors(edges)
        parts = [evaluate.seed_means(evaluate.query_scores(x, chosen, truth), chosen, m) for x, m in ((plain, "content"), (index, "topology"))]
        return parts[0].unionByName(parts[1]).orderBy("method")
    from .functions.bits import limbs_of, resized

    index = index.select("id", *resized(limbs_of(), a.bits))
    if a.query_and:
        found = retrieval.composed_query(index, *a.query_and, a.k)
    elif a.query:
        found = retrieval.text_query(index, a.query, a.k)
    else:
        found = retrieval.node_query(index, a.node, a.k)
    return retrieval.decorated(found, nodes).orderBy("dist", "id")


if __name__ == "__main__":
    run(SparkSession.builder.appName("brindle").getOrCreate()).show(100, truncate=False)
