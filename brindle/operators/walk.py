"""Rankers inside bounded subgraphs: distance, degree, personalised PageRank, continuous-time walk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import induced_edges

#: Nodes of a subgraph of which the walk is computed at most: it alone needs a matrix.
WALK_NODES = 2_000
#: Decimal places that scores are rounded to, so that equal scores tie on every machine.
PLACES = 12


def adjacency(n: int, pairs: np.ndarray) -> np.ndarray:
    """0/1 symmetric matrix; parallel edges are one, a self-loop stands on the diagonal."""
    a = np.zeros((n, n))
    if len(pairs):
        a[pairs[:, 0], pairs[:, 1]] = a[pairs[:, 1], pairs[:, 0]] = 1
    return a


def ctqw(a: np.ndarray, start: int, t: float = 0.5) -> np.ndarray:
    """Probabilities |exp(iAt) e_start|^2, by the matrix's eigenvectors: no series that would end too soon."""
    values, vectors = np.linalg.eigh(a)
    amplitude = vectors @ (np.exp(1j * values * t) * vectors[start])
    return np.abs(amplitude) ** 2


def sparse_pagerank(n: int, pairs: np.ndarray, start: int, alpha: float = 0.85, rounds: int = 50) -> np.ndarray:
    """`pagerank` from a list of edges, in memory that grows with nodes and edges."""
    both = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0) if len(pairs) else pairs
    source, target = both[:, 0], both[:, 1]
    out = np.maximum(np.bincount(source, minlength=n), 1)
    jump = np.zeros(n)
    jump[start] = 1
    p = jump
    for _ in range(rounds):
        p = alpha * np.bincount(target, (p / out)[source], n) + (1 - alpha) * jump
    return p


def pagerank(a: np.ndarray, start: int, alpha: float = 0.85, rounds: int = 50) -> np.ndarray:
    """Personalised PageRank after a fixed number of rounds; rows without edges lose their mass."""
    sums = a.sum(axis=1, keepdims=True)
    step = a / np.where(sums == 0, 1, sums)
    jump = np.zeros(len(a))
    jump[start] = 1
    p = jump.copy()
    for _ in range(rounds):
        p = alpha * (step.T @ p) + (1 - alpha) * jump
    return p


def local_scores(subgraph: DataFrame, edges: DataFrame, t: float = 0.5, alpha: float = 0.85, rounds: int = 50, walked: bool = True) -> DataFrame:
    """query_id, node, bfs_order, dist, degree, pagerank, ctqw of every subgraph's nodes; the query is one of them.

    Each subgraph is one group, of its nodes and edges; the walk alone needs a matrix, and takes at most `WALK_NODES` nodes
    (more are an error). Without `walked` ctqw is null. Degree counts edge ends, so a self-loop counts twice. Repeated
    rows and parallel edges are told as `bfs_subgraph` and `induced_edges` give them; no subgraph gives no row.
    """
    kind = subgraph.schema["query_id"].dataType.simpleString()

    def scores(nodes: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("bfs_order").reset_index(drop=True)
        place = {n: k for k, n in enumerate(nodes["node"])}
        pairs = np.array([(place[s], place[x]) for s, x in zip(inside["source"], inside["target"], strict=True)], np.int64).reshape(-1, 2)
        n = len(nodes)
        if walked and n > WALK_NODES:
            raise ValueError(f"the walk takes subgraphs of at most {WALK_NODES} nodes, not {n}")
        found = np.round(ctqw(adjacency(n, pairs), 0, t), PLACES) if walked else np.full(n, None)
        ends = np.bincount(pairs.ravel(), minlength=len(nodes))
        return nodes.assign(degree=ends.astype("int64"), pagerank=np.round(sparse_pagerank(n, pairs, 0, alpha, rounds), PLACES), ctqw=found)[["query_id", "node", "bfs_order", "dist", "degree", "pagerank", "ctqw"]]

    inside = induced_edges(subgraph, edges).select(F.col("query_id").alias("of"), "source", "target")
    return subgraph.groupBy("query_id").cogroup(inside.groupBy("of")).applyInPandas(scores, f"query_id {kind}, node {kind}, bfs_order int, dist int, degree bigint, pagerank double, ctqw double")


#: Rankers by name: the score's column and whether more is better.
RANKERS = {"bfs_distance": ("dist", False), "local_degree": ("degree", True), "local_pagerank": ("pagerank", True), "ctqw": ("ctqw", True)}


def ranked(scores: DataFrame, ranker: str, ties: str = "node") -> DataFrame:
    """query_id, node, score, rank without the queries themselves; ties by node, or by `bfs_order`.

    Subgraphs of fewer than two nodes give nothing. Null scores come last, repeated nodes each have a rank.
    """
    column, more = RANKERS[ranker]
    others = scores.where("node <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(column) if more else F.asc(column), ties)
    return others.select("query_id", "node", F.col(column).cast("double").alias("score"), F.row_number().over(order).alias("rank"))


def walk_top_k(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k likeliest nodes of each walk, ties in breadth-first order."""
    return ranked(scores, "ctqw", "bfs_order").where(F.col("rank") <= k)


def hybrid(walked: DataFrame, near: DataFrame, k: int = 10, first: str = "ctqw", second: str = "signature") -> DataFrame:
    """The walk's list, filled up to k with the nearest by signature that it lacks: query_id, rank, source, id.

    `walked` has query_id, node, rank; `near` query_id, id, rank (a query that has no address is in neither).
    """
    a = walked.select("query_id", F.col("node").alias("id"), F.col("rank"), F.lit(0).alias("part"))
    b = near.select("query_id", "id", "rank", F.lit(1).alias("part")).join(a.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("part", "rank")
    both = a.unionByName(b.select(*a.columns)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return both.select("query_id", F.col("place").alias("rank"), F.when(F.col("part") == 0, first).otherwise(second).alias("source"), "id")
