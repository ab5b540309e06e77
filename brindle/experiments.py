"""python -m brindle.experiments NAME --tables DIR --out DIR: whole experiments that also write their tables as CSV."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .plans import queries
from .sources.jsonl import write_lines, write_results
from .storage import written


def benchmark(spark: SparkSession, tables: str, seed: int = 33) -> dict[str, DataFrame]:
    """One seed's whole run: both kinds of address, the widths, the walk, binding and taking apart, the kernel's rate, a node's storage, and the checks."""
    one = lambda values: spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))
    methods = written(queries.multiseed(spark, tables, (seed,)), "methods")
    walked = written(queries.walk_scores(spark, tables, seed), "walk")
    errors = queries.bind_unbind_errors(spark, tables)
    means = methods.agg(*[F.max(F.when(F.col("method") == m, F.col("mrr"))).alias(m) for m in ("content", "topology")])
    walk_means = walked.agg(F.avg("rr").alias("mrr"), F.avg("recall").alias("recall_5"))
    checks = [
        means.select(F.lit("topology above content").alias("check"), (F.col("topology") > F.col("content")).alias("holds")),
        walk_means.select(F.lit("walk below or at 1").alias("check"), evaluate.within(F.col("mrr"), 0.0, 1.0 + 1e-9).alias("holds")),
        errors.select(F.lit("nothing lost by binding").alias("check"), (F.col("errors") == 0).alias("holds")),
    ]
    return {
        "methods": methods,
        "widths": queries.bits_sweep(spark, tables, seed),
        "walk": walk_means,
        "binding": errors,
        "throughput": one({"distances_per_second": evaluate.hamming_rate(20_000)}),
        "storage": one(evaluate.storage_bytes()),
        "checks": checks[0].unionByName(checks[1]).unionByName(checks[2]),
    }


def multiseed(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """Scores of each seed, their spread, and the paired test."""
    return {"seeds": queries.multiseed(spark, tables), "stats": queries.multiseed_stats(spark, tables), "paired_t": queries.multiseed_paired_t(spark, tables)}


def ablation(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """The four rankers over the same subgraphs, and what the walk adds to distance."""
    found = written(queries.ranker_ablation(spark, tables), "ablation")
    wide = found.agg(*[F.max(F.when(F.col("ranker") == r, F.col("mrr"))).alias(r) for r in ("bfs_distance", "ctqw")])
    best = evaluate.best_of(found.select(F.col("ranker").alias("method"), F.col("mrr").alias("mean")), ("bfs_distance", "local_degree", "local_pagerank"))
    return {"rankers": found, "verdict": wide.withColumn("verdict", evaluate.walk_verdict(F.col("bfs_distance"), F.col("ctqw"))), "best_baseline": best}


def encoder(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """Addresses and vectors over the same samples, and which is ahead."""
    found = written(queries.multiseed_encoder(spark, tables), "encoder")
    wide = found.groupBy().agg(*[F.avg(F.when(F.col("method") == m, F.col("mrr"))).alias(m) for m in ("content", "topology", "vector")])
    return {"seeds": found, "verdict": wide.withColumn("verdict", evaluate.encoder_verdict(F.col("topology"), F.col("vector")))}


def walk(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """The walk's list of each query, and the list that signatures fill up."""
    return {"walk": queries.ctqw_topk(spark, tables), "hybrid": queries.hybrid_topk(spark, tables)}


def sanitiser(spark: SparkSession, tables: str) -> dict[str, DataFrame]:
    """Public nodes and edges, the edges' missing ends, and the scan for what must not be there."""
    return {"nodes": queries.sanitize_nodes(spark, tables), "edges": queries.sanitize_edges(spark, tables), "missing": queries.edge_integrity(spark, tables), "scan": queries.sensitive_scan(spark, tables)}


EXPERIMENTS = {f.__name__: f for f in (benchmark, multiseed, ablation, encoder, walk, sanitiser)}


def run(spark: SparkSession, name: str, tables: str, out: str | None = None, seed: int | None = None) -> dict[str, DataFrame]:
    """An experiment's tables, of one seed where it takes one; with `out` each is written there first, and an earlier one moved aside.

    Public nodes and edges are written as JSON lines, all else as CSV.
    """
    found = EXPERIMENTS[name](spark, tables, **({"seed": seed} if seed is not None and name == "benchmark" else {}))
    for part, df in found.items() if out else ():
        if name == "sanitiser" and part in ("nodes", "edges"):
            write_lines(df, f"{out}/{part}.jsonl", backup=True)
        else:
            write_results(df, f"{out}/{part}.csv", places=9, backup=True)
    return found


def main(args: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="brindle.experiments")
    top.add_argument("name", choices=sorted(EXPERIMENTS))
    top.add_argument("--tables", required=True)
    top.add_argument("--out")
    top.add_argument("--seed", type=int, help="of the benchmark's samples; 33 if not given")
    a = top.parse_args(args)
    for part, df in run(SparkSession.builder.appName("brindle").getOrCreate(), a.name, a.tables, a.out, a.seed).items():
        print(part)
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
