"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, looked_up, written

#: Rounds are about the square of the logarithm of the longest chain; more than these means a fault.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each linked node reaches; roots themselves are not listed.

    Links may repeat, go either way, or join a node to itself; those with a null end are ignored. No link gives no
    row. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges, before = written(edges, "links"), None
    number = edges.count()
    for _ in range(MOST_ROUNDS):
        # a hub's rows may be many: beyond a bounded number of links they meet its least neighbour where they lie
        many = number > SENT_KEYS
        meet = (lambda rows, least: looked_up(rows, least, "u", "times", "least")) if many else (lambda rows, least: rows.join(least, "u"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("times"))
        large = meet(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a star's leaves point at its centre, which is smaller than they are
        large = large.distinct()
        large = written(large, "stars") if many else large
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = meet(large, lowest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        # two full-width sums of different hashes tell whether the table is the same
        now = edges.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in range(2)]).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, number = now, now[0]
    raise RuntimeError("the components did not settle")
