"""Distances from landmarks by relaxation from all of them at once, and what they tell of any pair of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Sources whose distances to a node travel in one row.
SLOTS = 4
#: Rounds of relaxation are the edges of the longest shortest path; more than these means a fault.
MOST_ROUNDS = 10_000


def landmarks(near: DataFrame, n: int = 16) -> DataFrame:
    """landmark: the n nodes with most edge ends, ties by id."""
    return near.groupBy("id").agg(F.count("*").alias("ends")).orderBy(F.desc("ends"), "id").limit(n).select(F.col("id").alias("landmark"))


def distances(near: DataFrame, sources: DataFrame, weight: str | None = None, most_rounds: int | None = None, parts: int | None = None) -> DataFrame:
    """landmark, id, dist: shortest distances from every source to all nodes that it reaches.

    `near` has id and nbr (both ways of undirected edges) and, if named, a weight column of numbers above 0; without it
    each edge counts 1. `sources` has landmark; one that no edge knows reaches itself. Rows of null ends, or of weights
    that are null or not above 0, are no edges; of parallel ones the lightest counts. All sources are relaxed in one
    join a round, where a row holds a node's new distances from `SLOTS` sources, and meets an edge once for all of them;
    each round is written, so the plan stays short and a lost executor costs one round. The edges are stored once, in
    their nodes' order, in `parts` parts if not the session's number. `most_rounds` ends early, with the distances over that many edges at most.
    """
    cost = F.col(weight) if weight else F.lit(1).cast("long")
    edges = near.select("id", "nbr", cost.alias("w")).where("id is not null and nbr is not null and id <> nbr and w > 0")
    kind, slots = dict(edges.dtypes)["w"], [f"d{j}" for j in range(SLOTS)]
    edges = written(edges.select("id", "nbr", *(["w"] if weight else [])).repartition(*([parts] if parts else []), "id").sortWithinPartitions("id"), "edges")
    place = F.row_number().over(Window.orderBy("landmark")) - 1
    given = written(sources.where("landmark is not null").select("landmark").distinct().select("landmark", F.floor(place / SLOTS).cast("int").alias("block"), (place % SLOTS).alias("slot")), "sources")
    seen = given.select("block", F.col("landmark").alias("id"), *[F.when(F.col("slot") == j, F.lit(0).cast(kind)).alias(d) for j, d in enumerate(slots)])
    least = [F.min(d).alias(d) for d in slots]
    step = F.col("w") if weight else F.lit(1).cast("long")
    front, rounds = seen, 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError("the distances did not settle")
        came = front.join(edges, "id").select("block", F.col("nbr").alias("id"), *[(F.col(d) + step).alias(d) for d in slots]).groupBy("block", "id").agg(*least)
        known = seen.groupBy("block", "id").agg(*[F.min(d).alias(f"known_{d}") for d in slots])
        new = [F.when(F.col(f"known_{d}").isNull() | (F.col(d) < F.col(f"known_{d}")), F.col(d)).alias(d) for d in slots]
        front = written(came.join(known, ["block", "id"], "left").select("block", "id", *new).where(F.coalesce(*slots).isNotNull()), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = written(seen.groupBy("block", "id").agg(*least), "distances") if rounds % 8 == 0 else seen
    told = F.explode(F.array(*[F.struct(F.lit(j).alias("slot"), F.col(d).alias("dist")) for j, d in enumerate(slots)])).alias("e")
    told = seen.groupBy("block", "id").agg(*least).select("block", "id", told).select("block", "id", "e.*").where("dist is not null")
    return told.join(F.broadcast(given), ["block", "slot"]).select("landmark", "id", "dist")


def pair_bounds(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, lower, upper, exact, apart: what the landmarks' distances tell of each pair's.

    A landmark gives |d(a) - d(b)| <= d(a, b) <= d(a) + d(b); of all landmarks the best bounds count, and where they
    meet the distance is exact. `apart` tells that a landmark reaches one of the two only, so no way joins them (on
    edges both ways). Where no landmark reaches either, the bounds are null. A node and itself are 0 apart.
    """
    asked = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    ends = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()
    some = written(found.join(ends, "id", "left_semi"), "ends")
    of = lambda end: some.select("landmark", F.col("id").alias(end), F.col("dist").alias(f"d{end}"))
    left = asked.join(of("a"), "a").join(of("b"), ["b", "landmark"], "left")
    right = asked.join(of("b"), "b").join(of("a"), ["a", "landmark"], "left_anti").select("a", "b", F.lit(True).alias("one"))
    told = left.select("a", "b", F.abs(F.col("da") - F.col("db")).alias("low"), (F.col("da") + F.col("db")).alias("high"), F.col("db").isNull().alias("one"))
    told = told.unionByName(right, allowMissingColumns=True).groupBy("a", "b").agg(F.max("low").alias("lower"), F.min("high").alias("upper"), F.max("one").alias("apart"))
    out = asked.join(told, ["a", "b"], "left")
    same = F.col("a") == F.col("b")
    bound = lambda c: F.when(same, 0).otherwise(F.when(F.coalesce("apart", F.lit(False)), None).otherwise(F.col(c)))
    return out.select("a", "b", bound("lower").alias("lower"), bound("upper").alias("upper"), F.coalesce(bound("lower") == bound("upper"), F.lit(False)).alias("exact"), (~same & F.coalesce("apart", F.lit(False))).alias("apart"))
