"""Public projections of a private graph, and the checks that nothing private is left."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy

#: Topics that stand for known chains.
TOPICS = {
    "quantum_biology": "quantum biology",
    "quantum_biology_H1": "quantum biology photosynthesis",
    "quantum_biology_H2": "quantum biology coherence",
    "quantum_biology_H3": "quantum biology algorithm",
    "quantum_biology_H4": "quantum biology density",
    "quantum_biology_H5": "quantum biology thermoregulation",
    "quantum_biology_H6": "quantum biology energy computing",
    "quantum_biology_H7": "quantum biology sensor",
    "quantum_biology_H8": "quantum biology evolution",
    "quantum_biology_H9": "quantum biology communication",
    "quantum_biology_H10": "quantum biology navigation",
}
#: What must not stand anywhere in the output.
SENSITIVE = ("bisociation", "falsifiable_test", "doi_urgency", "dvu_estimate", "ip_owner", "patent-candidate", "Thermal-Substrate")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[key] if pairs else F.lit(None).cast("string")


def safe_label(id_: Column, label: Column, chain: Column, topics: dict[str, str] | None = None) -> Column:
    """A known chain's topic; else the label if it isn't the id, with plain dashes, 80 characters; else the id."""
    named = F.substring(F.replace(F.replace(label, F.lit("â€”"), F.lit("-")), F.lit("—"), F.lit("-")), 1, 80)
    own = F.when(truthy(label).isNotNull() & (label != F.coalesce(id_, F.lit(""))), named)
    return F.coalesce(_lookup(TOPICS if topics is None else topics, chain), own, id_, F.lit("unknown"))


def sanitized_nodes(nodes: DataFrame, topics: dict[str, str] | None = None, states: dict[str, str] | None = None) -> DataFrame:
    """id, type, label, status, and cluster where the chain is known (null elsewhere).

    `states` renames states; those that it lacks are told as they are, null as ''. Repeated rows stay.
    """
    topics = TOPICS if topics is None else topics
    cluster = F.when(_lookup(topics, F.col("chain")).isNotNull(), F.col("chain"))
    status = F.coalesce(_lookup(states or {}, F.col("status")), F.col("status"), F.lit(""))
    return nodes.select("id", F.coalesce("type", F.lit("unknown")).alias("type"), safe_label(F.col("id"), F.col("label"), F.col("chain"), topics).alias("label"), status.alias("status"), cluster.alias("cluster"))


def sanitized_edges(edges: DataFrame) -> DataFrame:
    """source, target, type; what is missing is empty."""
    return edges.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "target", "type")])


def field_counts(nodes: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each named group, how many rows hold any of its columns (neither null nor empty)."""
    held = lambda cs: reduce(or_, [truthy(F.col(c).cast("string")).isNotNull() for c in cs])
    return nodes.agg(*[F.count_if(held(cs)).alias(name) for name, cs in groups.items()])


def pattern_scan(df: DataFrame, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """pattern, found: whether a pattern stands in any column's text or name."""
    text = F.concat_ws("\n", *[F.col(c).cast("string") for c in df.columns])
    named = "\n".join(df.columns)
    found = df.agg(*[F.coalesce(F.bool_or(text.contains(p)), F.lit(False)).alias(f"p{k}") for k, p in enumerate(patterns)])
    pairs = [F.struct(F.lit(p).alias("pattern"), (F.col(f"p{k}") | F.lit(p in named)).alias("found")) for k, p in enumerate(patterns)]
    return found.select(F.explode(F.array(*pairs)).alias("x")).select("x.pattern", "x.found")
