"""Node texts and their tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, as Python's str.split takes it.
WHITE = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def truthy(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased words between white space, repeated ones included."""
    return F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")


def node_text(title: Column, label: Column, cluster: Column, description: Column, domain_a: Column, domain_b: Column, falsifiable: Column) -> Column:
    """The parts of a node's text that are neither null nor empty, joined by spaces.

    The title stands before the label; 100 characters of the description and 80 of the test are used.
    """
    parts = [F.coalesce(truthy(title), truthy(label)), truthy(cluster), truthy(F.substring(description, 1, 100)), truthy(domain_a), truthy(domain_b), truthy(F.substring(falsifiable, 1, 80))]
    return F.concat_ws(" ", *parts)


def placeholder(text: Column) -> Column:
    """The text for encoders that take no empty one."""
    return F.coalesce(truthy(text), F.lit("(empty)"))


def short_title(title: Column, label: Column, length: int = 60) -> Column:
    """What a result shows of a node."""
    return F.substring(F.coalesce(truthy(title), truthy(label), F.lit("")), 1, length)
