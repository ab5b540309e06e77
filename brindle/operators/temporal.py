"""Joins of rows in time: the latest row before a moment, and intervals that overlap. Nothing meets all of a key's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _bucket(time: Column, width: int) -> Column:
    """The number of the time's bucket; times are timestamps, dates, or numbers of microseconds."""
    return F.floor(time / F.lit(width)).cast("long")


def _micros(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.unix_micros(F.col(f"`{column}`").cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(f"`{column}`").cast("long")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, order: Sequence[str] = (), width: int = 90 * DAY, strict: bool = False, prefix: str = "") -> DataFrame:
    """Every left row with the latest right row of its key at or before its time; nulls where there is none.

    Columns of the right but `by` follow those of the left, under `prefix` and their names. Of right rows at one time
    that with the greatest `order` columns counts (and, without any, one of them). `strict` asks for a time before the
    left row's. Left rows with a null key or time, or repeated ones, each stay; right rows with a null key or time
    match nothing.

    Both sides are dealt by key and bucket of time and merged there in order; what a bucket inherits is the latest
    right row of the buckets before, of which there is one row each. So a key with most of the rows is spread over its
    time, and no pair of rows is built that isn't a result.
    """
    theirs = [c for c in right.columns if c not in by]
    names = [f"{prefix}{c}" for c in theirs]
    if set(names) & set(left.columns):
        raise ValueError("columns of both sides share names: give a prefix")
    keys = [f"_k{n}" for n in range(len(by))]
    l_time, r_time = _micros(left, left_time), _micros(right, right_time)
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], l_time.alias("_t"))
    told = right.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(theirs, names, strict=True)]).alias("_right"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("_o") if order else F.lit(0).alias("_o"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], r_time.alias("_t"))
    there = " and ".join(f"{k} is not null" for k in [*keys, "_t"])
    told, asked, lost = told.where(there), rows.where(there), rows.where(f"not ({there})")
    side = F.lit(0 if strict else 1)  # at one time, left rows stand behind right ones unless they ask for earlier ones
    both = asked.withColumn("_side", side).unionByName(told.withColumn("_side", F.lit(1) - side), allowMissingColumns=True).withColumn("_b", _bucket(F.col("_t"), width))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("_own", F.last("_right", ignorenulls=True).over(inside))
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", "_o"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_came"))
    found = merged.where("_left is not null").join(ends, [*keys, "_b"]).select("_left", F.coalesce("_own", "_came").alias("_right"))
    found = found.unionByName(lost.select("_left"), allowMissingColumns=True)
    return found.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_right")[n].alias(n) for n in names])


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: int = 30 * DAY, prefix: str = "r_") -> DataFrame:
    """Pairs of left and right rows of one key whose intervals, from start to before end, overlap.

    Columns are those of the left, and those of the right but `by` under `prefix`. An interval that is empty, ends
    before it starts, or has a null end or key overlaps nothing. Each interval is dealt to every bucket of time that it
    touches and a pair is told in the first bucket that both touch; a long interval costs a row for each bucket of its
    own, and no bucket meets the rows of another.
    """
    keys = [f"_k{n}" for n in range(len(by))]

    def spread(df: DataFrame, ends: tuple[str, str], name: str, columns: list[str]) -> DataFrame:
        # a self-join's two sides are one plan, so that Spark shuffles it once
        out = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], _micros(df, ends[0]).alias(f"{name}_s"), _micros(df, ends[1]).alias(f"{name}_e"))
        out = out.where(" and ".join(f"{k} is not null" for k in keys)).where(F.col(f"{name}_s") < F.col(f"{name}_e"))
        return out.withColumn("_b", F.explode(F.sequence(_bucket(F.col(f"{name}_s"), width), _bucket(F.col(f"{name}_e") - 1, width))))

    mine, theirs = ([c for c in df.columns if c not in by] for df in (left, right))
    a, b = spread(left, left_ends, "_l", mine), spread(right, right_ends, "_r", theirs)
    first = F.greatest("_l_s", "_r_s")
    met = a.join(b, [*keys, "_b"]).where((first < F.least("_l_e", "_r_e")) & (F.col("_b") == _bucket(first, width)))
    own = dict(zip(by, keys, strict=True))
    return met.select(*[F.col(own[c]).alias(c) if c in own else F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_r")[c].alias(f"{prefix}{c}") for c in theirs])
