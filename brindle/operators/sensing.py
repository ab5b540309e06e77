"""Addresses by compressed sensing of adjacency rows: a hashed sparse projection, of which only the signs are kept.

A node's row holds the node itself and its distinct neighbours. Each member adds 1 or -1 at 16 places, which its hash
names; a bit is set where the sum is above 0. The sums are associative and fold: those of a width are those of twice the
width, added in halves, so many widths come from one pass over the edges. A member travels as its hash of 32 bytes, and
members that a batch holds often of one row travel as their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import limb_names
from ..storage import written

#: Widest address, places of a member (a SHA-256 names 16 of 16 bits: 15 tell the place, one the sign).
WIDEST, PLACES = 1 << 15, 16
#: Sums that are held at once.
HELD = 1 << 20
COLUMNS = ["id", "own", "digest", "sums"]


def _members(nodes: DataFrame, undirected: DataFrame) -> DataFrame:
    """id, own, digest, sums: a row for each member of each row, with its hash."""
    ids = nodes.where("id is not null").select("id").distinct()
    near = undirected.select("id", "nbr").distinct().where("id is not null and nbr is not null and id <> nbr")
    members = near.withColumn("own", F.lit(0)).unionByName(ids.select("id", F.col("id").alias("nbr"), F.lit(1).alias("own")))
    digest = F.unhex(F.sha2(F.concat(F.lit("row:"), F.col("nbr").cast("string")), 256))
    return members.select("id", "own", digest.alias("digest"), F.lit(None).cast("binary").alias("sums"))


def _flat(column: pa.Array, kind: str, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the column's values, and the values as a matrix."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return at, np.frombuffer(b"".join(column.drop_null().to_pylist()), kind).reshape(-1, each)


def _totals(batch: pa.RecordBatch, group: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Sums (group, place) of a batch's rows."""
    at, words = _flat(batch.column(2), ">u2", PLACES)
    place = group[at][:, None] * bits + (words & (bits - 1)).astype(np.int64)
    out = np.bincount(place.ravel(), np.where(words < WIDEST, 1, -1).ravel(), n * bits).reshape(n, bits).astype(np.int64)
    at, sums = _flat(batch.column(3), "<i4", bits)
    np.add.at(out, group[at], sums)
    return out


def _before(bits: int):
    """Members of a row that a batch holds often become one row of sums."""

    def told(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy()
            often = (np.bincount(code, minlength=1)[code] >= bits // 8) & (batch.column(1).to_numpy() == 0) if len(code) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~often)).columns, names=COLUMNS)
            some, of = batch.filter(pa.array(often)), code[often]
            for one in np.unique(of).tolist():
                mine = some.filter(pa.array(of == one))
                sums = _totals(mine, np.zeros(mine.num_rows, np.int64), 1, bits).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array([one])), pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([sums], pa.binary())], names=COLUMNS)

    return told


def _rows(batches, bits: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and sums of the rows that have a member of their own, of members that are sorted by id."""
    held, most = None, max(1, HELD // bits)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        starts = np.r_[0, 1 + np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)), len(ids)].astype(np.int64)
        for k in range(0, len(starts) - 1, most):
            some = starts[k : k + most + 1]
            part = batch.slice(some[0], some[-1] - some[0])
            group = np.repeat(np.arange(len(some) - 1), np.diff(some))
            totals, own = _totals(part, group, len(some) - 1, bits), np.add.reduceat(part.column(1).to_numpy(), some[:-1] - some[0])
            if held is not None:
                if held[0][0].equals(part.column(0)[0]):
                    totals[0] += held[1][0]
                    own[0] += held[2][0]
                elif held[2][0]:
                    yield held[:2]
            names, kept = ids.take(pa.array(some[:-1])), np.flatnonzero(own[:-1])
            if len(kept):
                yield names.take(pa.array(kept)), totals[kept]
            held = names[-1:], totals[-1:].copy(), own[-1:].copy()
    if held is not None and held[2][0]:
        yield held[:2]


def _dealt(nodes: DataFrame, undirected: DataFrame, bits: int) -> tuple[DataFrame, str]:
    if bits < 64 or bits & (bits - 1) or bits > WIDEST:
        raise ValueError("a width is a power of two from 64 to 32768")
    members = _members(nodes, undirected)
    kind = members.schema["id"].dataType.simpleString()
    rows = members.mapInArrow(_before(bits), f"id {kind}, own int, digest binary, sums binary")
    return rows.repartition("id").sortWithinPartitions("id"), kind


def row_sums(nodes: DataFrame, undirected: DataFrame, bits: int = 1024) -> DataFrame:
    """id, totals: the projected rows of all nodes (id) over edges (id, nbr), with a sum for each of `bits` places, a power of two.

    Parallel edges count once, a node always counts in its own row, neighbours that are no nodes count like others.
    Null ids have no row and null neighbours no place; an id that repeats has one row.
    """
    rows, kind = _dealt(nodes, undirected, bits)

    def told(batches) -> Iterator[pa.RecordBatch]:
        for ids, totals in _rows(batches, bits):
            yield pa.RecordBatch.from_arrays([ids, pa.array(totals.tolist(), pa.list_(pa.int64()))], names=["id", "totals"])

    return rows.mapInArrow(told, f"id {kind}, totals array<bigint>")


def sensed(nodes: DataFrame, undirected: DataFrame, widths: tuple[int, ...] = (64, 128, 256, 512, 1024)) -> dict[int, DataFrame]:
    """Addresses (id and limbs) of every width, from one pass over the edges; see `row_sums`."""
    most = max(widths)
    names = {b: [f"w{b}_{n}" for n in limb_names(b)] for b in widths}
    rows, kind = _dealt(nodes, undirected, most)

    def told(batches) -> Iterator[pa.RecordBatch]:
        for ids, totals in _rows(batches, most):
            columns = []
            for b in widths:
                positive = totals.reshape(len(totals), most // b, b).sum(axis=1) > 0
                limbs = np.packbits(positive, axis=1, bitorder="little").view("<i8")
                columns += [pa.array(limbs[:, j].copy()) for j in range(b // 64)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *[n for b in widths for n in names[b]]])

    found = written(rows.mapInArrow(told, f"id {kind}, " + ", ".join(f"{n} bigint" for b in widths for n in names[b])), "sensed")
    return {b: found.select("id", *[F.col(n).alias(limb) for n, limb in zip(names[b], limb_names(b), strict=True)]) for b in widths}
