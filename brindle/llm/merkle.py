"""A manifest of a table as Merkle trees: one over the rows of each group, and one over the groups' roots.

Nodes of trees whose siblings are not there yet form a sparse forest, keyed by tree, level and index. Two forests merge
in any order: wherever a run of siblings of the known arity (the last run of a level may be shorter, and how long is
known from the tree's leaves) is complete, it becomes its parent. Each task merges what it has, and a tree reduction
merges the tasks' rests, which are a few nodes for each cut between tasks, and the nodes above `Shape.block` leaves.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, mapped, written

#: Leaves of a task at most, about, and from which a further task pays.
TASK_LEAVES, LEAST_LEAVES = 1 << 20, 1 << 10
PROOF = "array<struct<place: int, siblings: array<string>>>"


@dataclass(frozen=True)
class Shape:
    """Children of a node, and the levels of a block, whose leaves are proven in one task."""

    arity: int = 2
    levels: int = 16

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def widths(self, leaves: int) -> list[int]:
        """Nodes of each level, from the leaves to the root."""
        out = [leaves]
        while out[-1] > 1:
            out.append(-(-out[-1] // self.arity))
        return out


def digest(parts: Iterable[bytes]) -> bytes:
    """Lower-case hex SHA-256 of the parts in a row; digests go in as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """A row's digest: of each field its bytes in UTF-8, a colon and its text, or a dash if it is null."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""

    def parent(node: Column, run: Column) -> Column:
        before = F.slice(run["siblings"], F.lit(1), run["place"])
        after = F.slice(run["siblings"], run["place"] + 1, F.size(run["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, parent)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda run: run["siblings"])), ""), 256)


# ---- the monoid -----------------------------------------------------------------------------------------------------

Forest = dict  # (tree, level) -> {index: digest}; (tree, None) -> the tree's leaves; "high" -> {(tree, level, index): digest}


def settled(forest: Forest, shape: Shape) -> Forest:
    """The forest with every complete run of siblings replaced by its parent; nodes from the blocks' roots on are remembered."""
    high = forest.setdefault("high", {})
    for tree in [key[0] for key in forest if key != "high" and key[1] is None]:
        widths = shape.widths(forest[tree, None])
        for level, width in enumerate(widths):
            row = forest.get((tree, level), {})
            if level >= shape.levels:
                high.update({(tree, level, k): v for k, v in row.items()})
            if level == len(widths) - 1 or not row:
                continue
            for parent in sorted({k // shape.arity for k in row}):
                run = range(parent * shape.arity, min((parent + 1) * shape.arity, width))
                if all(k in row for k in run):
                    forest.setdefault((tree, level + 1), {})[parent] = digest(row.pop(k) for k in run)
            if not row:
                del forest[tree, level]
    return forest


def merged(a: Forest, b: Forest, shape: Shape) -> Forest:
    """Both forests as one. Associative and commutative; the empty one changes nothing."""
    out: Forest = {}
    for forest in (a, b):
        for key, nodes in forest.items():
            if key != "high" and key[1] is None:
                out[key] = nodes
            else:
                out.setdefault(key, {}).update(nodes)
    return settled(out, shape)


# ---- rows with their tree and index ----------------------------------------------------------------------------------


def _numbered(leaves: DataFrame) -> DataFrame:
    """Adds tree (the group's place among the groups), index (the row's place in it) and size (the group's rows).

    Rows are sorted by range over all tasks; each task numbers its own, and a number for each task says where it begins.
    """
    spark, columns = leaves.sparkSession, [c for c in leaves.columns if c not in ("group", "at", "leaf", "row")]
    known = leaves.count()
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), known // LEAST_LEAVES + 1), known // TASK_LEAVES + 1)
    order = [F.col("group").asc_nulls_first(), F.col("at").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    dealt = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    dealt = dealt.select("task", "group", "at", "leaf", *columns)

    def rows(batches) -> Iterator[list]:
        run, local, group = -1, 0, None
        for batch in batches:
            runs, locals_ = [], []
            for name in batch.column(1).to_pylist():
                if run < 0 or name != group:
                    run, local, group = run + 1, 0, name
                runs.append(run)
                locals_.append(local)
                local += 1
            yield [*batch.columns, np.array(runs, np.int64), np.array(locals_, np.int64)]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = written(mapped(dealt, rows, f"{fields}, run bigint, local bigint"), "placed")
    runs = written(placed.groupBy("task", "run").agg(F.count("*").alias("rows"), F.first("group").alias("group")), "runs")
    ends = runs.groupBy("task").agg(F.min_by("group", "run").alias("first"), F.max_by("group", "run").alias("last"), F.max_by("rows", "run").alias("rows"), (F.max("run") + 1).alias("runs"))
    begins, tree, last, carried = [], -1, None, 0
    for r in ends.orderBy("task").collect():  # one row a task
        goes_on = tree >= 0 and r["first"] == last
        tree, offset = (tree, carried) if goes_on else (tree + 1, 0)
        begins.append((r["task"], tree, offset))
        tree, last, carried = tree + r["runs"] - 1, r["last"], r["rows"] + (offset if r["runs"] == 1 else 0)
    begins = F.broadcast(spark.createDataFrame(begins, "task int, tree0 bigint, offset bigint"))
    tree = (F.col("tree0") + F.col("run")).alias("tree")
    sizes = runs.join(begins, "task").groupBy(tree).agg(F.sum("rows").alias("size"))
    index = (F.col("local") + F.when(F.col("run") == 0, F.col("offset")).otherwise(0)).alias("index")
    return looked_up(placed.join(begins, "task").select(tree, index, "group", "at", "leaf", *columns), sizes.withColumn("times", F.col("size")), "tree", "times", "sizes").drop("times")


def _reduced(rows: DataFrame, shape: Shape) -> tuple[DataFrame, dict]:
    """tree, root, size of every tree; and the nodes of trees above a block from the blocks' roots on.

    A tree that a task completes is a row of its result; only what waits for siblings of other tasks is reduced.
    """

    def fragments(batches) -> Iterator[list]:
        forest: Forest = {}
        for batch in batches:
            for tree, index, size, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forest[tree, None] = size
                forest.setdefault((tree, 0), {})[index] = leaf.encode()
            done = _finished(settled(forest, shape), shape)  # what is complete goes: a task holds a batch and its rests
            if done:
                yield [[t for t, _, _ in done], [r for _, r, _ in done], [n for _, _, n in done], [None] * len(done)]
        yield [[None], [None], [None], [pickle.dumps(forest)]]

    found = written(mapped(rows.select("tree", "index", "size", "leaf"), fragments, "tree bigint, root string, size bigint, forest binary"), "forest")
    forests = found.where("forest is not null").select("forest").rdd.map(lambda r: pickle.loads(r["forest"]))
    forest = forests.treeReduce(lambda a, b: merged(a, b, shape)) if not found.isEmpty() else {}
    rest = _finished(forest, shape)
    here = found.where("forest is null").select("tree", "root", "size")
    return here.union(rows.sparkSession.createDataFrame(rest, here.schema)), forest.get("high", {})


def _finished(forest: Forest, shape: Shape) -> list[tuple[int, str, int]]:
    """Takes the trees that are complete out of a settled forest: tree, root, leaves."""
    out = []
    for tree in [key[0] for key in forest if key != "high" and key[1] is None]:
        top = len(shape.widths(forest[tree, None])) - 1
        if (tree, top) in forest:
            out.append((tree, forest.pop((tree, top))[0].decode(), forest.pop((tree, None))))
    return out


def _levels(leaves: list[bytes], shape: Shape, whole: bool) -> tuple[np.ndarray, list[int], list[int]]:
    """All nodes of a block level by level in one array, where each level begins and how wide it is.

    `whole` says that the block is all of its tree, whose root is then the last node; else its last level is the block's root.
    """
    nodes, starts, widths, row = list(leaves), [0], [len(leaves)], leaves
    while len(row) > 1 if whole else len(starts) <= shape.levels:
        row = [digest(row[k : k + shape.arity]) for k in range(0, len(row), shape.arity)]
        starts.append(len(nodes))
        widths.append(len(row))
        nodes += row
    return np.array(nodes, "S64"), starts, widths


def _proofs(index: np.ndarray, nodes: np.ndarray, starts: list[int], widths: list[int], shape: Shape, above: list[tuple[int, list[bytes]]]) -> pa.Array:
    """Proofs of a block's leaves: for each level the own place and the other siblings; then what all leaves share."""
    a, levels = shape.arity, len(starts) - 1
    at = index[:, None] // a ** np.arange(levels)[None, :]
    place = at % a
    sibling = (at - place)[:, :, None] + np.arange(a)[None, None, :]
    other = (sibling < np.array(widths[:levels], np.int64)[None, :, None]) & (np.arange(a)[None, None, :] != place[:, :, None])
    shared = np.array([s for _, some in above for s in some], "S64")
    ids = np.where(other, sibling + np.array(starts[:levels], np.int64)[None, :, None], -1).reshape(len(index), levels * a)
    both = np.concatenate([ids, np.broadcast_to(len(nodes) + np.arange(len(shared)), (len(index), len(shared)))], axis=1)
    values = np.concatenate([nodes, shared])[both[both >= 0]]
    text = pa.StringArray.from_buffers(len(values), pa.py_buffer(np.arange(0, 64 * (len(values) + 1), 64, dtype=np.int32)), pa.py_buffer(values.tobytes()))
    runs = np.concatenate([other.sum(axis=2), np.broadcast_to([len(some) for _, some in above], (len(index), len(above)))], axis=1).astype(np.int32)
    places = np.concatenate([place, np.broadcast_to([p for p, _ in above], (len(index), len(above)))], axis=1).astype(np.int32)
    siblings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs.ravel())]).astype(np.int32)), text)
    steps = pa.StructArray.from_arrays([pa.array(places.ravel()), siblings], names=["place", "siblings"])
    return pa.ListArray.from_arrays(pa.array((np.arange(len(index) + 1) * runs.shape[1]).astype(np.int32)), steps)


def _above(tree: int, block: int, size: int, high: dict, shape: Shape) -> tuple[bytes, list[tuple[int, list[bytes]]]]:
    """A large tree's root, and the steps of a proof from a block's root to it."""
    widths, at, steps = shape.widths(size), block, []
    for level in range(shape.levels, len(widths) - 1):
        run = range(at // shape.arity * shape.arity, min((at // shape.arity + 1) * shape.arity, widths[level]))
        steps.append((at % shape.arity, [high[tree, level, k] for k in run if k != at]))
        at //= shape.arity
    return high[tree, len(widths) - 1, 0], steps


def _proven(rows: DataFrame, high: dict, shape: Shape) -> DataFrame:
    """tree, leaf, group, at and further columns of the rows, with their tree's root and their proof. A task holds a block at once."""
    columns = [c for c in rows.columns if c not in ("group", "at", "leaf", "tree", "index", "size")]
    sent = rows.sparkSession.sparkContext.broadcast(high)
    dealt = rows.withColumn("block", F.expr(f"index div {shape.block}"))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "index").select("tree", "block", "size", "index", "leaf", "group", "at", *columns)

    def blocks(batches) -> Iterator[list]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[begin]:
                    if held and keys[begin] != key:
                        yield from proven(held)
                        held = []
                    held.append(batch.slice(begin, k - begin))
                    key, begin = keys[begin], k
        if held:
            yield from proven(held)

    def proven(held: list[pa.RecordBatch]) -> Iterator[list]:
        tree, block, size = (held[0].column(k)[0].as_py() for k in range(3))
        leaves_ = [x.encode() for b in held for x in b.column(4).to_pylist()]
        whole = size <= shape.block
        nodes, starts, widths = _levels(leaves_, shape, whole)
        root, above = (bytes(nodes[-1]), []) if whole else _above(tree, block, size, sent.value, shape)
        for b in held:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                index = some.column(3).to_numpy() - block * shape.block
                proofs = _proofs(index, nodes, starts, widths, shape, above)
                yield [some.column(0), *[some.column(k) for k in range(4, some.num_columns)], pa.array([root.decode()] * some.num_rows), proofs]

    fields = ", ".join(f"`{n}` {dealt.schema[n].dataType.simpleString()}" for n in ["leaf", "group", "at", *columns])
    return mapped(dealt, blocks, f"tree bigint, {fields}, root string, proof {PROOF}")


def manifest(df: DataFrame, fields: Sequence[str], group: str, order: str, shape: Shape = Shape(), more: dict[str, Column] | None = None) -> DataFrame:
    """order, group, leaf, subroot, root, proof of every row, and the columns of `more`.

    Rows of a group ascend by `order`, nulls first; rows that agree in it by their leaf; equal rows in any order, each
    with a proof of its own place. Groups ascend bytewise, null first. A group of one row has its leaf as root. Fields
    that are null go in as a dash, empty ones as 0 bytes; columns that are not named take no part. No row gives none.
    A task holds one block of leaves (`Shape`), whatever the texts' lengths; what the driver holds is the forest's
    rest and 2 / `Shape.block` of the nodes.
    """
    more = more or {}
    # the row's number, once written, tells equal rows apart
    leaves = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("at"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("leaf"), F.monotonically_increasing_id().alias("row"), *[c.alias(f"more_{n}") for n, c in more.items()])
    rows = written(_numbered(written(leaves, "leaves")), "numbered")
    roots, high = _reduced(rows, shape)
    roots = written(roots.select(F.lit(0).alias("group"), F.col("tree").alias("at"), F.col("root").alias("leaf"), F.lit(0).alias("row"), F.col("size").alias("leaves")), "subroots")
    upper = written(_numbered(roots), "upper")
    tops = _proven(upper, _reduced(upper, shape)[1], shape).select(F.col("at").alias("tree"), F.col("root").alias("top"), F.col("proof").alias("upper"), "leaves")
    found = looked_up(_proven(rows, high, shape), tops, "tree", "leaves", "tops")
    proof = F.concat("proof", "upper").alias("proof")
    return found.select(F.col("at").alias(order), F.col("group").alias(group), "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), proof, *[F.col(f"more_{n}").alias(n) for n in more])


def verified(found: DataFrame, leaf: str = "leaf") -> DataFrame:
    """`found` with folded_root, which the leaf in the named column and the row's proof give, and whether it is the root."""
    out = found.withColumn("folded_root", folded(F.col(f"`{leaf}`"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
