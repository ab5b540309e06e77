"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is that of the hashes of its word shingles. Documents with equal sets form a class, told by one of
them. Each class has a pool of minwise tokens. A tree branches a node's classes by a few tokens chosen for the
node: classes that agree in one of them go to the same child. Nodes that are small enough are compared
exhaustively, larger ones branch on. Independent trees repeat this. Two classes at the threshold meet in a
small node of one tree with probability p = 1 - (1 - s p)^branches at any depth (0.991 for s = 0.8 and
three branches), so four trees miss a pair in 7 of 10^9 cases.

Before the trees are searched, each first-level node links its classes to one of them where that is true. Nodes whose
classes are in one component already need no comparison, and inside a node only members outside its largest
component are compared with the others. A node that is still large at the last depth is compared in pairs
of blocks. Sketches tell which members may have a link at all; every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SENT_KEYS, as_bytes, left_beside, looked_up, mapped, row_key, sent, small_batches, written
from .components import components

#: Minwise tokens in a class's pool; the first trees * branches of them make the first level.
POOL = 64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_XOR = _RANDOM.integers(0, 2**64, POOL, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**64, POOL, dtype=np.uint64) | np.uint64(1)
#: Agreements of two sketches from which sets are compared: pairs at 0.8 have 51 of 64 on average; 2 in 10^8 have fewer.
LEAST_AGREEING = 32


@dataclass(frozen=True)
class Join:
    """The join's parameters."""

    words: int = 5
    percent: int = 80  # 100 * intersection >= percent * union
    trees: int = 4
    branches: int = 3
    small: int = 4096  # classes of a node that is compared exhaustively
    elements: int = 1 << 19  # and elements of their sets together
    depth: int = 2  # levels after which larger nodes are compared in pairs of blocks


class _Words(dict):
    """Word -> 64-bit hash; it remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = value
        return value


def shingles(text: bytes | None, size: int, memory: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words make one shingle, none make none."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - size + 1 + k]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The pool's minwise tokens of a set that isn't empty."""
    best = np.full(POOL, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 2048):
        np.minimum(best, ((hashes[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def sets(documents: DataFrame, join: Join, id_column: str, text_column: str) -> DataFrame:
    """doc_id, row, n (set size), digest of the set, its minwise tokens and a byte of each (null for an empty set)."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    documents = documents.select(F.col(f"`{id_column}`").alias("doc_id"), row_key(id_column, text_column).alias("row"), F.col(f"`{text_column}`").alias("text"))

    def rows(batches) -> Iterator[list]:
        memory = _Words()
        for batch in batches:
            n, digest, tokens, sketch = [], [], [], []
            for text in as_bytes(batch.column(2)):
                hashes = shingles(text, join.words, memory)
                n.append(len(hashes))
                digest.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                tokens.append(minwise(hashes).tobytes() if len(hashes) else None)
                sketch.append(tokens[-1][::4] if len(hashes) else None)
            yield [batch.column(0), batch.column(1), n, digest, tokens, sketch]

    return mapped(documents, rows, f"doc_id {kind}, row string, n bigint, digest binary, tokens binary, sketch binary")


def first_level(classes: DataFrame, join: Join) -> DataFrame:
    """node, cid: the classes' nodes at the first level, one for each tree and branch."""

    def rows(batches) -> Iterator[list]:
        count = join.trees * join.branches
        base = np.arange(count, dtype=np.int64) << 32
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, POOL)[:, :count].astype(np.int64)
            yield [(tokens + base).ravel().tolist(), np.repeat(batch.column(0).to_numpy(), count).tolist()]

    return mapped(classes.select("cid", "tokens"), rows, "node bigint, cid bigint")


def branched(members: DataFrame, join: Join, level: int) -> DataFrame:
    """Children of nodes (node, cid, tokens): a child for each of the node's chosen tokens and its value."""

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            node, cid = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, POOL)
            children = []
            for k, name in enumerate(node):
                for j in range(join.branches):
                    choice = xxhash.xxh3_64_intdigest(f"{name}:{level}:{j}") % POOL
                    children.append(xxhash.xxh3_64_intdigest(f"{name}:{choice}:{tokens[k, choice]}") - 2**63)
            yield [children, np.repeat(cid, join.branches).tolist()]

    return mapped(members.select("node", "cid", "tokens"), rows, "node bigint, cid bigint")


def runs(batches) -> Iterator[tuple]:
    """(group, its rows) of batches whose rows are sorted by their first column; one group is held at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def together(df: DataFrame) -> DataFrame:
    """Rows with their group's others one after another; groups are of bounded size."""
    return df.repartition("grp").sortWithinPartitions("grp")


def active(members: DataFrame, join: Join) -> DataFrame:
    """grp, side, comp, cid of the members of groups that may have a link to another component of their group.

    `members` has grp, side, comp, cid, n, sketch; in groups with sides 0 and 1, pairs across them count. What is told
    is members, not pairs: a group of m gives at most m rows.
    """

    def rows(batches) -> Iterator[list]:
        out: list[list] = [[], [], [], []]
        for grp, some in runs(batches):
            side, comp, cid, n = (np.array(c, np.int64) for c in list(zip(*some, strict=True))[:4])
            sketch = np.frombuffer(b"".join(m[4] for m in some), np.uint8).reshape(-1, POOL)
            across = side.max() != side.min()
            hit = np.zeros(len(some), bool)
            for i in range(len(some)):
                other = np.flatnonzero(side != side[i]) if across else np.arange(i + 1, len(some))
                other = other[(comp[other] != comp[i]) & (100 * np.minimum(n[other], n[i]) >= join.percent * np.maximum(n[other], n[i]))]
                if len(other):
                    other = other[(sketch[other] == sketch[i]).sum(axis=1) >= LEAST_AGREEING]
                    if len(other):
                        hit[i] = True
                        hit[other] = True
            for k in np.flatnonzero(hit).tolist():
                for column, value in zip(out, (grp, *some[k][:3]), strict=True):
                    column.append(value)
            if len(out[0]) > 10_000:
                yield out
                out = [[], [], [], []]
        yield out

    return mapped(together(members.select("grp", "side", "comp", "cid", "n", "sketch")), rows, "grp string, side int, comp bigint, cid bigint")


def connected(members: DataFrame, join: Join) -> DataFrame:
    """a, b: confirmed links that connect the components of each group as all links between them do.

    `members` has grp, side, comp, cid, hashes. A member of the group's largest component is compared with no one itself:
    those outside are compared with it.
    """

    def rows(batches) -> Iterator[list]:
        for _, some in runs(batches):
            found = _exhausted(some, join.percent)
            if found:
                yield [[p[0] for p in found], [p[1] for p in found]]

    return mapped(together(members.select("grp", "side", "comp", "cid", "hashes")), rows, "a bigint, b bigint")


def _exhausted(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links of a group's members (side, comp, cid, hashes)."""
    members = sorted(members, key=lambda m: m[2])
    sets = [np.frombuffer(m[3], "<u8") for m in members]
    side, cid = np.array([m[0] for m in members]), [m[2] for m in members]
    n = np.array([len(x) for x in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(code) + 1, np.int32)
    root = np.array([m[1] for m in members], np.int64)  # a member's component now
    across = side.max() != side.min()
    values, counts = np.unique(root, return_counts=True)
    largest = values[counts.argmax()]
    out = []
    for x in range(len(members)):
        if root[x] == largest:
            continue
        mine = code[starts[x] : starts[x] + n[x]]
        flag[mine] = 1
        common = np.add.reduceat(flag[code], starts)
        flag[mine] = 0
        good = 100 * common >= percent * (n + n[x] - common)
        if across:
            good &= side != side[x]
        for y in np.flatnonzero(good).tolist():
            if root[y] != root[x]:
                out.append((min(cid[x], cid[y]), max(cid[x], cid[y])))
                old, new = (root[y], root[x]) if root[y] != largest else (root[x], largest)
                root[root == old] = new
    return out


def texts_of(ids: DataFrame, classes: DataFrame, documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """cid, text (binary): one text of each named class."""
    named = sent(ids.select("cid").distinct().join(classes.select("cid", "row"), "cid"), "named")
    texts = documents.select(row_key(id_column, text_column).alias("row"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    return texts.join(named, "row").groupBy("cid").agg(F.first("text").alias("text"))


def hashes_of(texts: DataFrame, join: Join) -> DataFrame:
    """cid, hashes: the full sets."""

    def rows(batches) -> Iterator[list]:
        memory = _Words()
        for batch in batches:
            yield [batch.column(0), [shingles(t, join.words, memory).tobytes() for t in batch.column(1).to_pylist()]]

    return mapped(texts.select("cid", "text"), rows, "cid bigint, hashes binary")


def confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, join: Join, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have the similarity."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))
    texts = written(texts_of(ids, classes, documents, id_column, text_column), "texts")
    both = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")

    def rows(batches) -> Iterator[list]:
        memory = _Words()
        held: tuple = (None, None)
        for batch in batches:
            good: list[list] = [[], []]
            for a, b, text_a, text_b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held[0] != a:
                    held = (a, shingles(text_a, join.words, memory))
                x, y = held[1], shingles(text_b, join.words, memory)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= join.percent * (len(x) + len(y) - common):
                    good[0].append(a)
                    good[1].append(b)
            yield good

    return mapped(both.select("a", "b", "text_a", "text_b"), rows, "a bigint, b bigint")


def links(classes: DataFrame, documents: DataFrame, join: Join, id_column: str, text_column: str) -> DataFrame:
    """a, b: links that connect the classes as all their links do."""
    where = (classes, documents)
    keys = first_level(classes, join)
    nodes = keys.groupBy("node").agg(F.count("*").alias("count"), F.min("cid").alias("pivot")).where("count > 1")
    keys = written(looked_up(keys, nodes, "node", "count", "nodes").select("node", "cid", "pivot"), "shared")
    sizes = classes.select("cid", "n", "sketch")
    pivots = keys.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    linked = written(confirmed(_allowed(pivots, sizes, join), *where, join, id_column, text_column), "linked")
    # From here on nodes within one component are done; components are not found anew at deeper levels.
    comp = components(linked).select(F.col("node").alias("cid"), "root")
    placed = written(sizes.join(comp, "cid", "left").select("cid", "n", "sketch", F.coalesce("root", "cid").alias("comp")), "placed")
    members, found = keys.select("node", "cid"), None
    for level in range(join.depth + 1):
        members = written(members.join(placed.select("cid", "n", "comp"), "cid"), "members")
        nodes = members.groupBy("node").agg(F.count("*").alias("count"), F.sum("n").alias("elements"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        members = written(looked_up(members, nodes.select("node", "count", "elements"), "node", "count", "nodes"), "open")
        small = (F.col("count") <= join.small) & (F.col("elements") <= join.elements)
        exact = members.where(small).select(F.concat_ws(":", F.lit(level), "node").alias("grp"), F.lit(0).alias("side"), "cid")
        large = members.where(~small)
        if level == join.depth:
            exact = exact.unionByName(_blocks(large, join))
        some = written(active(exact.join(placed, "cid"), join), "active")
        found = some if found is None else found.union(some)
        if level == join.depth or large.isEmpty():
            break
        members = written(branched(large.select("node", "cid").join(classes.select("cid", "tokens"), "cid"), join, level), "children")
    texts = texts_of(found, *where, id_column, text_column)
    sets_ = written(hashes_of(texts, join), "hashes")
    return written(linked.union(connected(found.join(sets_, "cid"), join)), "linked")


def _allowed(pairs: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(*[F.col(c).alias(f"{c}_{end}") for c in sizes.columns]).withColumnRenamed(f"cid_{end}", end), end)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= join.percent * F.greatest("n_a", "n_b"))

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POOL) for k in (2, 3))
            good = np.flatnonzero((x == y).sum(axis=1) >= LEAST_AGREEING)
            yield [batch.column(k).to_numpy()[good].tolist() for k in (0, 1)]

    return mapped(pairs.select("a", "b", "sketch_a", "sketch_b"), rows, "a bigint, b bigint")


def _blocks(large: DataFrame, join: Join) -> DataFrame:
    """Each member of a large node in each pair of the node's blocks that its own block is in."""
    count = F.ceil(F.greatest(F.col("count") / join.small, F.col("elements") / join.elements) * 2).cast("int")
    large = large.withColumn("own", F.pmod(F.xxhash64("cid", "node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return large.select(F.concat_ws(":", F.lit("blocks"), "node", i, j).alias("grp"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "cid")


def grouped(documents: DataFrame, join: Join = Join(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, row, n_shingles, component_id, kept; a row for each document.

    `component_id` is the smallest id that a document reaches over links, `kept` tells whether it is its own. A null
    or empty text, or one of white space, has an empty set and is alone. Rows that repeat an id get the same
    component if their texts do. A null id is in no component: `component_id` is that of its class or null,
    `kept` is false. An empty table gives no rows.
    """
    found = written(sets(documents, join, id_column, text_column), "sets")
    classes = found.where("digest is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), F.min("row").alias("row"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    linked = links(classes, documents, join, id_column, text_column)
    comp = components(linked).select(F.col("node").alias("cid"), "root")
    placed = found.select("doc_id", "row", "n", "digest").join(classes.select("digest", "cid"), "digest", "left").join(comp, "cid", "left")
    placed = written(placed.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("root", "cid").alias("component")), "placed")
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    out = left_beside(placed, least, "component", "members", SENT_KEYS, "least").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "row", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(documents: DataFrame, join: Join = Join(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with one of each group: that with the smallest id. Rows without an id stay.

    Of rows that repeat both id and text one stays; of rows that repeat an id alone, those of their groups.
    """
    found = grouped(documents, join, id_column, text_column).where("doc_id is not null")
    # what goes is told by its keys, as it is less than what stays; rows of one key go or stay together
    found = written(found.groupBy(F.col("row").alias("_row")).agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("not kept or times > 1"), "kept")
    gone, again = (sent(found.where(how).select("_row"), name) for how, name in (("not kept", "gone"), ("kept", "again")))
    marked = documents.withColumn("_row", row_key(id_column, text_column))
    named = marked.where(F.col(f"`{id_column}`").isNotNull())
    once = named.join(gone, "_row", "left_anti").join(again, "_row", "left_anti")
    more = named.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return once.unionByName(more).unionByName(marked.where(F.col(f"`{id_column}`").isNull())).drop("_row")
