"""Fingerprints of texts as sums over their paragraphs: equal whatever the paragraphs' order, and updated in place.

A paragraph is what stands between line ends. It is hashed to a wide vector of two parts: lanes of its SHA-256, added
modulo 2^64, tell whether two multisets of paragraphs are equal; counters, to which each of its eight-byte windows adds
1 or -1 at a hashed place, are added modulo 2^32 and tell how alike two are. A text's fingerprint is the sum of its
paragraphs' vectors: what is inserted is added, what is deleted is subtracted, and nothing else is read again.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, mapped, small_batches

#: Lanes of 64 bits that tell equality, counters of 32 bits that tell likeness, bytes of a window.
LANES, COUNTERS, WINDOW = 4, 256, 8
#: Odd multipliers of the windows' hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Windows that are hashed at once.
BLOCK = 1 << 20
#: Bytes of text in a task, parts of the order in a task, and rows sampled for each part's bound, about.
PART_BYTES, PARTS, SAMPLE = 64 << 20, 4, 16


def vectors(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (n, 4) and counters (n, 256) of texts, each the sum over its paragraphs."""
    lanes, counters = np.zeros((len(texts), LANES), np.uint64), np.zeros((len(texts), COUNTERS), np.uint32)
    parts, first, held = [], 0, 0
    for k, text in enumerate(texts):
        lines = text.split(b"\n")
        lanes[k] = np.frombuffer(b"".join([hashlib.sha256(line).digest() for line in lines]), "<u8").reshape(-1, LANES).sum(axis=0, dtype=np.uint64)
        parts.append((b"\0" * WINDOW).join(lines))  # no window reaches into another paragraph
        held += len(parts[-1])
        if held >= BLOCK or k == len(texts) - 1:
            _count(parts, counters[first : k + 1])
            parts, first, held = [], k + 1, 0
    return lanes, counters


def _count(parts: list[bytes], counters: np.ndarray) -> None:
    """Add the windows of each text's joined paragraphs to its counters, a block of places after the other."""
    joined = np.frombuffer((b"\0" * WINDOW).join(parts) + b"\0" * (2 * WINDOW), np.uint8)
    ends = np.cumsum([len(p) + WINDOW for p in parts])
    for at in range(0, int(ends[-1]), BLOCK):
        block = joined[at : min(at + BLOCK, int(ends[-1])) + WINDOW - 1]
        start = np.flatnonzero(block[: len(block) - WINDOW + 1])  # a window begins with a byte of a paragraph
        h = np.lib.stride_tricks.sliding_window_view(block, WINDOW).view("<u8")[start, 0] * MIX[0]
        h = (h ^ (h >> np.uint64(32))) * MIX[1]
        place = (h >> np.uint64(40)).astype(np.int64) % (2 * COUNTERS)  # a counter, and whether it goes up or down
        lowest = int(np.searchsorted(ends, at, "right"))
        text = np.searchsorted(ends, start + at, "right") - lowest
        n = int(text[-1]) + 1 if len(text) else 0
        both = np.bincount(text * 2 * COUNTERS + place, minlength=n * 2 * COUNTERS).reshape(n, COUNTERS, 2)
        counters[lowest : lowest + n] += (both[..., 0] - both[..., 1]).astype(np.uint32)


def shown(lanes: np.ndarray, counters: np.ndarray) -> list[str]:
    """Fingerprints in hex: the lanes, then the counters, least byte first."""
    both = np.concatenate([np.ascontiguousarray(lanes, "<u8").view(np.uint8), np.ascontiguousarray(counters, "<u4").view(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in both]


def read(fingerprints: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes and counters of fingerprints in hex."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, 8 * LANES + 4 * COUNTERS)
    return np.ascontiguousarray(raw[:, : 8 * LANES]).view("<u8"), np.ascontiguousarray(raw[:, 8 * LANES :]).view("<u4")


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated share of windows that two texts have in common, 2 a.b / (a.a + b.b) of their counts, from 0 to 1.

    Equal fingerprints give 1; where one has no window and the other differs, 0. The estimate's error is about 0.06.
    """
    x, y = (c[1].view(np.int32).astype(np.float64) for c in (a, b))
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    share = np.divide(2 * (x * y).sum(axis=1), whole, out=np.zeros(len(x)), where=whole > 0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, np.clip(share, 0.0, 1.0))


def _paired(kernel, kind: str):
    """A column function of two fingerprints; null where one is null."""

    @arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_pylist(), b.to_pylist()
        there = [k for k, pair in enumerate(zip(x, y, strict=True)) if None not in pair]
        out = [None] * len(x)
        for k, v in zip(there, kernel(read(x[k] for k in there), read(y[k] for k in there)) if there else (), strict=True):
            out[k] = v
        return pa.array(out, pa.string() if kind == "string" else pa.float64())

    return run


def added(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both: inserts what `b` is of into what `a` is of."""
    return _paired(lambda x, y: shown(x[0] + y[0], x[1] + y[1]), "string")(a, b)


def taken(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of `a` without those of `b`."""
    return _paired(lambda x, y: shown(x[0] - y[0], x[1] - y[1]), "string")(a, b)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1; see `alike`."""
    return _paired(lambda x, y: alike(x, y).tolist(), "double")(a, b)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint of each row's whole text, where it lies. A null text is empty, one empty paragraph; null ids and repeated rows stay."""
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            yield [batch.column(0), shown(*vectors(texts))]

    return mapped(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")), rows, f"id {kind}, fingerprint string")


def summed(df: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """by, fingerprint, rows: the sum of each group's fingerprints, which is that of all its paragraphs.

    Each task adds up what it has, so a group sends about one row a task; null fingerprints count for nothing, a null
    group is one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[by].dataType

    def rows(batches) -> Iterator[list]:
        sums: dict = {}

        def out(names: list) -> list:
            some = [sums.pop(n) for n in names]
            return [pa.array(names, to_arrow_type(kind)), shown(np.array([s[0] for s in some]), np.array([s[1] for s in some])), [s[2] for s in some]]

        for batch in batches:
            groups, prints, counts = (c.to_pylist() for c in batch.columns)
            there = [k for k, p in enumerate(prints) if p is not None]
            for k, lane, counter in zip(there, *read(prints[k] for k in there), strict=True):
                have = sums.setdefault(groups[k], [np.zeros(LANES, np.uint64), np.zeros(COUNTERS, np.uint32), 0])
                have[0] += lane
                have[1] += counter
                have[2] += counts[k]
            if len(sums) > 4096:
                yield out(list(sums)[:-1])  # of sorted rows only the last group may go on
        if sums:
            yield out(list(sums))

    schema = f"by {kind.simpleString()}, fingerprint string, rows bigint"
    parts = mapped(df.select(F.col(f"`{by}`").alias("by"), F.col(f"`{fingerprint}`").alias("fingerprint"), F.lit(1).cast("bigint").alias("rows")), rows, schema)
    return mapped(parts.repartition("by").sortWithinPartitions("by"), rows, schema).withColumnRenamed("by", by)


def _order(df: DataFrame) -> Column:
    """Rows by id, nulls first; those of one id by a hash of their text."""
    return F.struct(F.col("id").isNotNull().alias("has"), "id", F.xxhash64("text").alias("tie"))


def followed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, part, ghost: rows dealt to parts by ascending id, in which each is before the one that follows it.

    Parts are cut at keys of sampled rows; a row at a cut goes to its part and, as a ghost that closes the part before,
    once more. The first row of all closes the last part. So each row but the ghosts finds the next one in its own
    task, texts move once, and the driver holds a key for each part. Equal texts of an id lie in one part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    key = _order(rows)
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(key).alias("first")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (whole["bytes"] or 0) // PART_BYTES + 1)
    parts = PARTS * tasks
    every = max(1, whole["n"] // (SAMPLE * parts))
    some = rows.select(key.alias("key")).where(F.pmod(F.xxhash64(F.lit("cut"), "key.id", "key.tie"), F.lit(every)) == 0).distinct().collect()
    plain = lambda k: (k["has"], k["id"] if k["has"] else 0, k["tie"])  # noqa: E731  null ids compare by their flag alone
    first = plain(whole["first"]) if whole["n"] else None
    some = sorted({plain(r["key"]) for r in some} - {first})
    step = max(1, len(some) // parts)
    cuts = some[step // 2 :: step]
    sent = spark.sparkContext.broadcast((cuts, first))

    @arrow_udf("array<struct<part: int, ghost: boolean>>")
    def targets(has: pa.Array, ids: pa.Array, ties: pa.Array) -> pa.Array:
        bounds, least = sent.value
        out = []
        for h, i, t in zip(has.to_pylist(), ids.to_pylist(), ties.to_pylist(), strict=True):
            mine = (h, i if h else 0, t)
            part = bisect.bisect_right(bounds, mine)
            to = [{"part": part, "ghost": False}]
            if part and bounds[part - 1] == mine:
                to.append({"part": part - 1, "ghost": True})
            if mine == least:
                to.append({"part": len(bounds), "ghost": True})
            out.append(to)
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("ghost", pa.bool_())])))

    keyed = rows.withColumn("key", key)
    dealt = keyed.select("*", F.explode(targets(F.col("key.has"), F.col("key.id"), F.col("key.tie"))).alias("to")).select("id", "text", F.col("key.tie").alias("tie"), "to.*")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "ghost", F.col("id").asc_nulls_first(), "tie").select("id", "text", "part", "ghost")


def edited_fingerprints(df: DataFrame, share: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of the text with its last floor(n / share) code points replaced by the next text's first.

    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited fingerprint is the
    text's, less the paragraphs from the first changed one on, plus those that stand there then. The next text is that
    of the next id in ascending order, null ids first, rows of one id by a hash of their texts; the first follows the
    last, and a single row itself. A null text is empty; repeated rows each have a row; no row gives none; other columns
    stay behind. Texts are whole however long; a task holds about `BLOCK` bytes of them, or one text.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def rows(batches) -> Iterator[list]:
        queue, held = [], 0  # rows of one part, in order, and their bytes
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                closed = queue and queue[-1][3]
                if closed and row[2] == queue[-1][2]:
                    continue  # one ghost closes a part
                if len(queue) > 1 and (closed or held >= BLOCK or len(queue) >= 256):
                    yield _edited(queue, share)
                    queue, held = queue[-1:], len(queue[-1][1])
                if closed:
                    queue, held = [], 0
                queue.append(row)
                held += len(row[1])
        if len(queue) > 1:
            yield _edited(queue, share)

    found = mapped(followed(df, id_column, text_column), rows, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_column)


def _edited(queue: list[tuple], share: int) -> list:
    """Columns of all rows in the queue but the last, each followed by the next."""
    texts = [q[1] for q in queue]
    points = [t.decode("utf-8", "surrogateescape") for t in texts]
    digests, old, new = [], [], []
    for mine, after in zip(points, points[1:], strict=False):
        n = len(mine) // share
        stays = mine[: len(mine) - n]
        begins = stays.rfind("\n") + 1  # paragraphs before are as they were
        edited = stays + after[:n]
        digests.append(hashlib.sha256(edited.encode("utf-8", "surrogateescape")).hexdigest())
        old.append(mine[begins:].encode("utf-8", "surrogateescape"))
        new.append(edited[begins:].encode("utf-8", "surrogateescape"))
    whole, gone, come = vectors(texts), vectors(old), vectors(new)
    mine, after = tuple(v[:-1] for v in whole), tuple(v[1:] for v in whole)
    edited = tuple(m - g + c for m, g, c in zip(mine, gone, come, strict=True))
    return [[q[0] for q in queue[:-1]], [len(p) for p in points[:-1]], digests, shown(*mine), shown(*edited), alike(mine, edited), alike(mine, after)]
