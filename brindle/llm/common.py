"""What the operators share: paths in the shared folder, batches, words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear_scratch, drop_written, scratch, scratch_path, written  # noqa: F401

#: Rows in an Arrow batch: whole texts travel in them, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches for this session: whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's names; all others, clashing or not, stay behind."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


#: Keys that are sent to every executor at most; with more, tables are joined by a shuffle.
SENT_KEYS = 200_000


#: Rows of a key from which the key is hot, at least, and hot keys of a table at most.
HOT_ROWS, HOT_KEYS = 2_000, 100_000


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Tells rows apart by 128 bits; rows that are equal in id and text share a key."""
    key, text = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return F.concat(F.lpad(F.hex(F.xxhash64(key, text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("row"), text, key)), 16, "0"))


def sent(keys: DataFrame, name: str) -> DataFrame:
    """Distinct keys, written, and broadcast if they are at most `SENT_KEYS`."""
    keys = written(keys.distinct(), name)
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def looked_up(df: DataFrame, table: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """`df` joined with a table of distinct keys, in which `count` tells how many rows of `df` each has.

    A small table is broadcast. Of a larger one only the hot keys are, so that their rows stay where they lie; the rest,
    of which no key is hot, meets in a shuffle.
    """
    table = written(table, name)
    known = table.agg(F.count("*").alias("keys"), F.sum(count).alias("rows")).first()
    if known["keys"] <= SENT_KEYS:
        return df.join(F.broadcast(table), key)
    least = max(HOT_ROWS, (known["rows"] or 0) // HOT_KEYS)
    hot = table.where(F.col(count) > least)
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) <= least), key)
    return df.join(F.broadcast(hot), key).unionByName(rest)


def left_beside(df: DataFrame, table: DataFrame, key: str, count: str, most: int, name: str) -> DataFrame:
    """`df` with the columns of a table of distinct keys, null where it lacks a row's key; see `looked_up`.

    Tables of at most `most` keys are broadcast. Rows with a null key meet no one and aren't shuffled.
    """
    table = written(table, name)
    known = table.agg(F.count("*").alias("keys"), F.sum(count).alias("rows")).first()
    told = table.drop(count)
    if known["keys"] <= most:
        return df.join(F.broadcast(told), key, "left")
    least = max(HOT_ROWS, (known["rows"] or 0) // max(1, min(HOT_KEYS, most)))
    hot, named = table.where(F.col(count) > least).drop(count), df.where(F.col(key).isNotNull())
    rest = named.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) <= least).drop(count), key, "left")
    return named.join(F.broadcast(hot), key).unionByName(rest).unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def give_back() -> None:
    """Return free memory to the system at a task's end: the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def heaps_returned(spark: SparkSession) -> None:
    """Have the JVMs of the driver and of the executors collect their heaps and return what is free.

    What one stage of a job has used isn't needed by the next, whose Python workers need memory beside the heap. One
    task for each executor asks for it; where an executor gets none, its heap stays as it is.
    """
    context = spark.sparkContext
    context._jvm.System.gc()
    executors = max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
    give_back()


def mapped(df: DataFrame, rows, schema: str) -> DataFrame:
    """mapInArrow with a function from an iterator of batches to an iterator of column lists.

    `rows` gets pyarrow batches and yields lists of columns (Python lists or arrays) in the schema's order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        try:
            for columns in rows(batches):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


#: Lower-cases A-Z and leaves all other bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z; every ASCII byte but letters and digits becomes a space. Bytes of other characters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and all characters beyond ASCII."""
    return text.translate(WORDS).split()
