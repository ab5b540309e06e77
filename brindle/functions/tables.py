"""Table functions for SQL: `SELECT * FROM nearest(TABLE(addresses), 'text', 10)`."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from .bits import address_of, limb_names

#: Parts that an index for SQL is dealt to.
PARTS = 64


class Nearest:
    """The rows of each part of a table of addresses that are nearest to a text's address.

    `nearest(TABLE(t), text, k)`: the table has id, the limbs of any width without a gap, and a column `part` by which
    it is dealt to the tasks; the result has id, of the table's type, and dist, and is of k rows a part at most. Ordered
    by dist and id and limited to k it is the answer, as in the view that `register` makes. Ties go by id.
    """

    def __init__(self) -> None:
        self.best: list[tuple] = []
        self.query: list[int] | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(table.dataType, StructType) or not {"id", "l0", "part"} <= set(table.dataType.names):
            raise ValueError("the first argument is a table with id, part, l0, ...")
        if not text.isConstantExpression or not k.isConstantExpression:
            raise ValueError("the text and the number of rows are constants")
        if text.value is None or k.value is None or k.value < 1:
            raise ValueError("the text is no null, and the number of rows is 1 at least")
        limbs = Nearest.limbs(table.dataType.names)
        schema = StructType().add("id", table.dataType["id"].dataType).add("dist", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("part")], select=[SelectedColumn(c) for c in ("part", "id", *limbs)])

    @staticmethod
    def limbs(names: list[str]) -> list[str]:
        n = 0
        while f"l{n}" in names:
            n += 1
        return limb_names(64 * n)

    def eval(self, row: Row, text: str, k: int) -> None:
        if self.query is None:
            self.names = self.limbs(row.__fields__)
            self.query, self.k = address_of(text, 64 * len(self.names)), k
        if row["id"] is not None:
            dist = sum(((row[n] ^ q) & (1 << 64) - 1).bit_count() for n, q in zip(self.names, self.query, strict=True))
            self.best.append((dist, row["id"]))
            if len(self.best) >= 64 + 2 * k:
                self.best = heapq.nsmallest(k, self.best)

    def terminate(self) -> Iterator[tuple]:
        for dist, id_ in heapq.nsmallest(self.k, self.best) if self.best else ():
            yield id_, dist


def register(spark: SparkSession, addresses: DataFrame | None = None, name: str = "addresses") -> None:
    """Make `nearest` known to SQL and, if given, the addresses a view that it takes."""
    spark.udtf.register("nearest", F.udtf(Nearest))
    if addresses is not None:
        addresses.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).createOrReplaceTempView(name)
