"""An index of content addresses that follows a stream of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bits import limb_names
from ..operators.signatures import simhash_arrow


def follow(nodes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the address of every node (id, text) that a stream brings to a table; each row is hashed where it lies.

    With `once` the query ends when what is there has been read. Rows carry their batch's time, so a node that
    comes again is newer.
    """
    found = simhash_arrow(nodes).withColumn("seen", F.current_timestamp())
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest address of each node: id and limbs."""
    names = limb_names()
    return spark.read.parquet(path).groupBy("id").agg(F.max_by(F.struct(*names), "seen").alias("x")).select("id", *[f"x.{n}" for n in names])
