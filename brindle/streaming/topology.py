"""Topology addresses that follow a stream of edges, added and withdrawn, by state kept for each node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.bits import LIMBS, limb_names

CHANGE = "id string, source string, target string, delta int, at timestamp"
TABLE = "id string, version bigint, n bigint, dropped bigint, " + ", ".join(f"{n} bigint" for n in limb_names())
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _bits(limbs: np.ndarray) -> np.ndarray:
    """Rows of limbs as rows of 256 zeros and ones, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(limbs, "<i8").view(np.uint8), axis=1, bitorder="little").astype(np.int64)


class Votes(StatefulProcessor):
    """A node's counters: what its neighbours' addresses vote for each bit, how many they are, and what came too late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getValueState("votes", "counters array<bigint>, n bigint, version bigint, dropped bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        have = self.votes.get() if self.votes.exists() else ([0] * 64 * LIMBS, 0, 0, 0)
        counters, n, version, dropped = np.array(have[0], np.int64), int(have[1]), int(have[2]), int(have[3])
        own, changed = None, False
        for frame in rows:
            own = frame[limb_names()].to_numpy(np.int64)[:1]
            late = frame["ms"].to_numpy(np.int64) < mark
            dropped += int(late.sum())
            frame = frame[~late]
            if len(frame):
                delta = frame["delta"].to_numpy(np.int64)
                counters += delta @ _bits(frame[[f"n_{x}" for x in limb_names()]].to_numpy(np.int64))
                n, changed = n + int(delta.sum()), True
        if own is None:
            return
        self.votes.update((counters.tolist(), n, version + 1, dropped))
        if changed:
            reached = 2 * (counters + 2 * _bits(own)[0]) >= n + 2
            limbs = np.packbits(reached, bitorder="little").view("<i8")
            yield pd.DataFrame({"id": [key[0]], "version": [version + 1], "n": [n], "dropped": [dropped], **{x: [int(v)] for x, v in zip(limb_names(), limbs, strict=True)}})

    def close(self) -> None:
        pass


def follow_edges(changes: DataFrame, content: DataFrame, path: str, checkpoint: str, late: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Keep a table of topology addresses under `path` up to date with a stream of edges.

    `changes` has source, target, delta (1 for an edge that comes, -1 for one that goes) and at, its time; `content`
    is a table of id (unique) and limbs, the nodes' own addresses. Edges whose ends aren't both nodes vote for nothing;
    parallel edges count each, a self-loop twice. A change that is older than the watermark (the latest time of earlier
    batches less `late`) when its batch is read is dropped and counted. Votes are sums, so any order of batches, and any
    cut into batches, gives the addresses that `signatures.topology` gives of the edges that remain. Each node that
    changes is a row with its version; `current` tells the newest.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # what keeps state of this kind
    names = limb_names()
    stream = changes.where("source is not null and target is not null and at is not null and delta in (-1, 1)").withWatermark("at", late)
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("nbr")), F.struct(F.col("target").alias("id"), F.col("source").alias("nbr")))).alias("e")
    both = stream.select(ends, "delta", "at").select("e.*", "delta", "at", F.unix_millis("at").alias("ms"))
    near = content.select(F.col("id").alias("nbr"), *[F.col(n).alias(f"n_{n}") for n in names])
    known = both.join(near, "nbr").join(content.select("id", *names), "id")
    found = known.groupBy("id").transformWithStateInPandas(Votes(), TABLE, outputMode="Update", timeMode="EventTime")

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is written again after a failure gives the same rows to the same folder
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = found.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, content: DataFrame) -> DataFrame:
    """id and limbs of all nodes: the newest of the stream's, or its own address where no edge of it has come."""
    names = limb_names()
    rows = spark.read.parquet(path)
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*names), "version").alias("x"))
    return content.join(newest, "id", "left").select("id", *[F.coalesce(F.col("x")[n], F.col(n)).alias(n) for n in names])
