"""A corpus through five stages: toxicity, near-duplicates, decontamination, personal data, pieces.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the pieces. Extra
columns stay behind. A null text counts as empty and stays null; rows with a null id stay, but for those whose text
is toxic or holds benchmark words; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, neardup, pieces, pii, toxicity
from brindle.llm.common import drop_written, heaps_returned, scratch, scratch_path
from brindle.llm.queries import piece_model, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay; labels are learnt from the documents that come in. Without labels all stay; repeated rows go or stay together."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs.select(*COLUMNS), model, threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity from 0.8) stays: that with the smallest id.

    Texts without words are in no group, nor are rows with a null id. Of rows that repeat id and text one stays.
    """
    heaps_returned(spark)
    return neardup.deduplicated(docs.select(*COLUMNS), neardup.Join(words=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row, or a whole shorter item, go; without items all stay."""
    heaps_returned(spark)
    return decontam.cleaned(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; n_chars follows the text. A null text, and its n_chars, stay."""
    heaps_returned(spark)
    docs = pii.sanitised(docs.select(*COLUMNS))
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text; a null or empty text has the end id alone. Repeated rows each have a row."""
    heaps_returned(spark)
    found = pieces.encode(docs.withColumn("key", F.struct("doc_id", "lang", "source", "text")), piece_model(), id_column="key")
    return found.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("doc_id.text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data),
    ("pieces", encoded),
]

#: Scores of a learnt model can't be told in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again for the next.

    A stage's own tables, and its predecessor's rows, are deleted when its rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):  # what the stage wrote for itself goes with it
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            drop_written(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
