"""JSON lines of nodes and edges, read as they come and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a node that are read, all as strings.
NODE_FIELDS = ("id", "title", "label", "cluster", "description", "falsifiable_test", "type", "status", "chain")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value (variant), seq: the lines that are JSON; blank and malformed ones are skipped.

    `seq` grows with the place in a file and is unique; a missing path is an analysis error.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.where(F.trim("line") != "").withColumn("value", F.try_parse_json("line"))
    return lines.where("value is not null")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """line: what `read_lines` skips, without blank lines."""
    return spark.read.text(path).select(F.col("value").alias("line")).where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def _field(name: str) -> Column:
    return F.try_variant_get("value", f"$.{name}", "string")


def read_nodes(spark: SparkSession, path: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of a file: the fields, domain_a and domain_b of an object `bisociation`, node_seq.

    Of records that repeat an id, the last tells the content and the first the place. Values that are no strings
    are told as JSON. Records without an id, and lines that are no objects, are in `quarantined` instead.
    """
    lines = read_lines(spark, path)
    rows = lines.select("seq", *[_field(f).alias(f) for f in (*NODE_FIELDS, *more)], _field("bisociation.domain_a").alias("domain_a"), _field("bisociation.domain_b").alias("domain_b"))
    rows = rows.where("id is not null")
    columns = [c for c in rows.columns if c not in ("id", "seq")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("last"), F.min("seq").alias("node_seq"))
    return last.select("id", "last.*", "node_seq")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """line: JSON that is no node: no object, or one without an id."""
    return read_lines(spark, path).where(_field("id").isNull()).select("line")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """source, target, type, edge_seq; `src` and `tgt` count where `source` and `target` are missing."""
    lines = read_lines(spark, path)
    end = lambda name, other: F.when(F.try_variant_get("value", f"$.{name}", "variant").isNotNull(), _field(name)).otherwise(_field(other))
    return lines.select(end("source", "src").alias("source"), end("target", "tgt").alias("target"), _field("type").alias("type"), F.col("seq").alias("edge_seq"))


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of two files."""
    return read_nodes(spark, nodes_path), read_edges(spark, edges_path)


def backed_up(spark: SparkSession, path: str, mark: str = ".bak") -> str | None:
    """Move what lies at a path aside, to the first free of path.bak, path.bak1, ...; None where nothing lies there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(conf)
    if not files.exists(at(path)):
        return None
    kept = next(p for p in (f"{path}{mark}{k or ''}" for k in range(1_000_000)) if not files.exists(at(p)))
    if not files.rename(at(path), at(kept)):
        raise OSError(f"{path} can't be moved to {kept}")
    return kept


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists", backup: bool = False) -> None:
    """Rows as JSON lines in UTF-8; nulls are left out. What exists is not overwritten unless the mode says so, or moved aside with `backup`."""
    if backup:
        backed_up(df.sparkSession, path)
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, places: int = 4, mode: str = "errorifexists", backup: bool = False) -> None:
    """Result rows as CSV with a header, fractions with a fixed number of places. What exists is moved aside with `backup`."""
    if backup:
        backed_up(df.sparkSession, path)
    kinds = dict(df.dtypes)
    df.select(*[F.format_string(f"%.{places}f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]).write.mode(mode).csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of a CSV with a header; N/A is null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="N/A")
