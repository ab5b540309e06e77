"""A data source of JSON lines: files are read in byte ranges, pushed filters drop lines before Spark sees them.

`register(spark)`, then `spark.read.format("line_files").schema(...).load(path)` and
`df.write.format("line_files").mode(...).save(path)`. Files are reached by pyarrow's file systems, so a path may name
one that the workers share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

#: Bytes of a file that a task reads, unless the option splitBytes says otherwise; lines of a batch.
SPLIT_BYTES, BATCH_LINES = 64 << 20, 4096
WHOLE = {IntegerType: 1 << 31, LongType: 1 << 63, ShortType: 1 << 15}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Range(ds.InputPartition):
    """The lines of a file that start in these bytes."""

    path: str
    start: int
    end: int


def converter(kind: DataType) -> Callable[[object], object]:
    """JSON values to values of a column; what doesn't fit is null, a value that is no string is told as JSON in a string column."""
    if isinstance(kind, StringType):
        return lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if type(kind) in WHOLE:
        return lambda v: v if isinstance(v, int) and not isinstance(v, bool) and -WHOLE[type(kind)] <= v < WHOLE[type(kind)] else None
    if isinstance(kind, (DoubleType, FloatType)):
        return lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(kind, BooleanType):
        return lambda v: v if isinstance(v, bool) else None
    raise ValueError(f"line files have no column of type {kind.simpleString()}")


#: Filters that the source applies itself: name of the filter's class -> whether a value that isn't null passes.
TESTS = {
    "EqualTo": lambda v, x: v == x,
    "GreaterThan": lambda v, x: v > x,
    "GreaterThanOrEqual": lambda v, x: v >= x,
    "LessThan": lambda v, x: v < x,
    "LessThanOrEqual": lambda v, x: v <= x,
    "In": lambda v, x: v in x,
    "StringStartsWith": lambda v, x: v.startswith(x),
    "StringEndsWith": lambda v, x: v.endswith(x),
    "StringContains": lambda v, x: x in v,
    "IsNotNull": lambda v, x: True,
}


class LineReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.split = schema, options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Keeps the filters on single columns that it can apply; the others stay with Spark."""
        for f in filters:
            kind, name = type(f).__name__, getattr(f, "attribute", ())
            if kind in TESTS and len(name) == 1 and name[0] in self.schema.names:
                self.filters.append((name[0], kind, tuple(f.value) if kind == "In" else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Byte ranges of the path's file, or of all files in its folder but hidden ones; a path that isn't there is an error."""
        files, path = file_system(self.path)
        found = files.get_file_info(path)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        some = [found] if found.type == pafs.FileType.File else [f for f in files.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
        return [Range(f.path, at, min(at + self.split, f.size)) for f in sorted(some, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def lines(self, part: Range) -> Iterator[bytes]:
        """Lines that start in the range; the last may end beyond it."""
        files, _ = file_system(self.path)
        with files.open_input_file(part.path) as raw:
            raw.seek(max(0, part.start - 1))
            at, rest, begun = max(0, part.start - 1), b"", part.start == 0
            while True:
                block = raw.read(min(1 << 20, self.split))
                pieces = (rest + block).split(b"\n")
                rest = pieces.pop() if block else b""
                for piece in pieces:
                    if begun and at >= part.end:
                        return
                    if begun:
                        yield piece
                    begun, at = True, at + len(piece) + 1  # what comes before the first line end began in the range before
                if not block:
                    return

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        """Batches of a range's records; lines that are blank, no JSON or no object are skipped. No range, of no file, has none."""
        arrow, columns = to_arrow_schema(self.schema), [(f.name, converter(f.dataType)) for f in self.schema]
        place = {name: k for k, (name, _) in enumerate(columns)}
        tests = [(place[name], TESTS[kind], value) for name, kind, value in self.filters]
        kept: list[list] = []
        for line in self.lines(partition) if partition else ():
            try:
                record = json.loads(line.decode("utf-8", "replace")) if line.strip() else None
            except ValueError:
                continue
            if isinstance(record, dict):
                row = [convert(record.get(name)) for name, convert in columns]
                if all(row[k] is not None and test(row[k], value) for k, test, value in tests):
                    kept.append(row)
                    if len(kept) >= BATCH_LINES:
                        yield self._batch(kept, arrow)
                        kept = []
        if kept:
            yield self._batch(kept, arrow)

    @staticmethod
    def _batch(rows: list[list], arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


@dataclass
class Written(ds.WriterCommitMessage):
    """A task's file."""

    name: str
    rows: int


class LineWriter(ds.DataSourceArrowWriter):
    """Each task writes a file beside the folder's; a commit moves them in, so a reader sees all of a job or nothing of it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def _stage(self) -> tuple[pafs.FileSystem, str, str]:
        files, path = file_system(self.path)
        return files, path, f"{path}/_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows as objects; nulls are left out, characters beyond ASCII stay as they are."""
        files, _, stage = self._stage()
        files.create_dir(stage)
        name, rows = f"part-{uuid.uuid4().hex}.json", 0
        with files.open_output_stream(f"{stage}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False).encode("utf-8", "replace") + b"\n")
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files of the tasks that count into the folder; files of other attempts go."""
        files, path, stage = self._stage()
        files.create_dir(path)
        before = [f.path for f in files.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File]
        for m in messages:
            if m is not None:
                files.move(f"{stage}/{m.name}", f"{path}/{m.name}")
        for old in before if self.overwrite else ():
            files.delete_file(old)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, stage = self._stage()
        if files.get_file_info(stage).type != pafs.FileType.NotFound:
            files.delete_dir(stage)


class LineFiles(ds.DataSource):
    """JSON lines as a data source. A schema of strings, whole numbers, fractions and truth values is given by the reader's user."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> StructType:
        raise ValueError("line files are read with a schema")

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        for f in schema:
            converter(f.dataType)
        return LineWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, which from then on pushes filters to Python data sources."""
    spark.dataSource.register(LineFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
