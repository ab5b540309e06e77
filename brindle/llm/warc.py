"""WARC archives with a dictionary: records compressed one by one, the dictionary in a leading skippable frame.

Each archive is a file that any Zstandard reader takes: a skippable frame that holds the dictionary, built
from all of the archive's own records, then one frame for each record. Spark's text sink writes the files and so
its commit protocol and file systems hold for them. The sink puts a line end after each value; here
that is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_KEYS, mapped, own_columns, scratch_path, small_batches, written

#: Fixed values of the formats: the dictionary's skippable frame, and an empty skippable frame in ASCII.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
#: Bytes of payload that one archive holds at most, if its records are not larger by themselves.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: From so many bytes on, an equal payload is stored once.
REVISIT_BYTES = 1000
#: The date of records whose fetch time is not known.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classified(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), n, digest (SHA-1, hex), refers_to (null for responses), named (whether revisits name it).

    Of equal payloads of `revisit_bytes` or more, the one with the largest id is the response. Rows without an
    id are responses that no row refers to. Of repeated rows with that id, the record is a response each time, and one
    of them is named. Payloads stay where they lie unless more payloads repeat than can be broadcast.
    """
    pages = own_columns(pages, page_id=id_column, url=url_column, payload=payload_column)
    pages = pages.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    pages = pages.withColumns({"n": F.length("payload").cast("long"), "digest": F.sha1("payload"), "salt": F.monotonically_increasing_id()})
    groups = pages.where((F.col("n") >= revisit_bytes)).groupBy("digest").agg(F.max("page_id").alias("response"), F.max_by("salt", "page_id").alias("place"), F.count("*").alias("copies"))
    groups = written(groups.where("copies > 1 and response is not null").select("digest", "response", "place"), "repeated")
    groups = F.broadcast(groups) if groups.count() <= SENT_KEYS else groups
    repeated = F.col("n") >= revisit_bytes
    known = F.when(repeated & (F.col("page_id") != F.col("response")), F.col("response"))
    named = F.coalesce(repeated & (F.col("salt") == F.col("place")), F.lit(False))
    return pages.join(groups, "digest", "left").select("page_id", "url", "payload", "n", "digest", known.alias("refers_to"), named.alias("named"))


def record_id(page_id, named: bool = True) -> str:
    """A record's id: told by the page's id where revisits name it, else random, so that no two are the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}') if named else uuid.uuid4()}>"


def _uri(url: str) -> str:
    """The address without what would end a header line or be no UTF-8."""
    return "".join(c if c > " " and c != "\x7f" and not "\ud800" <= c <= "\udfff" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(page_id, url: str | None, payload: bytes, n: int, digest: str, refers_to, named: bool = True, date: str = DATE) -> bytes:
    """One WARC/1.1 record of a payload of n bytes; a revisit holds the HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, named)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def archive(records: list[bytes], level: int = 3, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """An archive of records: its dictionary's frame and a frame for each record, empty frames between them."""
    try:
        known = zstandard.train_dictionary(dictionary_bytes, records, k=512, d=8)
    except zstandard.ZstdError:  # too few or too small to build one: the first record serves as it is
        known = zstandard.ZstdCompressionDict(records[0][:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held = zstandard.ZstdCompressor(level=level).compress(known.as_bytes())
    packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    return EMPTY_FRAME.encode().join([struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held, *map(packer.compress, records)])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write classified pages under a path, a file for each archive, where the rows lie: nothing is shuffled.

    A file ends at the record that brings it to `archive_bytes`. No page gives no file.
    """
    small_batches(pages.sparkSession)
    empty = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    pages = pages.select("page_id", "url", empty.alias("payload"), "n", "digest", "refers_to", "named")

    def packed(batches) -> Iterator[list]:
        some: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                some.append(record(*row, date))
                size += len(some[-1])
                if size >= archive_bytes:
                    yield [[archive(some)]]
                    some, size = [], 0
        if some:
            yield [[archive(some)]]

    files = mapped(pages, packed, "value binary").select(F.expr("cast(value as string)").alias("value"))
    files.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record of an archive's bytes."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary's frame")
    held = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    with io.BufferedReader(reader.stream_reader(memoryview(content)[8 + size :], read_across_frames=True), 1 << 20) as stream:
        while stream.readline():
            head: dict[str, str] = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode().partition(": ")
                head[name] = value
            block = stream.read(int(head["Content-Length"]))
            stream.read(4)
            http, _, payload = block.partition(b"\r\n\r\n")
            yield head, http, payload


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Records of the archives under a path: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a revisit is null; its bytes and digest are those of the payload that it refers to. The digest of
    a response is computed anew from what was read; one that differs from the record's own raises an error.
    """
    small_batches(spark)
    schema = f"page_id {id_type}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}"

    def rows(batches) -> Iterator[list]:
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[], [], [], [], [], [], []]
                held = 0
                for head, http, payload in parsed(content.as_py()):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} isn't what was written")
                    told = (head.get("X-Page-ID"), head.get("WARC-Target-URI"), payload if kind == "response" else None, length, digest, kind, head.get("X-Refers-To-Page-ID"))
                    for column, value in zip(out, told, strict=True):
                        column.append(value)
                    held += len(payload)
                    if held >= 4 << 20:
                        yield _typed(out, schema)
                        out, held = [[], [], [], [], [], [], []], 0
                yield _typed(out, schema)

    return mapped(spark.read.format("binaryFile").load(path).select("content"), rows, schema)


def _typed(out: list[list], schema: str) -> list:
    if schema.split(" ")[1].startswith(("bigint", "int")):
        for k in (0, 6):
            out[k] = [None if x is None else int(x) for x in out[k]]
    return out


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write every page to archives in the shared folder and read the archives back.

    A row for each page, repeated rows included: an empty or null payload is a response of 0 bytes; no page gives
    no archive and no row. Other columns stay behind.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    kind = dict(pages.dtypes)[id_column]
    pages = classified(pages, id_column, url_column, payload_column, revisit_bytes)
    write_archives(pages, path)
    if not any_file(spark, path):
        return spark.createDataFrame([], f"page_id {kind}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")
    return read_archives(spark, path, kind)


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether the sink wrote an archive under a path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return any(f.getLen() > 0 for f in found or [])
