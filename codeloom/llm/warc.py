"""Web archives with revisit records.

Only headers (id, digests, length) are shuffled by payload digest; the row of the largest id of a digest becomes the
response, the others revisit it. Records are then joined to their payloads and written by Spark's text writer, whose line
end is the end mark of a record; archives are read back whole, one file at a time, by their length headers.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import prepare
from codeloom.session import checkpoint_dir, cut_lineage

CRLF, END = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four letters from each five hexadecimal digits."""
    word = F.sha1(data)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(word, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, check, n_bytes, winner, copies) for each different header.

    Headers: page_id, digest, check, n_bytes. ``winner`` is the id whose record is the response for this payload, null for
    payloads under ``min_bytes`` and rows without id, which are responses of their own.
    """
    rows = cut_lineage(headers.groupBy("page_id", "digest", "check", "n_bytes").agg(F.count("*").alias("copies")))
    best = cut_lineage(rows.filter(F.col("page_id").isNotNull() & (F.col("n_bytes") >= min_bytes))
                       .groupBy("digest", "check").agg(F.max("page_id").alias("winner")))
    joined = rows.join(best, ["digest", "check"], "left")
    return joined.withColumn("winner", F.when(F.col("page_id").isNotNull() & (F.col("n_bytes") >= min_bytes), F.col("winner")))


def _clean(value: Column) -> Column:
    """A header value has no line ends: they are percent-coded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _name(key: Column) -> Column:
    return F.coalesce(key.cast("long").cast("string"), F.lit("none"))


def records(pages: DataFrame, *, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0,
            date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): the text of one record for each row, without the end mark."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), _name(F.col(key)).alias("id"), F.col(uri).alias("uri"), body.alias("body"),
                        F.sha1(body.cast("binary")).alias("digest"), F.sha2(body.cast("binary"), 256).alias("check"))
    headers = pages.select(F.col(key).cast("long").alias("page_id"), F.sha1(body.cast("binary")).alias("digest"),
                           F.sha2(body.cast("binary"), 256).alias("check"), F.octet_length(body).cast("long").alias("n_bytes"))
    found = cut_lineage(resolve(headers, min_bytes)).select(_name(F.col("page_id")).alias("id"), "digest", "check", "winner")
    # payloads move once: the copies are numbered where the join has put them
    joined = rows.join(found, ["id", "digest", "check"])
    copy = F.row_number().over(Window.partitionBy("id", "digest", "check").orderBy("id", "digest", "check"))
    is_new = F.col("winner").isNull() | ((F.col("winner") == F.col("page_id")) & (F.col("copy") == 1))

    def name(key_column: Column, copy: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), _name(key_column), F.lit(":"), copy.cast("string"), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("body").cast("string"), F.lit(END))
    block = F.when(F.col("new"), F.concat(http, F.col("body"))).otherwise(http)

    def head(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value, F.lit(CRLF))

    revisit = F.when(~F.col("new"), F.concat(head("WARC-Profile", F.lit(PROFILE)),
                                             head("WARC-Refers-To", name(F.col("winner"), F.lit(1))),
                                             head("WARC-Refers-To-Date", F.lit(date)))).otherwise("")
    target = F.when(F.col("uri").isNotNull() & (F.col("uri") != ""), head("WARC-Target-URI", _clean(F.col("uri")))).otherwise("")
    return (joined.withColumn("copy", copy).withColumn("new", is_new).select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), head("WARC-Type", F.when(F.col("new"), "response").otherwise("revisit")),
        head("WARC-Record-ID", name(F.col("page_id"), F.col("copy"))), head("WARC-Date", F.lit(date)), target,
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("body").cast("binary")))), revisit,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), head("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block).alias("record")))


def write_archives(pages: DataFrame, folder: str, *, max_records: int = 20_000, **options) -> None:
    """Write gzip archives, one for each partition of the join or ``max_records`` rows."""
    (records(pages, **options).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", max_records).text(folder))


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("stored_bytes", pa.int64())])
_PAGE = re.compile(r"<urn:x-page:(-?\d+|none):(\d+)>")


class _Stream(io.RawIOBase):
    """Plain bytes of a gzip file that may have many members, a piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.gz, self.ready = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready:
            if self.gz.eof:
                self.at -= len(self.gz.unused_data)
                self.gz = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            piece = self.data[self.at:self.at + (1 << 16)]
            self.at += len(piece)
            self.ready = self.gz.decompress(piece)
        n = min(len(target), len(self.ready))
        target[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _headers(source) -> dict[str, str]:
    """Header lines up to the empty line; the first line is under ''."""
    found, line = {"": source.readline().decode("utf-8").rstrip(CRLF)}, source.readline()
    while line not in (b"\r\n", b""):
        label, _, value = line.decode("utf-8").rstrip(CRLF).partition(": ")
        found[label] = value
        line = source.readline()
    return found


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(headers, HTTP headers, stored payload) of each record of a gzip archive."""
    source = io.BufferedReader(_Stream(data), 1 << 16)
    while True:
        head = _headers(source)
        if not head[""]:
            return
        if head[""] != "WARC/1.1":
            raise ValueError(f"no record starts at {head['']!r}")
        block = io.BytesIO(source.read(int(head["Content-Length"])))
        http = _headers(block)
        yield head, http, block.read()
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _parse(batches):
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for head, http, stored in read_records(data.as_py()):
                page = _PAGE.match(head["WARC-Record-ID"])[1]
                to = _PAGE.match(head.get("WARC-Refers-To", ""))
                rows.append((None if page == "none" else int(page), int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                             head["WARC-Type"], int(to[1]) if to else None, head.get("WARC-Target-URI"), len(stored)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(RECORDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives in a folder, read one archive at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")
    try:
        files = spark.read.format("binaryFile").load(folder).select("content")
        return cut_lineage(files.mapInArrow(_parse, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                                    "refers_to long, uri string, stored_bytes long"))
    finally:
        spark.conf.set(setting, before)


def archive_and_read(pages: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """Write a record for every row and read all back.

    Null payloads are empty; null or empty URLs leave the target out; line ends in URLs are percent-coded. Equal payloads
    get one response, that of the largest id; rows that repeat it whole revisit it. Rows without id are responses and come
    back without id. An empty table gives empty archives and an empty result; other columns are not read.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or f"{checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
