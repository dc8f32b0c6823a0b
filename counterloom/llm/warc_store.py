"""Content-addressed WARC archive.

``write_archive`` makes one WARC record of each row and stores two tables: payload bytes, once per SHA-256, and the exact header
bytes of every record. ``read_archive`` joins them into the original records. ``export_warc`` and ``import_warc`` exchange whole
records with gzip-compressed WARC files.

Of the records with equal payloads of at least ``min_revisit`` bytes, the one with the smallest id is the response and
the others revisit it; shorter payloads are always responses. A null payload is empty. Rows repeated with one id are
alike: all are responses or all are revisits. A null url leaves out the target header; line ends in a url are percent-encoded.
Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EOL = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(record_id: Column) -> Column:
    h = F.sha2(F.concat(F.lit("record "), record_id.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _field(name: str, value: Column | str) -> Column:
    """One header line, nothing where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))


def _header(date: str) -> Column:
    """Header bytes of a record: WARC fields, an empty line, HTTP fields, an empty line."""
    n, revisit = F.col("n"), F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"), _field("Content-Length", n), F.lit(EOL))
    return F.concat(
        F.lit(VERSION + EOL),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _uuid(F.col("record_id"))),
        _field("Record-Key", F.col("record_id")),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, _uuid(F.col("refers_to")))),
        _field("Refers-To-Key", F.col("refers_to")),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("Content-Type", "application/http; msgtype=response"),
        _field("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(n)),
        F.lit(EOL), http,
    )


def write_archive(rows: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Store a record per row under ``path``: ``payloads`` (digest, first_id, payload) and ``headers`` (digest, header).

    Copies of a payload are merged before they are shuffled, so a payload that a third of the rows share is no hot key; the
    records of one digest are then joined to its single row, where adaptive execution splits a large group.
    """
    rows = rows.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    same = F.assert_true(F.min(F.struct("n", F.xxhash64("payload"))) == F.max(F.struct("n", F.xxhash64("payload"))), F.lit("payloads of one digest differ"))
    store = rows.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.any_value("payload").alias("payload"), same.alias("_same"))
    store.select("digest", "first_id", "payload", F.col("_same").isNull().alias("verified")).write.parquet(f"{path}/payloads")
    first = rows.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    refers_to = F.when((F.col("n") >= min_revisit) & (F.col("record_id") != F.col("first_id")), F.col("first_id"))
    records = rows.drop("payload").join(first, "digest").withColumn("refers_to", refers_to)
    records.select("digest", _header(date).cast("binary").alias("header")).write.parquet(f"{path}/headers")


def _named(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def parse_headers(records: DataFrame, header: str = "header") -> DataFrame:
    """Fields read from the header bytes: record_id, record_type, url, payload_digest, refers_to."""
    h = F.col(header).cast("string")
    return records.withColumns({
        "record_id": _named(h, "Record-Key").cast("long"), "record_type": _named(h, "WARC-Type"), "url": _named(h, "WARC-Target-URI"),
        "payload_digest": F.substring_index(_named(h, "WARC-Payload-Digest"), ":", -1), "refers_to": _named(h, "Refers-To-Key").cast("long"),
    })


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records from an archive: parsed fields, ``payload_bytes``, ``payload`` (of the response, for revisits too) and ``record``,
    the exact bytes that a WARC file holds. A stored payload that does not match its digest raises an error.

    Length and digest of a payload are taken before the join, so a reader who needs only those does not shuffle payloads.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("found"))
    records = parse_headers(spark.read.parquet(f"{path}/headers")).join(payloads, "digest")
    checked = F.when(F.col("found") == F.col("payload_digest"), F.col("found")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("record_id", "record_type", "url", "refers_to", "payload_bytes", checked.alias("payload_digest"), "payload", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Write records as gzip-compressed WARC files of at most ``per_file`` records. Payloads must be UTF-8."""
    text = F.regexp_replace(F.col("record").cast("string"), r"\r\n\z", "")  # the writer ends each value with a line end
    records.select(text.alias("value")).write.option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header (with the HTTP fields) and payload of each record, by Content-Length."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        length = next(int(line[15:]) for line in data[at:body].split(b"\r\n") if line.lower().startswith(b"content-length:"))
        http = data.index(b"\r\n\r\n", body) + 4
        yield data[at:http], data[http : body + length]
        at = body + length + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, one file per task at a time: parsed fields, header and payload (empty for revisits)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                pairs = list(_split_records(zlib.decompress(content, 47)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], ["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return parse_headers(files.mapInArrow(split, "header binary, payload binary"))
