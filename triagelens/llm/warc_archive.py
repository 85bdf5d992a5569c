"""Content-addressed WARC archive.

``write`` turns every row of a table into one WARC record and stores two tables:

* ``payloads``: every different payload once, under its SHA-256. Equality is verified
  while storing: all rows under one key must agree in SHA-1 and length, or the write fails.
* ``headers``: the exact header bytes of every record (WARC header, HTTP header), the
  payload's key and how many records share it.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
id is a ``response``; those with smaller ids are ``revisit`` records, whose block ends
after the HTTP header and which name the response in ``WARC-Refers-To``. Shorter payloads
are never revisited, but stored once all the same. ``read_back`` joins the two tables to
the original records and checks every stored payload against its key and every record
against its own header; a damaged archive fails instead of giving other bytes.
``export`` writes the records as WARC files and ``read_warc`` reads such files.

Work and skew. Payload bytes move once to be stored (one copy per task and key: partial
aggregation) and once to be joined back. The rows of a payload that a third of all
records share are salted by their number on the way back, so the stored bytes are
repeated once per ``PER_SALT`` records and no task receives all of them.

Edge cases: a null payload is empty (zero bytes). A null url leaves ``WARC-Target-URI``
out; CR and LF in a url are written as ``%0D`` and ``%0A``, so no url can end its line. A row
with a null id is a response and is named by nobody; rows that repeat the largest id of
their group are responses each. Payloads of any length up to Spark's 2 GB a value are
kept whole. Empty table: an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000     # payloads this long are worth a revisit record
PER_SALT = 10_000    # records that one copy of a stored payload serves on the way back
SALTS = 16           # parts of a payload's records while their group's size is looked up
# ---- Fixed values: record syntax of the WARC 1.1 specification ----
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_OF_RECORD = "\r\n\r\n"
# -------------------------------------------------------------------
RECORD_URI = "info:page/"
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
STORED = "digest string, payload binary, n_bytes long, sha1 string, copies long, holder long"
HEADERS = "id long, digest string, copies long, header string"


def _payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"),
                             "n_bytes": F.octet_length("payload").cast("long")})


def _uri(id_col: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_URI}"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """Exact header bytes of a record from ``id``, ``url``, ``n_bytes``, ``sha1``, ``refers_to``."""
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    lines = F.concat_ws(
        CRLF, F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),  # null without a url: concat_ws leaves it out
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")))
    return F.concat(lines, F.lit(CRLF + CRLF), http)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Store one record per row of ``pages`` under ``path``."""
    spark = pages.sparkSession
    rows = _payloads(pages, id_col, url_col, payload_col)
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("longest"),
        F.min("sha1").alias("sha1"), F.max("sha1").alias("other"), F.count(F.lit(1)).alias("copies"),
        F.max("id").alias("holder"))
    same = (F.col("n_bytes") == F.col("longest")) & (F.col("sha1") == F.col("other"))
    checked = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("unlike payloads under "), "digest")))
    (stored.select(checked.alias("digest"), "payload", "n_bytes", "sha1", "copies", "holder")
     .write.parquet(f"{path}/payloads"))

    shared = (spark.read.schema(STORED).parquet(f"{path}/payloads").where("copies > 1")
              .select(F.col("digest").alias("shared"), "copies", "holder",
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")))
    rows = rows.select("id", "url", "digest", "sha1", "n_bytes", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = rows.join(shared, (F.col("digest") == F.col("shared")) & (F.col("salt") == F.col("part")), "left")
    named = named.withColumn("refers_to", F.when((F.col("n_bytes") >= min_bytes) & (F.col("id") < F.col("holder")), F.col("holder")))
    (named.select("id", "digest", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), _header(date).alias("header"))
     .write.parquet(f"{path}/headers"))


def field(header: Column, name: str) -> Column:
    """Value of a WARC header line; null if the record has no such line."""
    value = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.nullif(value, F.lit(""))


def _id(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, rf"^<{RECORD_URI}(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def parsed(records: DataFrame) -> DataFrame:
    """``header`` (string) of each record as columns ``id``, ``record_type``, ``refers_to``,
    ``target_uri``, ``sha1``, ``content_length`` and ``block_start`` beside the given ones."""
    warc = F.substring_index("header", CRLF + CRLF, 1)
    lines = F.concat(warc, F.lit(CRLF))
    return records.withColumns({
        "id": _id(field(lines, "WARC-Record-ID")), "record_type": field(lines, "WARC-Type"),
        "refers_to": _id(field(lines, "WARC-Refers-To")), "target_uri": field(lines, "WARC-Target-URI"),
        "sha1": F.substring_index(field(lines, "WARC-Payload-Digest"), ":", -1),
        "content_length": field(lines, "Content-Length").cast("long"),
        "block_start": (F.octet_length(warc) + len(CRLF + CRLF)).cast("long")})


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``id``, ``record_type``, ``refers_to``, ``target_uri``, ``record``
    (exact bytes, without the blank lines that end it) and ``payload`` (whole, also of a revisit)."""
    stored = spark.read.schema(STORED).parquet(f"{path}/payloads")
    intact = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(intact, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary"))
    stored = stored.select(F.col("digest").alias("key"), checked.alias("payload"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PER_SALT}"))).alias("part"))
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers").select(
        "header", "digest", F.pmod(F.xxhash64("id", "header"), F.expr(f"(copies - 1) div {PER_SALT} + 1")).alias("salt"))
    whole = parsed(headers).join(stored, (F.col("digest") == F.col("key")) & (F.col("salt") == F.col("part")), "left")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), block)
    fits = ((F.octet_length(record) - F.col("block_start") == F.col("content_length")) & (F.sha1("payload") == F.col("sha1")))
    return whole.select("id", "record_type", "refers_to", "target_uri",
                        F.when(fits, record).otherwise(F.raise_error(F.concat(
                            F.lit("record differs from its header: "), F.coalesce("header", F.lit("")))).cast("binary")).alias("record"),
                        "payload")


def export(records: DataFrame, to: str, per_file: int = 100_000) -> None:
    """Write ``record`` of every row into gzipped WARC files of at most ``per_file`` records."""
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END_OF_RECORD)
     .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(to))


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Header bytes (to the end of an HTTP header, if the block has one) and the rest of every record in a file."""
    file = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := file.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := file.readline()).strip():
            head.append(line)
        head.append(line)
        length = next(int(x.split(b":")[1]) for x in head if x.lower().startswith(b"content-length:"))
        block = file.read(length)
        if len(block) != length:
            raise ValueError("a WARC record ends before its Content-Length")
        cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
        yield (b"".join(head) + block[:cut]).decode("utf-8", "replace"), block[cut:]


def read_warc(spark: SparkSession, files: str) -> DataFrame:
    """``header``, ``block`` (after the HTTP header) and the parsed columns of every record
    of WARC files. One file is one task's work and is held in memory: ``export`` bounds it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for header, block in _members(data.as_py()):
                    held.append((header, block))
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["header", "block"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["header", "block"])

    raw = spark.read.format("binaryFile").load(files).select("content")
    return parsed(raw.mapInArrow(run, "header string, block binary"))
