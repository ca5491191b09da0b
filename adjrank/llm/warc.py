"""WARC archives: writing, reading, and resolving revisits by payload digest.

Records are written by Spark's text writer, one record a row, with the two
empty lines that end a record as line separator, and compressed; so archives
can be in any store that Spark writes to. They are read as whole files and cut by their
Content-Length headers.

Resolving shuffles headers only (key, digest, size): for each digest the
record with the largest key is the response that the others revisit. Digests
that very many records share meet their response by a broadcast, whose size is
bounded since few digests can be that frequent; all others by a shuffled join.
Payloads are then joined by key and digest, which spreads copies evenly.

Nulls: a null payload is empty, a null URL is left out, a null key is smaller
than any other (a group that has no other key is all responses, and its keys
come back as null). Rows that repeat a group's largest key are all responses.
Payloads shorter than ``least_bytes`` are all responses. Empty tables give
empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Fixed by the format: the profile of records whose payload was archived before.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: At most so many digests are frequent enough to be broadcast.
FREQUENT = 1000
#: Records in a file, so that reading one as a whole stays small.
RECORDS = 500


def payload_digests(records: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """``key``, ``url``, ``payload``, its ``digest`` (base32 SHA-1) and ``size`` in bytes."""
    narrow = records.select(
        F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    )
    return narrow.withColumns({"digest": base32(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 4 groups of 10 are 4 groups of 8 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(4):
        # 40 bits, written to the base of 32 with the digits 0-9a-v
        number = F.conv(F.substring(hexadecimal, 10 * i + 1, 10), 16, 10).cast("long")
        for j in range(8):
            five = F.shiftright(number, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int")
            parts.append(F.substring(F.lit(letters), five + 1, F.lit(1)))
    return F.concat(*parts)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0, frequent: int = FREQUENT) -> DataFrame:
    """Headers (``key``, ``digest``, ``size``) with ``original``: the key of the response, null for responses."""
    headers = headers.select("key", "digest", "size")
    groups = headers.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("key").alias("original"), F.count("*").alias("n"))
    groups = groups.where("n > 1")
    most = max(2, headers.count() // frequent)
    hot = groups.where(F.col("n") > most).select("digest", F.col("original").alias("hot"))
    cold = groups.where(F.col("n") <= most).select("digest", "original")
    found = headers.join(F.broadcast(hot), "digest", "left")
    # records of frequent digests need no second join: a key of their own spreads them
    other = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce("key", F.lit(0))))
    found = found.withColumn("other", other).join(cold.withColumnRenamed("digest", "other"), "other", "left")
    original = F.coalesce("hot", "original")
    return found.select("key", "digest", "size", F.when(~F.col("key").eqNullSafe(original), original).alias("original"))


def _text(*lines: Column) -> Column:
    return F.concat_ws("\r\n", *lines)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _id(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``key``, ``url``, ``payload``, ``digest``, ``size`` and ``original`` as WARC files.

    A row whose ``original`` is not null becomes a revisit record: it has the
    headers of the HTTP response, whose Content-Length tells the size, and no
    payload.
    """
    revisit = F.col("original").isNotNull()
    http = F.concat(
        _text(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _field("Content-Length", F.col("size").cast("string"))),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    digest, url = F.concat(F.lit("sha1:"), "digest"), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    header = _text(
        F.lit(VERSION),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _id(F.col("key"), F.col("digest"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("WARC-Payload-Digest", digest),
        F.when(revisit, _field("WARC-Profile", F.lit(IDENTICAL))),
        F.when(revisit, _field("WARC-Refers-To", _id(F.col("original"), F.col("digest")))),
        _field("Content-Length", F.octet_length("block").cast("string")),
    )
    rows = records.withColumn("block", block).select(F.concat(header, F.lit(END), "block").alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


RECORD = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("type", "record_id", "refers_to", "uri", "payload_digest", "profile")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())]
)
NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Profile")
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content block of each record of a WARC file."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        begin = stop + len(end)
        if len(data) < begin + size + len(end):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[begin : begin + size]
        at = begin + size + len(end)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record under ``path``; a response's payload is held against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(gzip.decompress(content.as_py())):
                    head, _, payload = block.partition(END.encode())
                    size = int(LENGTH.search(head).group(1))
                    if headers["WARC-Type"] == "response":
                        own = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != headers["WARC-Payload-Digest"] or size != len(payload):
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not the one described")
                    rows.append([*(headers.get(x) for x in NAMES), size, payload])
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, x, strict=True)) for x in rows], ARROW)

    return files.mapInArrow(run, RECORD)


ARROW = pa.schema(
    [(x, pa.string()) for x in ("type", "record_id", "refers_to", "uri", "payload_digest", "profile")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def page_of(record_id: Column) -> Column:
    """The key within a record id; null if the record has none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")


def archive(records: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Write a table of responses as archives in which every payload is stored once."""
    whole = payload_digests(records, key, url, payload)
    decided = resolve_revisits(whole, least_bytes).dropDuplicates(["key", "digest"])
    decided = decided.select(F.col("key").alias("k"), F.col("digest").alias("d"), "original")
    # keys spread copies; a null key meets itself by the digest alone
    joined = whole.join(decided, (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left")
    write_archives(joined.select("key", "url", "payload", "digest", "size", "original"), path)
