"""WARC archives: writing captures, reading records back, assembling transactions through concurrent-to ids."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of a file at most, the bytes of payloads from which it takes fewer (a larger payload has a file of its own), and
#: the date that records bear, a parameter so that reruns agree.
BATCH_BYTES = 8 << 20
FILE_RECORDS, FILE_BYTES, DATE = 1500, 128 << 20, "2020-01-01T00:00:00Z"


def base32(digest) -> F.Column:
    """Base32 of a text's SHA-1 digest given in hexadecimal: each 5 digits make 4 letters."""

    def letter(i):
        n = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(BASE32), F.call_function("shiftright", n, (3 - i % 4) * 5).bitwiseAND(31) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _urn(kind: str, key) -> F.Column:
    h = F.md5(F.concat(F.lit(kind + "|"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Request, response (or revisit) and metadata records of each row, in gzipped WARC files under path.

    Of rows with equal payloads of at least `least` bytes, that with the smallest page_id is the response. Payloads
    meet by SHA-256, length and SHA-1, counted before any shuffle; html itself is shuffled once, by page_id. Payloads of
    like size share files, as many as FILE_BYTES hold, so that no file grows with the size of pages."""
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    key = rows.select("page_id", F.unhex(F.sha2("html", 256)).alias("k"), F.octet_length("html").alias("size"))
    firsts = key.where(F.col("size") >= least).groupBy("k").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    firsts = scratch.save(firsts.select("k", "first"), "firsts")
    again = scratch.save(key.join(firsts, "k").where("page_id <> first").select("page_id", "k", "first").distinct(), "again")
    rows = rows.withColumn("k", F.unhex(F.sha2("html", 256))).join(again, ["page_id", "k"], "left")
    # the generator keeps the digest out of the letters' lambda, which would compute it for each
    rows = rows.select("page_id", "url", "html", "k", "first", F.explode(F.array(F.sha1(F.col("html").cast("binary")))).alias("sha1"))
    line = lambda *x: F.concat(*x, F.lit("\r\n"))
    uri = F.when(F.col("url") == "", F.concat(F.lit("urn:x-page:"), F.col("page_id").cast("string"))).otherwise(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))
    # the id of a capture also holds its payload's hash: rows that share a page_id stay apart
    own = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex("k"))
    ids = {kind: _urn(kind, own) for kind in ("response", "request", "metadata")}
    first_id = _urn("response", F.concat_ws("|", F.col("first").cast("string"), F.hex("k")))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))

    def record(kind, block, *fields):
        head = [line(F.lit("WARC/1.1")), line(F.lit("WARC-Type: "), kind), line(F.lit(f"WARC-Date: {date}")), line(F.lit("WARC-Target-URI: "), uri)]
        return F.concat(*head, *fields, line(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit("\r\n"), block)

    repeat = F.col("first").isNotNull()
    answer = record(
        F.when(repeat, "revisit").otherwise("response"),
        F.concat(http, F.when(repeat, "").otherwise(F.col("html"))),
        line(F.lit("WARC-Record-ID: "), ids["response"]),
        line(F.lit("Content-Type: application/http; msgtype=response")),
        line(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(repeat, F.concat(line(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line(F.lit("WARC-Refers-To: "), first_id))).otherwise(""),
    )
    request = record(
        F.lit("request"), F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")),
        line(F.lit("WARC-Record-ID: "), ids["request"]), line(F.lit("WARC-Concurrent-To: "), ids["response"]), line(F.lit("Content-Type: application/http; msgtype=request")),
    )
    metadata = record(
        F.lit("metadata"), F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), size, F.lit("\r\n")),
        line(F.lit("WARC-Record-ID: "), ids["metadata"]), line(F.lit("WARC-Concurrent-To: "), ids["response"]), line(F.lit("Content-Type: application/warc-fields")),
    )
    records = F.explode(F.array(request, answer, metadata)).alias("value")
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    least_size, top = -1, file_bytes * 3 // FILE_RECORDS
    while least_size < 0 or least_size < most:
        some = rows.where(F.octet_length("html").between(least_size + 1, top))
        # The text sink writes bytes as they are, and a record ends with two line ends.
        some.select(records).write.mode("errorifexists" if least_size < 0 else "append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
            "maxRecordsPerFile", max(3, min(FILE_RECORDS, file_bytes // top * 3))
        ).text(path)
        least_size, top = top, top * 16


def parse(stream) -> tuple:
    """Records of a WARC stream: (headers in lower case, block); cut by Content-Length, never by content."""
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {version[:40]!r}")
        head = {}
        while (x := stream.readline().rstrip(b"\r\n")):
            name, _, value = x.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        yield head, stream.read(int(head["content-length"]))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, concurrent_to, refers_to, uri, date, digest, payload (what follows HTTP's head), block (of other records).

    The digest of a response is computed from its payload, that of other records is their header's. Records are read one
    at a time and passed on in batches of some megabytes."""
    names = ("type", "record_id", "concurrent_to", "refers_to", "uri", "date", "digest", "payload", "block")

    types = [pa.string()] * 7 + [pa.binary()] * 2

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as stream:
                    for h, block in parse(stream):
                        web = h["warc-type"] in ("response", "revisit")
                        payload = block.partition(b"\r\n\r\n")[2] if web else None
                        digest = "sha1:" + payload_digest(payload) if h["warc-type"] == "response" else h.get("warc-payload-digest")
                        rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, payload, None if web else block))
                        held += len(block)
                        if held > BATCH_BYTES:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {'binary' if n in ('payload', 'block') else 'string'}" for n in names))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, uri, date, digest, payload, refers_to, request, metadata.

    Requests and metadata find their response through WARC-Concurrent-To. A capture without them has nulls there;
    of several, that with the least record id is taken; those whose response is missing are left out."""
    side = records.where("type in ('request', 'metadata') and concurrent_to is not null").groupBy("concurrent_to").agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "block"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.struct("record_id", "block"))).alias("metadata"),
    )
    web = records.where("type in ('response', 'revisit')").select("record_id", "type", "uri", "date", "digest", "payload", "refers_to")
    return web.join(side.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives, reads them back and assembles captures: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Null html is empty, null urls get a name from the page's id; rows with the same id and html are one
    page_id's records, both of the same type. Extra columns are ignored; an empty table gives an empty result."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    write_archives(pages, scratch.path("warc"), least)
    captures = assemble(read_records(spark, scratch.path("warc")))
    fields = F.col("metadata.block").cast("string")
    captures = scratch.save(captures.select(
        "record_id", "type", "refers_to", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.when(F.col("type") == "response", F.octet_length("payload")).otherwise(F.regexp_extract(fields, r"payload-bytes: (\d+)", 1).cast("long")).cast("long").alias("payload_bytes"),
        F.regexp_extract(fields, r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
    ), "captures")
    responses = captures.where("type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to"))
    responses = scratch.save(responses.withColumnRenamed("record_id", "refers_to"), "responses")
    out = captures.join(responses, "refers_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("to").alias("refers_to"))


def payload_digest(payload: bytes) -> str:
    """The digest of a payload: base32 of its SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
