"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture is a request, a response or revisit, and a metadata record, the first and last of which name the second
in WARC-Concurrent-To. Archives are written by Spark's text writer (the record separator is its line separator) and
read as binary files, so that any store Spark reaches will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: Equal payloads of fewer bytes are all written whole.
LEAST_REVISIT = 1000
#: Payload bytes per archive file, about; a reader holds one file at a time.
FILE_BYTES = 16 << 20
_END = "\r\n\r\n"
RECORD = "warc_type string, record_id string, concurrent_to array<string>, target_uri string, date string, payload_digest string, fields map<string,string>, payload_bytes long, payload_sha1 string, payload binary"


def _record(kind: Column, record_id: Column, heads: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in heads]
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def _urn(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes gzipped archives below ``path``. Of rows with equal payloads of at least ``least`` bytes, that with the
    largest page_id is the response, and the others revisit it; rows that repeat its page_id are responses too, and
    so are all where every page_id is null. A null payload is empty. A null url gives records without target.

    Only digests are shuffled to find equal payloads, merged before. Their table is written first: as Spark then
    knows its size, it is broadcast when small, and else joined with hot digests split.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    d = df.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(url, "[\r\n]+", "%0D%0A").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"))
    d = d.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    groups = d.groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter((F.col("n") > 1) & (F.col("bytes") >= least) & F.col("original").isNotNull()).select(F.col("digest").alias("_d"), "original", "original_url"), "equal-payloads")
    d = d.join(groups, F.col("digest") == F.col("_d"), "left").withColumn("_row", F.concat(F.lit(run), F.monotonically_increasing_id().cast("string")))
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    main, when = _urn(F.lit("main"), F.col("_row")), F.lit(date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    uri = ("WARC-Target-URI", F.col("url"))
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1"), F.lit(_END))
    response = _record(F.when(again, "revisit").otherwise("response"), main, [
        ("WARC-Date", when), uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To-Target-URI", F.when(again, F.col("original_url"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body"))))
    request = _record(F.lit("request"), _urn(F.lit("request"), F.col("_row")), [("WARC-Date", when), uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    facts = F.concat(*(F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in (("pageId", F.col("page_id")),)))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("_row")), [("WARC-Date", when), uri, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], facts)
    mean = d.agg(F.avg("bytes")).first()[0] or 0.0
    out = d.select(F.concat(request, F.lit(_END), response, F.lit(_END), metadata).alias("value"))
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1500)))).text(path)


def _inflated(data: bytes) -> bytes:
    """All gzip members, one after the other, in time linear in their size; what is no gzip stays as it is, and what a cut
    or foreign end hides is left out."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        try:
            while part := f.read1(1 << 20):
                out.append(part)
        except (EOFError, gzip.BadGzipFile, zlib.error):
            pass
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, by their Content-Length; what is not a record is passed over."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        heads: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            heads.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k: heads.get(k, [None])[0]  # noqa: B023, E731
        length = one("content-length")
        n = int(length) if length and length.isdigit() else 0
        block, at = data[end + 4 : end + 4 + n], data.find(b"WARC/", end + 4 + n)
        kind, facts, payload = one("warc-type"), {}, block
        if (one("content-type") or "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif (one("content-type") or "").startswith("application/warc-fields"):
            facts = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if v}
        digest = one("warc-payload-digest")
        yield {"warc_type": kind, "record_id": one("warc-record-id"), "concurrent_to": heads.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "payload_digest": digest.rpartition(":")[2] if digest else None, "fields": list(facts.items()), "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(), "payload": payload}


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"concurrent_to": pa.list_(pa.string()), "fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for r in parse_records(_inflated(content.as_py())):
                rows.append(r if with_payload else r | {"payload": None})
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds.get(n, pa.string())) for n in names], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kinds.get(n, pa.string())) for n in names], names)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with the payload's length and SHA-1 taken anew. A file is parsed in
    one task, whatever its name: archives should stay within some hundred MB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(partial(_read, with_payload=with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (a response or revisit record), request and metadata, the latter two null
    where no record names the first in WARC-Concurrent-To. ``records`` must give the same rows whenever it is read."""
    whole = F.struct(*records.columns)
    main = records.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", whole.alias("response"))
    side = lambda kind: records.filter(F.col("warc_type") == kind).select(F.explode("concurrent_to").alias("record_id"), whole.alias(kind))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left").select("response", "request", "metadata")


def with_originals(captures: DataFrame) -> DataFrame:
    """Adds original (page_id, payload_bytes) to captures of this module's archives: for a revisit, of the response whose payload
    has its digest, null if there is none. Digests are merged first; a hot one is split where Spark joins it."""
    fact = F.col("metadata.fields")["pageId"].cast("long")
    whole = captures.filter("response.warc_type = 'response'").groupBy(F.col("response.payload_sha1").alias("_d"))
    whole = whole.agg(F.struct(F.max(fact).alias("page_id"), F.first("response.payload_bytes").alias("payload_bytes")).alias("original"))
    digest = F.when(F.col("response.warc_type") == "revisit", F.col("response.payload_digest"))
    return captures.withColumn("_k", digest).join(whole, F.col("_k") == F.col("_d"), "left").drop("_k", "_d")


def archive_round_trip(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes df as archives to the shared folder, reads them back and assembles the transactions, with the originals of
    revisits: all facts come from the archives."""
    spark = df.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(df, path, page_id, url, html)
    return with_originals(assemble(stored(read_records(spark, path, with_payload), "records")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive_round_trip(table(spark, sf_dir, "pages"))
    revisit = F.col("response.warc_type") == "revisit"
    return c.select(
        F.col("metadata.fields")["pageId"].cast("long").alias("page_id"), F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.payload_digest")).otherwise(F.col("response.payload_sha1")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"), F.when(revisit, F.col("original.page_id")).alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(encode(h)) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN original END AS refers_to
FROM g
"""
