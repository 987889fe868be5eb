"""WARC archives: writing captures, reading records, assembling transactions.

Writing is native: every capture becomes the text of three records (request,
response or revisit, metadata), and Spark's text writer puts them into gzip
files on any file system that Spark reaches.  Reading takes one archive file
per row and walks its records by ``Content-Length``, one record in memory at a
time.  Assembly joins the request and metadata records to their response or
revisit through ``WARC-Concurrent-To`` (in either direction, and over one
intermediate record) and emits one nested row per capture.

Payloads of at least ``MIN_REVISIT`` bytes are stored once: of equal ones the
row with the largest ``page_id`` is the response, the others are revisits of
it.  Which payloads occur more than once reaches the rows as a bounded
broadcast set of hash buckets; only rows in such a bucket are shuffled, on
(digest, salt), so a page copied very often stays spread.

Defined cases: null html is an empty payload; a null url writes no target
URI; a null ``page_id`` loses every tie and reads back as null; of rows that
repeat payload and ``page_id`` one is the response; an empty table writes an
empty archive; other columns of ``pages`` are not archived.  A record that does
not parse raises an error that names its file and offset.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.common import salt_of, salted_lookup, scratch_path, ship

#: Payload bytes from which equal payloads are stored once.
MIN_REVISIT = 1000
#: Largest number of hash buckets in the broadcast set of repeated payloads.
FILTER_BUCKETS = 1 << 18
#: Captures per archive file at most.
FILE_CAPTURES = 20_000
#: Payload bytes per batch of read records.
BATCH_BYTES = 8 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_EOL = "\r\n"


def _urn(hex32: Column) -> Column:
    parts = [F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of a record; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit(VERSION + _EOL),
                    F.concat_ws(_EOL, *lines, F.concat(F.lit("Content-Length: "), size)),
                    F.lit(_EOL + _EOL), block, F.lit(_EOL + _EOL))


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_id and, for revisits, refers_to (record id of the response)."""
    rows = (pages.select("page_id", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
                         F.coalesce("html", F.lit("")).alias("html"))
            .withColumn("_sha", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256)))
            .withColumn("_bucket", F.pmod(F.xxhash64("_sha"), F.lit(FILTER_BUCKETS)).cast("int"))
            .withColumn("_salt", salt_of("page_id", "url")))
    groups = (rows.where("_sha IS NOT NULL").groupBy("_sha")
              .agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"), F.min("_bucket").alias("_bucket"))
              .where("_n > 1"))
    buckets = F.broadcast(groups.select("_bucket").distinct())
    in_group = F.col("_sha").isNotNull()
    # a stored payload's record id follows from its content, so that revisits can name it
    stored = _urn(F.substring("_sha", 1, 32))
    other = _urn(F.md5(F.expr("uuid()")))

    alone = (rows.where(in_group).join(buckets, "_bucket", "left_anti").withColumn("record_id", stored)
             .withColumn("refers_to", F.lit(None).cast("string")))
    small = (rows.where(~in_group).withColumn("record_id", other).withColumn("refers_to", F.lit(None).cast("string")))
    shared = salted_lookup(rows.where(in_group).join(buckets, "_bucket", "left_semi"),
                           groups.select("_sha", "_top"), ["_sha"], "_salt")
    nth = F.row_number().over(Window.partitionBy("_sha", "_salt", "page_id").orderBy("url"))
    # rows that tie for the largest page_id may lie in different salts: the smallest salt and url win
    best = (shared.where(F.col("page_id").eqNullSafe(F.col("_top"))).groupBy("_sha")
            .agg(F.min("_salt").alias("_best_salt")))
    shared = salted_lookup(shared.withColumn("_nth", nth), best, ["_sha"], "_salt")
    first = (F.col("page_id").eqNullSafe(F.col("_top")) & (F.col("_salt") == F.col("_best_salt")) & (F.col("_nth") == 1))
    lone = F.col("_top").isNull() & F.col("page_id").isNotNull()  # met the bucket by chance
    kept = F.coalesce(first | lone, F.lit(True))
    shared = (shared.withColumn("_kept", kept)
              .withColumn("record_id", F.when(F.col("_kept"), stored).otherwise(other))
              .withColumn("refers_to", F.when(~F.col("_kept"), stored)))
    cols = ["page_id", "url", "html", "record_id", "refers_to"]
    return alone.select(*cols).unionByName(small.select(*cols)).unionByName(shared.select(*cols))


def write_archive(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the captures of :func:`plan_captures` as gzip WARC files below ``path``."""
    digest = F.concat(F.lit("sha1:"), F.sha1("html"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    target = ("WARC-Target-URI", F.col("url"))
    when = ("WARC-Date", F.lit(date))
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.col("_request_id")), when, target,
                       ("WARC-Concurrent-To", F.col("record_id")),
                       ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    main = _record([("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("record_id")),
                    when, target, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("refers_to")),
                    ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
                    ("Content-Type", F.lit("application/http; msgtype=response"))],
                   F.when(revisit, head).otherwise(F.concat(head, F.col("html"))))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.col("_metadata_id")), when, target,
                        ("WARC-Concurrent-To", F.col("_request_id")), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("fetched-by: cauce\r\n"),
                                F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_EOL)), F.lit(""))))
    text = F.concat(request, main, metadata)
    (captures.withColumn("_request_id", _urn(F.md5(F.concat(F.lit("request"), F.col("record_id")))))
     .withColumn("_metadata_id", _urn(F.md5(F.concat(F.lit("metadata"), F.col("record_id")))))
     # the writer ends every value with \n, the last character of the last record
     .select(F.regexp_replace(text, "\n\\z", "").alias("value"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(path))


RECORD_SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("warc_date", T.StringType()),
    T.StructField("payload_digest_header", T.StringType()), T.StructField("http_head", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha1", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
])


def parse_records(data: bytes, file: str = "") -> Iterator[dict]:
    """The records of one archive file (gzip of one or many members, or plain)."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    offset = 0
    while True:
        line = stream.readline()
        start, offset = offset, offset + len(line)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start} of {file}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            offset += len(line)
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.removeprefix(" "))
        offset += len(line)
        one = {k: v[0] for k, v in headers.items()}
        size = int(one.get("content-length", -1))
        block = stream.read(max(0, size))
        if size < 0 or len(block) != size:
            raise ValueError(f"WARC record at byte {start} of {file} is cut off")
        offset += size
        kind = one.get("warc-type", "")
        head, payload, fields = None, block, None
        if one.get("content-type", "").startswith("application/http"):
            first, mark, rest = block.partition(b"\r\n\r\n")
            head, payload = first.decode("utf-8", "replace"), rest if mark else b""
        elif one.get("content-type", "").startswith("application/warc-fields"):
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)
            fields = [(k.strip(), v.strip()) for k, _, v in pairs]
        yield {"record_type": kind, "record_id": one.get("warc-record-id"),
               "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one.get("warc-refers-to"),
               "target_uri": one.get("warc-target-uri"), "warc_date": one.get("warc-date"),
               "payload_digest_header": one.get("warc-payload-digest"), "http_head": head,
               "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(),
               "fields": dict(fields) if fields is not None else None, "payload": payload, "file": file, "offset": start}


#: Names of the files that are read: this module's own and the usual names of crawl archives.
ARCHIVES = "{part-*,*.warc,*.warc.gz}"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives in the folder ``path`` (files named as in ``ARCHIVES``);
    ``payload=False`` leaves the bytes out."""
    ship(spark)
    schema = RECORD_SCHEMA if payload else T.StructType([f for f in RECORD_SCHEMA if f.name != "payload"])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                for record in parse_records(data, file):
                    rows.append({k: record[k] for k in names})
                    size += record["payload_bytes"] + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", ARCHIVES).load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture.

    record_id, record_type, target_uri, warc_date, payload_bytes, payload_sha1 (of a revisit: those of
    the response it refers to), payload (response only, if read), requests and metadata (arrays of
    records), refers_to, and original_metadata (the metadata of the response a revisit refers to).
    """
    anchor_types = F.col("record_type").isin("response", "revisit", "resource")
    anchors = records.where(anchor_types)
    others = records.where(~anchor_types & F.col("record_type").isin("request", "metadata"))
    links = (records.where(F.col("record_id").isNotNull())
             .select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ids = anchors.where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("anchor"))
    other_ids = others.where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("a"))
    near = links.join(other_ids, "a").join(ids, F.col("b") == F.col("anchor")).select("a", "anchor").distinct()
    # a record linked to no capture itself belongs to that of the record it names
    far = (links.join(other_ids, "a").join(near.select("a").distinct(), "a", "left_anti")
           .join(near.select(F.col("a").alias("b"), "anchor"), "b").select("a", "anchor").distinct())
    part = F.struct("record_id", "record_type", "target_uri", "http_head", "fields")
    grouped = (others.select(F.col("record_id").alias("a"), part.alias("r"))
               .join(near.unionByName(far), "a")
               .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("r.record_id"), F.col("r.record_type"),
                                                                           F.col("r.target_uri"), F.col("r.http_head"),
                                                                           F.map_entries("r.fields").alias("fields")))).alias("parts")))
    captures = (anchors.join(grouped, F.col("record_id") == F.col("anchor"), "left")
                .withColumn("requests", F.filter("parts", lambda r: r["record_type"] == "request"))
                .withColumn("metadata", F.filter("parts", lambda r: r["record_type"] == "metadata"))
                .withColumn("_salt", salt_of("record_id")))
    originals = (captures.where(F.col("record_type") != "revisit")
                 .select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"),
                         F.col("payload_sha1").alias("_sha1"), F.col("metadata").alias("original_metadata")))
    plain = captures.where(F.col("record_type") != "revisit").withColumn(
        "original_metadata", F.lit(None).cast(originals.schema["original_metadata"].dataType))
    revisits = captures.where(F.col("record_type") == "revisit").drop("payload_bytes", "payload_sha1")
    named = salted_lookup(revisits.where("refers_to IS NOT NULL"), originals, ["refers_to"], "_salt")
    unnamed = revisits.where("refers_to IS NULL").withColumns({
        "_bytes": F.lit(None).cast("bigint"), "_sha1": F.lit(None).cast("string"),
        "original_metadata": F.lit(None).cast(originals.schema["original_metadata"].dataType)})
    revisits = (named.unionByName(unnamed).withColumnRenamed("_bytes", "payload_bytes")
                .withColumnRenamed("_sha1", "payload_sha1"))
    drop = ["anchor", "parts", "_salt", "concurrent_to", "fields"]
    return plain.drop(*drop).unionByName(revisits.drop(*drop))


def field(parts: str, name: str) -> Column:
    """Value of a warc-fields entry in the first of a capture's metadata records that has it."""
    entries = F.flatten(F.transform(parts, lambda r: F.coalesce(r["fields"], F.expr("array()").cast(
        "array<struct<key:string,value:string>>"))))
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def archive_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as an archive and return its folder (a new one in the shared folder by default)."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archive(plan_captures(pages), path)
    return path
