"""WARC archives: writing captures, reading records, and assembling transactions.

A page becomes three records: a request, a response (or a revisit of the response with the
same payload) and a metadata record; the request and the metadata name the response in
``WARC-Concurrent-To``. Records are written with Spark's text writer as gzip files, the record
end being the line separator, and read back with its binary reader, each file as one stream in
which every record is taken by its ``Content-Length``; files hold a bounded number of records.
Assembly brings the records of a transaction together by their concurrent-to identifier and
emits one nested row per capture, wherever the records lay.

Every row is a capture of its own: its records are named after page id, payload, URL and, where rows
are equal in all three, an occurrence number. Of equal payloads the row with the smallest page id
(null last), then URL (null first), then occurrence is the response.
Null html is an empty payload, a null URL leaves the header out, line breaks in a URL are
percent-encoded. Equal payloads that make up most of the table are one key of a join that adaptive
execution can split; only digests, URLs and ids are aggregated. Files are bounded in records and in
bytes: captures are written by size class, with fewer records to a file the larger they are.
An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterkit.llm.tables import table
from raterkit.session import cut_lineage, scratch_path

LEAST_PAYLOAD = 100
RECORDS_PER_FILE = 6000
CLASS_BYTES = 1 << 16  # payloads of the smallest size class; each next class is twice as large
FILE_BYTES = 1 << 27  # payload bytes of a file
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, page_id: Column, digest: Column, url: Column, occurrence: Column) -> Column:
    """A urn:uuid made of what tells a capture apart, and the kind of record."""
    parts = [F.coalesce(page_id.cast("string"), F.lit("null")), digest, occurrence.cast("string"), F.coalesce(F.concat(F.lit("at "), url), F.lit(""))]
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    dashed = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its end; headers with a null value are left out."""
    lines = [
        F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")), F.lit(""))
        for name, value in headers
    ]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, length, block)


def captures_of(pages: DataFrame, least: int = LEAST_PAYLOAD) -> tuple[DataFrame, list[int]]:
    """``pages`` with payload, its length, digest and size class, ``occurrence`` among equal rows, and page
    and URL of the response for that payload (``first_at``, null where there is one capture of it or
    it is shorter than ``least`` bytes); and the size classes."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")}
    )
    own = own.withColumn("size_class", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.col("payload_bytes")) / CLASS_BYTES))).cast("int"))
    key = ["payload_digest", "page_id", "url"]
    rows = cut_lineage(own.groupBy(*key, "payload_bytes", "size_class").agg(F.count(F.lit(1)).alias("copies")), "captures")
    classes = [r.size_class for r in rows.select("size_class").distinct().collect()]  # 40 at most: a value has under 2**31 bytes
    firsts = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first_at"), F.sum("copies").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    repeats = rows.where("copies > 1").select(*key, "copies")
    if repeats.isEmpty():
        own = own.withColumn("occurrence", F.lit(0))
    else:  # equal rows are written once for each of them
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        marked = own.join(repeats.select(*[F.col(c).alias(f"_{c}") for c in key], "copies"), same, "left").drop(*[f"_{c}" for c in key])
        single = marked.where("copies is null").drop("copies").withColumn("occurrence", F.lit(0))
        each = F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("occurrence")
        several = marked.where("copies is not null").dropDuplicates(key).select(*own.columns, each)
        own = single.unionByName(several)
    return own.join(firsts, "payload_digest", "left"), classes


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the captures of ``pages(page_id, url, html)`` as gzip archives under ``path``."""
    captures, classes = captures_of(pages, least)
    if not classes:
        _write(captures, path, records_per_file)
    for c in sorted(classes):
        most = 3 * max(1, FILE_BYTES // (CLASS_BYTES << c))  # three records to a capture
        _write(captures.where(F.col("size_class") == c), path, min(records_per_file, most))


def _write(p: DataFrame, path: str, records_per_file: int) -> None:
    digest, page = F.col("payload_digest"), F.col("page_id")
    at, none = (F.col("url"), F.col("occurrence")), F.lit(0)
    is_first = page.eqNullSafe(F.col("first_at.page_id")) & F.col("url").eqNullSafe(F.col("first_at.url")) & (F.col("occurrence") == none)
    is_revisit = F.col("first_at").isNotNull() & ~is_first
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    capture = _record_id("response", page, digest, *at)
    first = _record_id("response", F.col("first_at.page_id"), digest, F.col("first_at.url"), none)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)
    )
    about = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))
    http_response = ("Content-Type", "application/http;msgtype=response")
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", page, digest, *at)), *about, ("WARC-Concurrent-To", capture),
         ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + END)),
    )
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", capture), *about, payload, http_response], F.concat(http, "html"))
    revisit = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", capture), *about, payload, ("WARC-Refers-To", first), ("WARC-Profile", PROFILE), http_response],
        http,
    )
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("payload-length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", page, digest, *at)), *about, ("WARC-Concurrent-To", capture),
         ("Content-Type", "application/warc-fields")],
        fields,
    )
    rows = p.select(F.explode(F.array(request, F.when(is_revisit, revisit).otherwise(response), metadata)).alias("value"))
    rows.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


RECORDS = (
    "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "payload_sha256 string, fields map<string,string>, payload binary"
)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def _read_task(keep_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.binary()]
            names = [f.split()[0] for f in RECORDS.replace("map<string,string>", "map").split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    kind, payload, fields = h.get("warc-type"), None, []
                    if h.get("content-type", "").startswith("application/http"):
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8").splitlines() if x)]
                    sha = hashlib.sha256(payload).hexdigest() if kind == "response" else None
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                                 h.get("warc-payload-digest", "").removeprefix("sha256:") or None, sha, fields, payload if keep_payload else None))
                    size += len(block)
                    if len(rows) >= 5000 or size > 8_000_000:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    return task


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of the gzip archives under ``path``; the payload itself only on demand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_task(keep_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata``.

    ``response`` is the response or revisit record; a part whose record is missing is null.
    """
    part = F.struct("kind", "record_id", "refers_to", "target_uri", "payload_digest", "payload_sha256", "payload")
    is_response = F.col("kind").isin("response", "revisit")
    tied = records.withColumn("capture_id", F.when(is_response, F.col("record_id")).otherwise(F.col("concurrent_to")))
    # maps are not ordered, so the metadata fields travel as a sorted array of entries
    meta = F.struct("record_id", F.array_sort(F.map_entries("fields")).alias("fields"))
    return tied.groupBy("capture_id").agg(
        F.min(F.when(F.col("kind") == "request", part)).alias("request"),
        F.min(F.when(is_response, part)).alias("response"),
        F.min(F.when(F.col("kind") == "metadata", meta)).alias("metadata"),
    )


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled: one row per capture."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path)).select(
        "capture_id", "response", F.map_from_entries("metadata.fields").alias("fields")
    )
    flat = captures.select(
        "capture_id",
        F.col("fields")["page-id"].cast("long").alias("page_id"),
        F.col("fields")["payload-length"].cast("long").alias("payload_bytes"),
        F.coalesce("response.payload_sha256", "response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
    )
    referred = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    revisits = flat.where("record_type = 'revisit'").join(referred, "refers_id", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return flat.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(out).unionByName(revisits.select(out))
