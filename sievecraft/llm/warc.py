"""WARC archives: written from pages, read back, and put together per capture.

A capture is three records: the response (or a revisit of a response with the
same payload), the request, and a metadata record; the last two name the first in
``WARC-Concurrent-To``. Reading parses the archives record by record, stores the
headers, and joins records through these identifiers to one nested row per capture.

An archive is a part file of the text sink, compressed as one gzip member. Records
are dealt by hash to archives of about ``archive_bytes``, the most a task reads at
a time. On the way back payloads pass no shuffle: length and digest are taken while
parsing, and only headers meet.
"""

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import stored, table
from sievecraft.session import shared_path

MIN_REVISIT_BYTES, ARCHIVE_BYTES = 100, 64 << 20
_END = "\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PARSED = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
    + [("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())]
)
_PARSED_DDL = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_bytes long, payload_digest string, digest_ok boolean, "
    "fields array<struct<name:string,value:string>>, payload binary"
)


def _record(kind: Column, record_id: Column, uri: Column, more: list[Column], mime: str, block: Column) -> Column:
    return F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
            F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            *more,
            F.lit(f"Content-Type: {mime}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ),
        F.lit(_END),
        block,
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write the three records of every page below ``path``.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the smallest
    id is the response, the others revisit it. Null payloads are empty, null
    addresses too. Pages without an id are responses and are not referred to. Rows
    that repeat an id and a payload are all responses with identifiers of their own.
    An empty table gives no records. Other columns are not written.
    """
    html = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%0A").alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    ).withColumn(
        "owner", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none"), F.pmod(F.xxhash64("html"), F.lit(4096)).cast("string")))
    )
    narrow = rows.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).select("id", "digest", "owner")
    shared = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = narrow.join(shared.drop("n"), "digest").where("id <> first").select("owner", "digest", "first").distinct()

    total = rows.agg(F.sum(F.col("bytes") + 1200)).first()[0] or 0
    archives = max(1, -(-int(total) // archive_bytes))
    placed = (
        rows.repartition(archives, "owner", "digest")
        .join(later, ["owner", "digest"], "left")
        .withColumn("copy", F.row_number().over(Window.partitionBy("owner", "digest").orderBy("url")))
    )

    def capture_id(owner: Column, copy: Column, kind: str) -> Column:
        return F.concat_ws(":", F.lit("urn:capture"), owner, F.left("digest", F.lit(16)), copy.cast("string"), F.lit(kind))

    own = capture_id(F.col("owner"), F.col("copy"), "response")
    again = F.col("first").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(_END),
    )
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    refers = F.when(
        again,
        F.concat(
            F.lit("WARC-Refers-To: <"),
            capture_id(F.col("first").cast("string"), F.lit(1), "response"),
            F.lit(f">\r\nWARC-Profile: {_REVISIT_PROFILE}"),
        ),
    )
    beside = F.concat(F.lit("WARC-Concurrent-To: <"), own, F.lit(">"))
    asked = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nAccept: text/html" + _END))
    told = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\nfetched-by: table"))
    records = [
        _record(
            F.when(again, "revisit").otherwise("response"), own, F.col("url"), [digest, refers],
            "application/http; msgtype=response", F.when(again, head).otherwise(F.concat(head, "html")),
        ),
        _record(
            F.lit("request"), capture_id(F.col("owner"), F.col("copy"), "request"), F.col("url"), [beside],
            "application/http; msgtype=request", asked,
        ),
        _record(
            F.lit("metadata"), capture_id(F.col("owner"), F.col("copy"), "metadata"), F.col("url"), [beside],
            "application/warc-fields", told,
        ),
    ]
    (
        placed.select(F.concat_ws(_END, *records).alias("value"))
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .text(path)
    )


def iterate_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise EOFError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def _named(lines: bytes) -> list[dict[str, str]]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n") if ":" in x)
    return [{"name": n.strip().lower(), "value": v.strip()} for n, _, v in pairs]


def _parsed(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, ident = fields.get("warc-type", ""), lambda k: fields.get(k, "").strip("<>") or None
    row = {
        "record_id": ident("warc-record-id"),
        "record_type": kind,
        "concurrent_to": ident("warc-concurrent-to"),
        "refers_to": ident("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
    }
    if kind == "metadata":
        return row | {"fields": _named(block)}
    head, _, payload = block.partition(b"\r\n\r\n")
    row["fields"] = _named(head)
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        length = next((x["value"] for x in row["fields"] if x["name"] == "content-length"), None)
        return row | {"payload_bytes": int(length) if length else None, "payload_digest": told}
    digest = hashlib.sha256(payload).hexdigest()
    row |= {"payload_bytes": len(payload), "payload_digest": digest, "digest_ok": told is None or told == digest}
    return row | {"payload": payload} if with_payload else row


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the gzip or plain archives below ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                unpacked = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for fields, block in iterate_records(io.BufferedReader(unpacked, 1 << 20)):
                    rows.append(_parsed(fields, block, with_payload))
                    held += 500 + len(block) * with_payload
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _PARSED)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PARSED)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, _PARSED_DDL)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), requests, metadata.

    A record belongs to the response that it names in ``concurrent_to``, that names
    it, or that is named by the record it names. Requests and metadata without a
    response make a capture of their own with a null response. A capture's records
    are few by the standard; they are held in one row, ordered by identifier.
    ``records`` is read more than once and should be a stored table.
    """
    is_answer = F.col("record_type").isin("response", "revisit")
    answers, others = records.where(is_answer), records.where(~is_answer)
    roots = (
        answers.select(F.col("record_id").alias("root"), F.explode(F.array("record_id", "concurrent_to")).alias("id"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("root").alias("root"))
    )
    links = others.select("record_id", "concurrent_to").distinct()
    named = links.join(roots.toDF("concurrent_to", "by_name"), "concurrent_to", "left").join(
        roots.toDF("record_id", "by_answer"), "record_id", "left"
    )
    named = named.select("record_id", "concurrent_to", F.coalesce("by_answer", "by_name").alias("root"))
    second = named.where("root IS NOT NULL").groupBy(F.col("record_id").alias("concurrent_to")).agg(F.min("root").alias("via"))
    resolved = named.join(second, "concurrent_to", "left").select(
        "record_id", F.coalesce("root", "via", "concurrent_to", "record_id").alias("capture")
    )
    resolved = resolved.groupBy("record_id").agg(F.min("capture").alias("capture"))
    keyed = answers.withColumn("capture", F.col("record_id")).unionByName(others.join(resolved, "record_id"))
    parts = {
        "response": ("record_type", "record_id", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "digest_ok", "fields", "payload"),
        "requests": ("record_id", "target_uri", "date", "fields"),
        "metadata": ("record_id", "target_uri", "date", "fields"),
    }
    of = {"response": is_answer, "requests": F.col("record_type") == "request", "metadata": F.col("record_type") == "metadata"}
    wide = {k: F.when(of[k], F.struct(*parts[k])) for k in parts}
    return keyed.groupBy("capture").agg(
        F.min(wide["response"]).alias("response"),
        *[F.sort_array(F.collect_list(wide[k])).alias(k) for k in ("requests", "metadata")],
    )


def op1_warc_transactions(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble_captures(stored(read_archives(spark, path), "records"))

    def page_of(record_id: Column) -> Column:
        return F.regexp_extract(record_id, r"^urn:capture:(-?\d+):", 1).try_cast("long")

    return captures.where("response IS NOT NULL").select(
        page_of(F.col("capture")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )


_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to,
       1 AS n_requests, 1 AS n_metadata
FROM d"""

QUERIES = {"op1_warc_transactions": op1_warc_transactions}
ORACLE = {"op1_warc_transactions": _SQL}
