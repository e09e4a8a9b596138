"""WARC archives with revisit records: write, read back, resolve by payload digest.

Headers (id, digest, length) are the only rows dealt by digest; payloads move once, dealt by
page id. Archives are written by Spark's text writer: a record's last line feed is the line
separator, so the files are WARC byte for byte (gzip over the whole file). They are read by
Content-Length, never by searching payloads for separators.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

#: Base-32 alphabet (fixed values, RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string"


def base32(sha1: Column) -> Column:
    """Bare upper-case base-32 of a hex SHA-1: each five hex digits are four characters."""
    out = []
    for g in range(8):
        v = F.conv(F.substr(sha1, F.lit(5 * g + 1), F.lit(5)), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, least: int = 0, part_bytes: int = 128 << 20) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, n) of ``pages``; n
    counts the rows of one page_id and payload. Payloads are dealt once, to parts of about ``part_bytes``,
    which become files; payloads of any length are whole.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response, the others
    revisit it; shorter ones are all responses. A null html is an empty payload. A null page_id
    comes last and is a response only where its payload has no other; of rows equal in page_id and
    payload one (by url) stands for the page and the others revisit it."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # The lambda binds the SHA-1, which would else be taken again for each of its pieces.
    base = base.withColumn("payload_digest", F.get(F.transform(F.array(F.sha1(F.col("html").cast("binary"))), base32), F.lit(0)))
    base = base.withColumn("_k", F.coalesce("page_id", F.lit(-(1 << 63))))  # null comes by its own key
    n_bytes = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n_parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // part_bytes))
    heads = base.where(F.col("payload_bytes") >= least).select("_k", "page_id", "payload_digest")
    # Counts meet the maps' partial sums, so a digest of many pages is one row a task.
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    revisits = (
        heads.join(first, "payload_digest")
        .where("page_id is null or page_id > refers_to")
        .select(F.col("_k").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to")
        .distinct()
    )
    same = W.partitionBy("_k", "payload_digest").orderBy("url")  # dealt as the join is, so payloads move once
    out = base.repartition(n_parts, "_k", "payload_digest").join(
        revisits, (F.col("_k") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left"
    ).withColumn("_n", F.row_number().over(same))
    again = (F.col("_n") > 1) & (F.col("payload_bytes") >= least)
    return out.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(F.col("_digest").isNotNull() | again, "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("_digest").isNotNull(), F.col("refers_to")).when(again, F.col("page_id")).alias("refers_to"),
        F.col("_n").alias("n"),
    )


def write_archives(records: DataFrame, path: str, records_per_file: int = 2000, date: str | None = None) -> None:
    """Write the rows of ``with_revisits`` as gzipped WARC files with fresh headers (date: now). A record's
    id names page, payload and number, so no two records share one."""
    crlf, date = "\r\n", date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    urn = lambda c, n: F.concat(F.lit("<urn:page:"), text(c), F.lit(":"), "payload_digest", F.lit(":"), n, F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(crlf + crlf),
    )
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("html")))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    lines = F.concat_ws(
        crlf,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id", text("n"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to", F.lit("1")))),
        F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    )
    text = records.withColumn("_block", block).select(F.concat(lines, F.lit(crlf + crlf), "_block", F.lit("\r\n\r")).alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _records(content: bytes):
    """(headers, block) of each record of one gzipped archive, decompressed as it is read."""
    unzip, held, at = zlib.decompressobj(31), bytearray(), 0
    view = memoryview(content)

    def more() -> bool:
        nonlocal at
        if at >= len(view):
            return False
        held.extend(unzip.decompress(view[at : at + (1 << 16)]))
        at += 1 << 16
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if bytes(held).strip():
                raise ValueError("an archive ends within a record's header")
            return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: digest and length are a response's own payload's,
    a revisit's as its header states them (length null: ``resolve`` finds it)."""
    number = lambda urn: int(s) if (s := urn.removeprefix("<urn:page:").split(":")[0]) else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for h, block in _records(content):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    full = h["warc-type"] == "response"
                    rows.append({
                        "page_id": number(h["warc-record-id"]), "record_type": h["warc-type"],
                        "payload_bytes": len(payload) if full else None,
                        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if full
                        else h["warc-payload-digest"].removeprefix("sha1:"),
                        "refers_to": None if full else number(h["warc-refers-to"]),
                        "target_uri": h.get("warc-target-uri"),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
    ])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with the length of the original that they refer to, responses as they are.

    Only headers move; one row a digest on the originals' side, so Spark may split a digest of many
    revisits. A revisit whose original is in no archive keeps a null length."""
    originals = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    revisits = records.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    return records.where("record_type = 'response'").unionByName(
        revisits.withColumn("payload_bytes", F.col("_bytes")).select(*records.columns)
    )


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write deduplicated archives of ``pages`` into the shared folder, read them back and resolve."""
    spark, path = pages.sparkSession, scratch(pages.sparkSession)
    write_archives(with_revisits(pages, least), path)
    return resolve(read_archives(spark, path))
