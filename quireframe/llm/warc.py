"""WARC archives: writing pages as request, response or revisit, and metadata records, and assembling them again.

Writing: a page's payload digest is looked up among all pages; the page with the largest id of those with an
equal payload is a response, the others revisit it. A page's three records go into one archive; records end in
two line ends, which is the line separator of the text files written, gzipped, to shared storage. Reading: archives are parsed
a record at a time; requests and metadata are grouped with the response or revisit that their WARC-Concurrent-To names.

A record's id is made of what it records. Only rows that share page_id and payload need a number besides, and where the page that others revisit
is repeated like that, its number has to be the same to all: then, and only then, the input is written before it is numbered.

Defined results: a null html is an empty payload; a null url is an empty target; line ends in a url become
spaces; rows that share a page_id are captures of their own, and all rows with the largest id of an equal
payload are responses; a null page_id is kept and revisits only if another page has an id; payloads smaller
than `least` are all responses; an empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of payload that an archive holds about, and the most records of it.
FILE_BYTES, FILE_RECORDS = 64 << 20, 6000
RECORD = (
    "record_id string, kind string, concurrent_to string, target string, date string, digest string, refers_to string, "
    "page_id long, payload_bytes long, payload binary, fields string"
)


def base32_of_hex(sha1: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: five of them make four letters."""
    letters = []
    for k in range(8):
        n = F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends; headers that are null are left out."""
    lines = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _keepers(rows: DataFrame) -> DataFrame:
    """Of each payload: the page that is its response, the number of one of its rows and whether it has several (again), copies, bytes, and whether
    other pages have it (visited). Written, so that hot payloads can be split in a join."""
    page, row = F.col("page_id"), F.col("row")
    by = rows.groupBy(F.col("sha").alias("of")).agg(
        F.max(F.struct(page, row)).alias("last"), F.max(F.struct(page, (-row).alias("row"))).alias("first"), F.count("*").alias("copies"),
        F.max(F.octet_length("html")).alias("size"), ((F.count(page) < F.count("*")) | (F.min(page) < F.max(page))).alias("visited"),
    )
    again = F.col("last.row") > -F.col("first.row")
    return common.written(by.select("of", F.col("last.page_id").alias("keeper"), F.col("last.row").alias("keeper_row"), again.alias("again"), "copies", "size", "visited"), "warc-payloads")


def write(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes all pages; the folder of the archives. Payloads are shuffled once, to meet their equals' largest id."""
    spark = pages.sparkSession
    path = common.fresh_path(spark, "warc")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.translate(F.coalesce(url_col, F.lit("")), "\r\n", "  ").alias("url"), common.empty_if_null(F.col(html_col)).alias("html")
    )
    base = base.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    first = _keepers(base)
    held = first.agg(F.sum(F.col("copies") * F.col("size")), F.sum("copies"), F.max(F.col("again") & F.col("visited"))).first()
    if held[2]:
        common.drop(first)
        base = common.written(base, "warc-pages")
        first = _keepers(base)
    a_file = max(1, min(FILE_RECORDS // 3, FILE_BYTES * (held[1] or 1) // max(held[0] or 1, 1)))  # captures
    rows = base.join(first, F.col("sha") == F.col("of"))
    once = lambda page: F.when(~F.col("again") & page.eqNullSafe(F.col("keeper")) & page.isNotNull(), F.lit("-"))  # noqa: E731  the only row of its page and payload
    rid = lambda kind, page, row: _uuid(F.lit(kind), F.coalesce(page.cast("string"), F.lit("-")), F.col("b32"), F.coalesce(once(page), row.cast("string")))
    rows = rows.select("page_id", "url", "html", "keeper", "keeper_row", "again", base32_of_hex(F.col("sha")).alias("b32"), F.octet_length("html").alias("n"), "row")
    is_copy = (F.col("n") >= least) & (F.col("keeper").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.withColumn("copy", is_copy).withColumn("rid", rid("capture", F.col("page_id"), F.col("row")))
    head = lambda n: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    common_to = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    told = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "b32")), ("WARC-Page-ID", F.col("page_id").cast("string")), ("WARC-Payload-Length", F.col("n").cast("string"))]
    full = _record("response", F.col("rid"), [*common_to, *told, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head(F.col("n")), F.col("html")))
    copy = _record(
        "revisit", F.col("rid"),
        [*common_to, *told, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", rid("capture", F.col("keeper"), F.col("keeper_row"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        head(F.col("n")),
    )
    with_it = [*common_to, ("WARC-Concurrent-To", F.col("rid"))]
    request = _record(
        "request", rid("request", F.col("page_id"), F.col("row")), [*with_it, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n")),
    )
    notes = _record(
        "metadata", rid("metadata", F.col("page_id"), F.col("row")), [*with_it, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadBytes: "), F.col("n").cast("string"), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(request, F.when(F.col("copy"), copy).otherwise(full), notes)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * a_file).text(path)
    return path


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield headers, block


def records(spark: SparkSession, path: str, kinds: tuple[str, ...], payloads: bool = False) -> DataFrame:
    """The records of some kinds. Payload digests are computed anew and must equal the headers' where the payload is there."""
    whole = ("response", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds_of = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.binary(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                    for h, block in parse(stream):
                        kind = h["warc-type"]
                        if kind not in kinds:
                            continue
                        payload, digest = None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        n = len(payload) if payload is not None else int(h["warc-payload-length"]) if kind in whole else None
                        num = lambda x: int(h[x]) if x in h else None  # noqa: E731, B023
                        rows.append((
                            h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest,
                            h.get("warc-refers-to"), num("warc-page-id"), n,
                            payload if payloads else None, block.decode("utf-8", "replace") if kind not in whole else None,
                        ))
                        held += len(payload or b"") if payloads else 0
                        if len(rows) >= 2000 or held > 1 << 23:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captures(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One nested row a capture: the response or revisit, with its request and metadata where there are any. All records are read once
    and meet by the record that they are concurrent to; a revisit meets the response that it refers to by that one's record id."""
    every = records(spark, path, ("response", "revisit", "request", "metadata"), payloads)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    main = F.max(F.when(of("response", "revisit"), F.struct("record_id", "kind", "digest", "payload_bytes", "refers_to", "page_id", "target", "date", "payload"))).alias("main")
    request = F.max(F.when(of("request"), F.struct("record_id", "target", F.col("fields").alias("head")))).alias("request")
    notes = F.max(F.when(of("metadata"), F.struct("record_id", "fields"))).alias("metadata")
    met = every.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(main, request, notes).where("main is not null")
    met = common.written(met, "warc-captures")
    meant = met.where("main.kind = 'response'").select(F.col("capture").alias("r_id"), F.col("main.page_id").alias("refers_page"))
    met = met.join(meant, F.col("main.refers_to") == F.col("r_id"), "left")
    shown = F.struct("main.record_id", "main.kind", "main.digest", "main.payload_bytes", "main.payload", "main.refers_to", "refers_page")
    return met.select("main.page_id", "main.target", "main.date", shown.alias("response"), "request", "metadata")
