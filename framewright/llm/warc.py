"""WARC archives of pages: writing, reading back, and assembly of each capture's records.

Writing is JVM-only: a capture's request, response (or revisit) and metadata records become one
string, and Spark's text writer with the record trailer as line separator makes the archive files,
gzip-compressed, on any file system Spark reaches. Reading takes the files as binary and parses records by
Content-Length; assembly groups them by their concurrent-to identifiers, in whichever direction records of a file name each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, part_of, scratch

#: Payload bytes from which an equal payload is written once.
REVISIT_FROM = 100
#: Captures in an archive file at most, and bytes of payload that it is laid out for (by the mean payload), as a reader takes a file whole.
CAPTURES_PER_FILE, FILE_BYTES = 20_000, 64 << 20
#: Repeated payloads up to which they are broadcast, one row each.
BROADCAST_PAYLOADS = 200_000
#: Plan nodes over which row numbers come out the same when a task is run again.
STABLE = frozenset("Project Filter SubqueryAlias LogicalRelation Relation LocalRelation LogicalRDD DataSourceV2ScanRelation RelationV2".split())
DATE = "1970-01-01T00:00:00Z"
TRAILER = "\r\n\r\n"


def _urn(kind: str, *of: Column) -> Column:
    """Record identifier: a UUID shape over a hash of the kind and the row."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, block: Column, content: str, *headers: tuple[str, Column]) -> Column:
    """One record without its trailer; a header with a null value is left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(TRAILER), block)


def _numbered(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, bytes, digest) with row, a number that stays the same when a task is run again: rows that
    came out of a shuffle are written to the shared folder first."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plan, names = [pages._jdf.queryExecution().optimizedPlan()], set()
    while plan:
        node = plan.pop()
        names.add(node.nodeName().split(" ")[0])
        plan += [node.children().apply(k) for k in range(node.children().size())]
    if not names <= STABLE:
        path = scratch(spark, "warc-pages")
        own.write.parquet(path)
        own = spark.read.parquet(path)
    return own.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))


def write(pages: DataFrame, path: str) -> None:
    """Write the captures of pages (page_id, url, html) below path.

    A null html is an empty payload, a null url an empty one; control characters in a url are dropped. Of
    equal payloads of REVISIT_FROM bytes or more, the capture with the smallest page_id (null last,
    then the first row) is the response and the others revisit it. Every row is a capture, repeated ones too.
    Digests meet without payloads. Where few payloads repeat, html isn't shuffled; else a payload's rows are dealt into parts.
    """
    base = _numbered(pages)
    rank = F.struct(F.col("page_id").isNull(), "page_id", "row", "url")
    parts = cut(base.withColumn("part", part_of("row")).groupBy("digest", "part").agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.sum("bytes").alias("bytes")))
    payload = F.col("bytes") >= REVISIT_FROM * F.col("n")  # equal payloads, equal sizes
    whole = parts.where(payload).groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("digest", "first")
    total, rows, repeated = *parts.agg(F.sum("bytes"), F.sum("n")).first(), whole.count()
    if repeated <= BROADCAST_PAYLOADS:
        c = base.join(F.broadcast(whole), "digest", "left")
    else:
        c = base.withColumn("part", part_of("row")).join(parts.select("digest", "part").join(whole, "digest"), ["digest", "part"], "left")
    per_file = max(1, min(CAPTURES_PER_FILE, int(FILE_BYTES / max(1, (total or 0) / max(1, rows or 0)))))
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    url, key = F.col("url"), (F.col("row"), F.col("page_id"), F.col("url"))
    response_id = _urn("response", *key)
    first_id = _urn("response", F.col("first.row"), F.col("first.page_id"), F.col("first.url"))
    host, target = F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.regexp_replace("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(TRAILER))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + TRAILER)
    digest = F.concat(F.lit("sha256:"), "digest")
    captures = F.concat(
        _record(F.lit("request"), _urn("request", *key), url, request, "application/http;msgtype=request", ("WARC-Concurrent-To", response_id)), F.lit(TRAILER),
        _record(
            F.when(revisit, "revisit").otherwise("response"), response_id, url, F.when(revisit, http).otherwise(F.concat(http, "html")), "application/http;msgtype=response", ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(revisit, first_id)), ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first.url"))),
        ), F.lit(TRAILER),
        _record(F.lit("metadata"), _urn("metadata", *key), url, F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")), "application/warc-fields", ("WARC-Concurrent-To", response_id)),
    )
    c.select(captures.alias("value")).write.option("lineSep", TRAILER).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


#: Fixed value: the header that a record may repeat.
REPEATABLE = "warc-concurrent-to"


def transactions(records: Iterator[tuple[str, str, list[str]]]) -> dict[str, str]:
    """Record identifier -> transaction, of records (identifier, type, concurrent-to identifiers) that name each other
    in any direction: the identifier of the group's response or revisit, else one that is only named, else any (the least, if there are more)."""
    root: dict[str, str] = {}
    kinds: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for own, kind, others in records:
        kinds[own] = kind
        find(own)
        for other in others:
            a, b = find(own), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    best: dict[str, tuple[int, str]] = {}
    for x in root:
        at = (0 if kinds.get(x) in ("response", "revisit") else 2 if x in kinds else 1, x)
        best[find(x)] = min(best.get(find(x), at), at)
    return {x: best[find(x)][1] for x in kinds}


class Reader:
    """Records of one archive, gzip members or plain, in pieces of bounded size plus one record."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left = memoryview(data), 0, b""
        self.gzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while self.at < len(self.data):
            piece = self.data[self.at : self.at + (1 << 20)]
            self.at += len(piece)
            if self.gzip is None:
                self.left += bytes(piece)
                return True
            out = self.gzip.decompress(piece)
            while self.gzip.eof and (rest := self.gzip.unused_data):
                self.gzip = zlib.decompressobj(31)
                out += self.gzip.decompress(rest)
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
            if out:
                self.left += out
                return True
        return False

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(lower-case headers, block) of each record; repeated concurrent-to headers come as one, with blanks between."""
        begin = 0
        while True:
            while (head := self.left.find(b"\r\n\r\n", begin)) < 0:
                self.left, begin = self.left[begin:], 0
                if not self._more():
                    if self.left.strip():
                        raise ValueError("an archive ends inside a record's headers")
                    return
            names = self.left[begin:head].decode("utf-8", "replace").split("\r\n")
            if not names[0].startswith("WARC/"):
                raise ValueError(f"no record starts here: {names[0][:60]!r}")
            headers: dict[str, str] = {}
            for k, _, v in (x.partition(":") for x in names[1:]):
                headers[k.lower()] = f"{headers[k.lower()]} {v.strip()}" if k.lower() == REPEATABLE and k.lower() in headers else v.strip()
            size = int(headers["content-length"])
            stop = head + 4 + size
            while len(self.left) < stop + 4:
                head, stop, self.left, begin = head - begin, stop - begin, self.left[begin:], 0
                if not self._more():
                    if len(self.left) < stop:
                        raise ValueError("an archive ends inside a record")
                    break
            yield headers, self.left[head + 4 : stop]
            begin = stop + 4


RECORD_SCHEMA = "record_id string, type string, transaction string, uri string, refers_to string, stated_digest string, page_id long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records below path, one a row. transaction: the response's identifier for all records of a capture, which name each
    other through concurrent-to, in any direction within a file; across files a record names its response.

    payload_bytes and payload_digest are of the stored payload (after the HTTP header); without with_payload the
    payload itself stays behind.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])
        for b in batches:
            for content in b.column(0):
                rows, held, data = [], 0, content.as_py()
                of = transactions((h["warc-record-id"], h.get("warc-type"), h.get(REPEATABLE, "").split()) for h, _ in Reader(data) if "warc-record-id" in h)
                for h, block in Reader(data):
                    kind, page, size, digest, payload = h.get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    elif kind == "metadata":
                        fields = dict(x.partition(":")[::2] for x in block.decode().split("\r\n"))
                        page = int(v) if (v := fields.get("page_id", "").strip()) else None
                    own = h.get("warc-record-id")
                    stated = h.get("warc-payload-digest", "").partition(":")[2] or None
                    rows.append((own, kind, of.get(own), h.get("warc-target-uri"), h.get("warc-refers-to"), stated, page, size, digest, payload if with_payload else None))
                    held += len(block) * with_payload + 400
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: transaction, request, response, metadata.

    Records join through their concurrent-to identifiers; a missing one is a null struct. A revisit's payload
    size and digest are those of the response that it refers to, as read from the archive.
    """

    def of(kinds: str, *fields: str) -> Column:
        return F.first(F.when(F.expr(f"type IN ({kinds})"), F.struct(*fields)), ignorenulls=True)

    nested = records.groupBy("transaction").agg(
        of("'request'", "record_id", "uri").alias("request"),
        of("'response', 'revisit'", "record_id", "type", "uri", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload").alias("response"),
        of("'metadata'", "record_id", "page_id").alias("metadata"),
    )
    nested = nested.where("request IS NOT NULL OR response IS NOT NULL OR metadata IS NOT NULL")  # others belong to no capture
    first = nested.where("response.type = 'response'").select(F.col("transaction").alias("id"), F.struct(F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest").alias("first"))
    revisit = F.coalesce(F.col("response.type") == "revisit", F.lit(False))
    # captures that refer to none get keys of their own, so that they don't meet in one task
    wanted = F.when(revisit, F.col("response.refers_to")).otherwise(F.concat(F.lit("none of "), "transaction"))
    joined = nested.join(first, wanted == F.col("id"), "left")
    return joined.select(
        "transaction", "request",
        F.when(F.col("response").isNotNull(), F.struct(
            "response.record_id", "response.type", "response.uri", "response.refers_to", "response.stated_digest", F.when(revisit, F.col("first.page_id")).alias("refers_to_page"),
            F.when(revisit, F.col("first.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
            F.when(revisit, F.col("first.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"), "response.payload",
        )).alias("response"), "metadata",
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives (below a new path of the shared folder), read them and assemble: one digest row per page row."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path)
    return assemble(read(spark, path, with_payload=False)).select(F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to_page").alias("refers_to"))
