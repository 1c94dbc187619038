"""WARC archives as a chunked record table.

Writing streams each payload in pieces of at most CHUNK bytes: the record's digest is carried from piece to piece, and each
piece leaves as a row (record, chunk number, bytes). A record's rows together are one gzip member that holds a WARC/1.1
record: its header, an HTTP header, and the payload. So a record is the concatenation of its rows, and any records in a row
are an archive (archive_pieces() gives its bytes in order) that other readers of WARC can open. Reading walks the rows in order
with an incremental inflater, header parser and digest, and never holds more than one piece of a payload. Equal payloads are
written once: the response is the record of the smallest id, the others are revisits (identical-payload-digest) that name its
address. A page's id, and the id that a revisit refers to, are header fields of their own (X-Page-Id, X-Refers-To-Page-Id).

Defined results: a null payload is empty; payloads under SMALLEST_REVISIT bytes are always responses; rows with a null id are
responses; rows that repeat an id are records of their own, and those of the smallest id with a payload are all responses.
An empty table gives an empty archive. Other columns than page_id, url, html are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, shuffle_width, stage_table

CHUNK = 256 << 10
SMALLEST_REVISIT = 100
#: Pages have no time of their own: records bear this one.
DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = "record string, page_id long, chunk int, last boolean, sha256 string, so_far long, data binary"


def digests(pages: DataFrame) -> DataFrame:
    """Each page's payload length and SHA-256, without the payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def originals(pages: DataFrame) -> DataFrame:
    """Digests that occur more than once, with the smallest id that has it.

    The largest group counts as one row for each map task: partial aggregation comes before the exchange.
    """
    found = digests(pages).where((F.col("payload_bytes") >= SMALLEST_REVISIT) & F.col("page_id").isNotNull())
    first = F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    return found.groupBy("payload_digest").agg(first.alias("first"), F.count("*").alias("copies")).where("copies > 1").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


def header_of(kind: str, record: str, page_id, url: str | None, digest: str, length: int, refers_to, refers_url) -> bytes:
    """The record's header and its HTTP header."""
    plain = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {plain(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {plain(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (length if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_chunks(pages: DataFrame) -> DataFrame:
    """The chunked record table of pages (page_id, url, html): CHUNK_SCHEMA."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    # Payloads travel by id, which no group of copies makes uneven; only digests meet by digest.
    small = digests(pages).where((F.col("payload_bytes") >= SMALLEST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    refers = small.join(originals(pages), "payload_digest").where("first_id < page_id").distinct()
    marked = keyed.join(refers.withColumnsRenamed({"first_id": "refers_to", "first_url": "refers_url"}), ["page_id", "payload_digest"], "left")
    marked = marked.select("page_id", "url", "payload_digest", "refers_to", "refers_url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("long").alias("payload_bytes"))

    def chunked(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "html"):
                ids, urls, shas, refers_to, refers_url, _, sizes = (c.to_pylist() if i != 5 else None for i, c in enumerate(part.columns))
                payloads = part.column(5)
                rows: list[tuple] = []
                held = 0
                for i, page_id in enumerate(ids):
                    kind = "response" if refers_to[i] is None else "revisit"
                    record = f"{task}-{seq}"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{record} {page_id} {shas[i]} {urls[i]}")
                    head = header_of(kind, str(name), page_id, urls[i], shas[i], sizes[i], refers_to[i], refers_url[i])
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    body = memoryview(payloads[i].as_buffer() or b"") if kind == "response" else memoryview(b"")
                    seen, at, chunk = hashlib.sha256(), 0, 0
                    while True:
                        piece = body[at : at + CHUNK]
                        seen.update(piece)
                        at += len(piece)
                        last = at >= len(body)
                        data = packer.compress(head if chunk == 0 else b"") + packer.compress(piece) + packer.compress(b"\r\n\r\n" if last else b"") + packer.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)
                        rows.append((record, page_id, chunk, last, seen.hexdigest(), at, data))
                        held += len(data)
                        chunk += 1
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                        if last:
                            break
                    seq += 1
                if rows:
                    yield _rows(rows)

    return marked.mapInArrow(chunked, CHUNK_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
    names = ["record", "page_id", "chunk", "last", "sha256", "so_far", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class RecordReader:
    """Reads one record, piece by piece."""

    def __init__(self):
        self.unpacker = zlib.decompressobj(31)
        self.head, self.fields, self.http, self.left, self.digest, self.size = b"", None, None, 0, hashlib.sha256(), 0

    def inflate(self, data: bytes) -> None:
        """Some bytes of the record's gzip member, inflated at most CHUNK bytes at a time."""
        while not self.unpacker.eof:
            piece = self.unpacker.decompress(data, CHUNK)
            data = self.unpacker.unconsumed_tail
            if not piece and not data:
                return
            self.feed(piece)
        if data or self.unpacker.unused_data:
            raise ValueError("a record goes on after its end")

    def header(self, data: bytes) -> dict[str, str] | None:
        self.head += data
        end = self.head.find(b"\r\n\r\n")
        if end < 0:
            return None
        lines = self.head[:end].decode("utf-8").split("\r\n")
        self.rest, self.head = self.head[end + 4 :], b""
        return {"": lines[0]} | dict(line.split(": ", 1) for line in lines[1:])

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.fields = self.header(data)
            if self.fields is None:
                return
            if not self.fields[""].startswith("WARC/"):
                raise ValueError("not a WARC record")
            data, self.left = self.rest, int(self.fields["Content-Length"])
        if self.http is None:
            self.http = self.header(data)
            if self.http is None:
                return
            self.left -= len(self.http[""]) + sum(len(f"{k}: {v}") + 2 for k, v in self.http.items() if k) + 4
            data = self.rest
        taken = data[: self.left]
        self.digest.update(taken)
        self.size += len(taken)
        self.left -= len(taken)

    def row(self) -> tuple:
        f = self.fields
        number = lambda v: None if v is None else int(v)
        claimed, length = f["WARC-Payload-Digest"].removeprefix("sha256:"), int(self.http["Content-Length"])
        if self.left or not self.unpacker.eof or f["WARC-Type"] == "response" and (self.digest.hexdigest() != claimed or self.size != length):
            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
        return number(f.get("X-Page-Id")), f["WARC-Target-URI"], length, claimed, f["WARC-Type"], number(f.get("X-Refers-To-Page-Id"))


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_chunks(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table, each put together from its chunks in their order, wherever those lie."""

    def records(batches):
        reader, last_chunk = None, -1
        for batch in batches:
            rows = []
            for chunk, last, data in zip(*(batch.column(n) for n in ("chunk", "last", "data")), strict=True):
                if chunk.as_py() == 0:
                    if reader is not None:
                        raise ValueError("a record has no last chunk")
                    reader, last_chunk = RecordReader(), -1
                if reader is None or chunk.as_py() != last_chunk + 1:
                    raise ValueError("a chunk is missing")
                last_chunk += 1
                reader.inflate(data.as_py())
                if last.as_py():
                    rows.append(reader.row())
                    reader = None
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader is not None:
            raise ValueError("a record has no last chunk")

    ordered = chunks.repartition(shuffle_width(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk")
    return ordered.select("chunk", "last", "data").mapInArrow(records, RECORD_SCHEMA)


def archive_pieces(chunks: DataFrame):
    """The bytes of one archive with all records of a chunk table, piece by piece, for a file or a socket."""
    for row in chunks.orderBy("record", "chunk").select("data").toLocalIterator():
        yield bytes(row.data)


def write_archives(pages: DataFrame, label: str = "warc") -> DataFrame:
    """The chunk table of pages, written to the shared folder; each of its files is one archive."""
    return stage_table(write_chunks(pages), label)


def op2_warc_chunks(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    archive = write_archives(read_table(spark, sf_dir, "pages"))
    return read_chunks(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when f.first_id < p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id < p.page_id then f.first_id end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""
