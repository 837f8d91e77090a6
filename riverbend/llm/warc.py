"""WARC archives through a chunked record table.

Writing streams every payload into its record in pieces of ``CHUNK_BYTES``;
reading streams archives back as rows of record and chunk number, each with the
bytes and the SHA-1 digest of the payload up to and with that chunk, so no
record is ever allocated whole. The row whose ``last`` is true carries the full
payload's length and digest.

Records are gzip members of WARC 1.1 files. Of records with equal payloads (of
at least ``min_bytes`` bytes), that with the smallest page_id is a response, the
others are revisits that keep its HTTP header, the digest and a reference, but
no payload. A group of equal payloads is combined before the shuffle to one row
(smallest id). Which rows are revisits is decided on ids and digests alone; payload rows meet
only the revisits, by their own id and digest, in an outer join that Spark may
broadcast within its size limit, or split where one id is frequent. Arrow batches are bounded in bytes, so a task
holds a few payloads at a time.

Defined cases. Null html is an empty payload; empty payloads take part in
revisits like others. Null url: the record has no target URI. Null page_id:
never the smallest; a group of null ids only is all responses. Repeated rows of
a group's smallest page_id are all responses. Control characters in a URL are
percent-encoded in the header. Empty table: no archives, empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared

CHUNK_BYTES = 1 << 18
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"

CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no bigint, last boolean, "
    "payload_bytes bigint, payload_digest string, data binary"
)
_ARROW = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()),
    ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()),
])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _pieces(payload: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(payload), CHUNK_BYTES):
        yield payload[at:at + CHUNK_BYTES]


def record(page_id: int | None, url: str | None, payload: memoryview, sha1_hex: str, first: int | None) -> Iterator[bytes]:
    """A record as pieces of a gzip member; ``first`` is the page_id a revisit refers to, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1_hex))}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    yield pack.compress("\r\n".join(lines).encode() + http)
    if not revisit:
        for piece in _pieces(payload):
            yield pack.compress(piece)
    yield pack.compress(b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest (hex), first: the pages whose payload another page of a smaller page_id has, and that of the smallest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    x = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    x = shared.materialise(x.where(F.col("n") >= min_bytes).groupBy("page_id", "digest").agg(F.lit(1).alias("one")).select("page_id", "digest"), "payloads")
    group = x.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return x.join(group, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the manifest (uri, n_records). Files appear whole by rename; a retried task writes its file again."""
    spark = pages.sparkSession
    shared.small_batches(spark)
    again = shared.materialise(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "first")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    x = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    x = x.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def pieces() -> Iterator[bytes]:
            nonlocal n
            for b in batches:
                for page, url, payload, digest, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    yield from record(page, url, memoryview(payload.as_buffer()), digest, first)
                    n += 1

        stream = pieces()
        start = next(stream, None)
        if start is None:
            return

        def rest() -> Iterator[bytes]:
            yield start
            yield from stream

        shared.write_atomically(uri, rest())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n]})

    return shared.materialise(x.mapInArrow(shared.lean(run), "uri string, n_records bigint"), "archives")


class _Stream:
    """Bytes of all gzip members of an archive, read in pieces."""

    def __init__(self, raw):
        self.raw, self.held, self.packed = raw, b"", b""
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.raw.read(CHUNK_BYTES)
                if not self.packed:
                    return False
            piece = self.member.decompress(self.packed, CHUNK_BYTES)
            self.packed = self.member.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def upto(self, n: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("the archive ends inside a payload")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = urn.strip("<>")[len(_URN):] if urn else "null"
    return None if number == "null" else int(number)


def chunks(raw, with_data: bool = True) -> Iterator[tuple]:
    """Rows of CHUNKS of an open archive, in order; a payload's chunks have CHUNK_BYTES bytes except the last."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http_head = stream.until(b"\r\n\r\n")
        left = int(warc["content-length"]) - len(http_head) - 4
        record_id, kind = warc["warc-record-id"].strip("<>"), warc["warc-type"]
        page, refers = _page(warc["warc-record-id"]), _page(warc.get("warc-refers-to"))
        stated = warc["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            yield record_id, page, kind, refers, 0, True, int(_fields(http_head)["content-length"]), stated, b"" if with_data else None
        else:
            sha, done, number = hashlib.sha1(), 0, 0
            while True:
                part = bytearray()
                while left and len(part) < CHUNK_BYTES:
                    piece = stream.upto(min(left, CHUNK_BYTES - len(part)))
                    left -= len(piece)
                    part += piece
                sha.update(part)
                done += len(part)
                so_far = base32(sha.digest())
                if not left and so_far != stated:
                    raise ValueError(f"{record_id}: the payload does not have its digest")
                yield record_id, page, kind, refers, number, not left, done, so_far, bytes(part) if with_data else None
                number += 1
                if not left:
                    break
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError(f"{record_id}: the record does not end where its length says")


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table (columns: CHUNKS) of the manifest's archives; data is null without with_data."""
    spark = manifest.sparkSession
    uris = sorted(r[0] for r in manifest.select("uri").collect())  # one row for each archive
    if not uris:
        return spark.createDataFrame([], CHUNKS)
    spread = spark.createDataFrame(spark.sparkContext.parallelize([(u,) for u in uris], len(uris)), "uri string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = shared.filesystem(uri)
                with store.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for row in chunks(raw, with_data):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return spread.mapInArrow(shared.lean(run), CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back, and returns one row per record from the last chunks."""
    found = read(write(pages, folder or shared.new_folder(pages.sparkSession, "warc"), min_bytes), with_data=False)
    return found.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
