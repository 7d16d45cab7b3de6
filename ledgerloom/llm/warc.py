"""WARC archives: written from a table of pages, and read back record by record.

Writing. Each record is a gzip member of its own, so archives can be cut and joined at any record. Pages
with equal payloads of MIN_BYTES or more have one ``response``, that of the largest page_id; the others
are ``revisit`` records that name it and carry no payload. Only digests and ids are grouped to find it;
payloads move once at most, dealt by page, so a payload that many pages share doesn't gather anywhere.
Archives go through Spark's own file writer and so to any store Spark knows: committed as a whole, written anew
if an executor is lost. Of ARCHIVE_BYTES of payload, about, a task begins another file. That writer ends every row with a
separator, here a zero byte, which is also the last byte of a gzip member of less than 16 MiB of content; so rows are
members without it. After a larger record comes an empty member. Files are plain gzip throughout.

Reading. An archive is read in sequence: members are decompressed incrementally in small chunks, the
record's Content-Length frames its block, and block and payload are checked against their digests, where it
names them, while they pass through, so a record needs no more memory than its headers. Records of any kind are read, also those of other
writers; names of fields are the same in any case. A record that breaks any of these rules stops the job with BadRecord.

Rows: a null html is an empty payload; a null url an empty target. A page without a page_id has no id of
its own in the archive; it is a response unless a page with an id has the same payload. Rows that
repeat page_id and html are all alike. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import raw_texts, slices
from ledgerloom.sources.scratch import scratch_folder

MIN_BYTES = 0
CHUNK = 1 << 16
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
#: What the file writer puts after each row, and the end of each member.
LAST = "\0"
#: Bytes of payload, about, of an archive file.
ARCHIVE_BYTES = 128 << 20
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
#: Kinds of records whose block is an HTTP message.
HTTP_KINDS = ("response", "revisit", "request")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """An archive that breaks the format, or whose digests don't match."""


def digest(sha1: bytes) -> str:
    """A SHA-1 in upper-case base32."""
    return base64.b32encode(sha1).decode()


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """A compressed record: a response, or a revisit of ``refers_to``, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", "<urn:page:none>" if page_id is None else _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest(sha1)}"),
        ("WARC-Block-Digest", f"sha1:{digest(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level=1, wbits=31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html", BATCH_BYTES):
            columns = [batch.column(x).to_pylist() for x in ("page_id", "url", "size", "sha1", "refers_to")]
            rows = zip(raw_texts(batch.column("html")), *columns, strict=True)
            made = [record(i, url or "", html or b"", size, sha1, refers) for html, i, url, size, sha1, refers in rows]
            yield pa.RecordBatch.from_arrays([pa.array(map(_open_ended, made), pa.binary())], ["member"])


def _open_ended(member: bytes) -> bytes:
    """A member, or a large one and an empty one, without the zero byte at the end."""
    return (member if member.endswith(b"\0") else member + EMPTY_MEMBER)[:-1]


def with_responses(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, size, sha1, refers_to``: html and refers_to are null for response and revisit, each."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.octet_length(payload).cast("long").alias("size"),
        F.unhex(F.sha1(payload.cast("binary"))).alias("sha1"),
    )
    ids = rows.filter(F.col("size") >= MIN_BYTES).select("page_id", "sha1").distinct()
    first = ids.groupBy("sha1").agg(F.max("page_id").alias("first"))
    revisits = ids.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to"))
    same = rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["sha1"] == revisits["_sha1"])
    rows = rows.join(revisits, same, "left")
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to")


def write(pages: DataFrame, folder: str) -> None:
    """Writes a record for every row of ``pages`` to archives below ``folder``."""
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    records = max(1, ARCHIVE_BYTES // max(1, int(size)))
    members = with_responses(pages).mapInArrow(_members, "member binary")
    writer = members.select(F.col("member").cast("string")).write.option("lineSep", LAST)
    writer.option("maxRecordsPerFile", records).text(folder)


@dataclass
class Record:
    #: Names in lower case.
    headers: dict[str, str]
    #: As declared by a revisit; none if it doesn't say.
    payload_bytes: int | None
    payload_digest: str


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    """Decompressed chunks, with None after each member."""
    member = None
    for chunk in chunks:
        while chunk:
            if member is None:
                chunk = chunk.lstrip(b"\0")  # padding, which gzip readers skip
                if not chunk:
                    break
                member = zlib.decompressobj(wbits=31)
            # Little is decompressed at a time, whatever a chunk holds.
            try:
                made = member.decompress(chunk, 4 * CHUNK)
            except zlib.error as error:
                raise BadRecord(f"no gzip member: {error}") from error
            chunk = member.unused_data if member.eof else member.unconsumed_tail
            if made:
                yield made
            if member.eof:
                yield None
                member = None
    if member is not None:
        raise BadRecord("an archive ends within a record")


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive, checked as they are read."""
    held, state = bytearray(), None
    for made in _inflated(chunks):
        if made is None:
            if state is not None:
                yield state.finish()
            elif held:
                raise BadRecord("a member ends within the headers of its record")
            held, state = bytearray(), None
        elif state is None:
            held += made
            end = held.find(b"\r\n\r\n")
            if end >= 0:
                state = _Block(_headers(bytes(held[:end])))
                state.add(bytes(held[end + 4 :]))
        else:
            state.add(made)


def _fields(lines: list[str]) -> dict[str, str]:
    """``name: value`` lines; a line that starts with white space goes on with the value before."""
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        else:
            name, colon, value = line.partition(":")
            if not colon:
                raise BadRecord(f"no header: {line[:40]!r}")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _number(text: str, what: str) -> int:
    if not text.isdecimal():
        raise BadRecord(f"{what} is no number: {text[:40]!r}")
    return int(text)


def _headers(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise BadRecord(f"no record starts with {version[:20]!r}")
    found = _fields(lines)
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in found:
            raise BadRecord(f"a record has no {name}")
    return found


class _Block:
    """A record's block as it comes in, framed by Content-Length and digested without being kept."""

    def __init__(self, headers: dict[str, str]):
        self.headers = headers
        self.name, self.kind = headers["warc-record-id"], headers["warc-type"].lower()
        self.left = _number(headers["content-length"], f"{self.name}: Content-Length")
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        is_http = self.kind in HTTP_KINDS and headers.get("content-type", "application/http").startswith("application/http")
        self.http: bytearray | None = bytearray() if is_http else None
        self.declared: int | None = None
        self.size = 0
        self.after = bytearray()

    def add(self, data: bytes) -> None:
        inside, rest = data[: self.left], data[self.left :]
        self.left -= len(inside)
        self.after += rest[:8]
        self.block.update(inside)
        if self.http is not None:
            self.http += inside
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            fields = _fields(bytes(self.http[:end]).decode("latin-1").split("\r\n")[1:])
            if "content-length" in fields:
                self.declared = _number(fields["content-length"], f"{self.name}: the payload's Content-Length")
            inside, self.http = bytes(self.http[end + 4 :]), None
        self.size += len(inside)
        self.payload.update(inside)

    def finish(self) -> Record:
        if self.left or self.after != b"\r\n\r\n":
            raise BadRecord(f"{self.name}: the block's length isn't its Content-Length")
        if self.http:
            raise BadRecord(f"{self.name}: the HTTP headers don't end")
        own = {"block": digest(self.block.digest()), "payload": digest(self.payload.digest())}
        for part in ("block", "payload"):
            kind, _, wanted = self.headers.get(f"warc-{part}-digest", "").partition(":")
            if part == "payload" and self.kind == "revisit":
                if self.size:
                    raise BadRecord(f"{self.name}: a revisit has a payload")
                own[part] = wanted
            elif kind.lower() == "sha1" and wanted.upper() != own[part]:
                raise BadRecord(f"{self.name}: the {part}'s digest doesn't match")
        if self.kind == "revisit":
            return Record(self.headers, self.declared, own["payload"])
        if self.declared is not None and self.size != self.declared:
            raise BadRecord(f"{self.name}: the payload's length isn't as declared")
        return Record(self.headers, self.size, own["payload"])


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    for batch in batches:
        for content in batch.column(0):
            view = memoryview(content.as_buffer())
            made = []
            for x in read_records(bytes(view[at : at + CHUNK]) for at in range(0, len(view), CHUNK)):
                h = x.headers
                made.append((_page(h["warc-record-id"]), h.get("warc-target-uri"), x.payload_bytes, x.payload_digest,
                             h["warc-type"].lower(), _page(h.get("warc-refers-to"))))
                if len(made) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record below ``folder``.

    Ids are those of pages; records of other writers have none.
    """
    archives = spark.read.format("binaryFile").load(folder).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.mapInArrow(_rows, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the scratch folder and reads them back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY hex) END AS first FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM named
"""
