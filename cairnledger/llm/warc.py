"""WARC archives: pages written as records of gzip members, and read back in sequence.

Writing. Pages with equal payloads share one response record, that of the smallest page_id; the others are revisit records, which hold the
headers of the response and name the record that has the payload. Which payloads recur is found from digests alone; the pages meet those digests by
a broadcast only while these are few enough (`small`), else by a join that Spark can split on a hot digest. Each task writes its pages as files of about
FILE_BYTES, a gzip member a record, under a name of its own attempt, and returns the files' names. The names, written as a table, are the commit: what an
attempt that was lost has left is in no table and is never read.

Reading. A task reads a file from its begin to its end: compressed bytes in pieces, one zlib stream for each member, the record's header up to the
empty line, then as many bytes as its Content-Length says, hashed as they come. Neither files nor records are held whole (payloads only where they are
asked for). Digests of the block and of the payload are compared with those stated. Where a member is damaged, its record is returned with what is
wrong, and reading goes on at the next member that begins as a WARC record does.

Defined results: a null html is an empty payload; empty payloads are equal. Rows with the same page_id and payload are all responses if that id is the
smallest (none can refer to another), and share a record id. A null page_id counts after all others; pages without any other are responses. A null url has
no target, other characters than printable ASCII are percent-encoded in it. An empty table gives no files and no records. Other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, own_folder, small

#: Compressed bytes beyond which a task begins another file, and which are read at once; of a stream that is inflated at once.
FILE_BYTES, READ_BYTES, INFLATE_BYTES = 256 << 20, 1 << 18, 1 << 20
#: A header that is longer is no header.
HEADER_BYTES = 1 << 16
#: When pages were taken; the tables don't say.
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, url string, record_type string, record_id string, refers_to_record string, refers_to string, stated_bytes long, payload_bytes long, payload_digest string, payload binary, file string, at long, problem string"
RECORD_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-page-records")


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder's URI, which every executor can reach, and the path in it."""
    if "://" not in folder:
        return pa.fs.LocalFileSystem(), folder.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(folder)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def target(url: str) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def member(page_id: str | None, url: str | None, payload: bytes, first: str | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of page `first`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest, revisit = base32_sha1(payload), first is not None
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Page-ID", page_id),
        ("WARC-Target-URI", url if url is None else target(url)), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(first, digest) if revisit else None),
        ("WARC-Refers-To-Page-ID", first), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None) + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(END) + pack.flush()


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, first): first is the page that an equal payload of `least` bytes or more is taken from, null for a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.unhex(F.sha2("html", 256))
    groups = rows.where(F.octet_length("html") >= least).select("page_id", key.alias("key")).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    recurring = as_table(groups.where("n > 1 AND first IS NOT NULL").select("key", "first"))
    met = rows.withColumn("key", key).join(small(recurring, recurring.count()), "key", "left")
    return met.select("page_id", "url", "html", F.when(~F.equal_null("page_id", "first"), F.col("first")).alias("first"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages (page_id, url, html) under a folder that all executors share; returns the committed files: file, n_records, n_bytes."""
    columns = with_first(pages, least).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_folder(folder)
        made = False
        out: BinaryIO | None = None
        name, n_records, n_bytes = "", 0, 0

        def finish() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "n_records": n_records, "n_bytes": n_bytes}])

        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    if not made:
                        files.create_dir(top, recursive=True)
                        made = True
                    name, n_records, n_bytes = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(posixpath.join(top, name), compression=None)
                data = member(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py())
                out.write(data)
                n_records, n_bytes = n_records + 1, n_bytes + len(data)
                if n_bytes >= file_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return as_table(columns.mapInArrow(run, "file string, n_records long, n_bytes long"))


class Damaged(Exception):
    """What is wrong with a record."""


@dataclass
class Member:
    """The bytes of one gzip member, inflated as they are asked for. `source` gives compressed bytes; `rest` is what was read beyond the member, or
    where the member can't be inflated, the bytes from which the next one may be looked for."""

    source: BinaryIO
    rest: bytes
    stream: zlib._Decompress = field(default_factory=lambda: zlib.decompressobj(31))
    held: bytes = b""
    begun: bool = False
    broken: str = ""

    def more(self) -> bool:
        """Inflates some more; False at the end of the member."""
        if self.broken:
            raise Damaged(self.broken)
        while not self.stream.eof:
            packed = self.stream.unconsumed_tail or self.rest or self.source.read(READ_BYTES)
            self.rest = b""
            try:
                if not packed:
                    raise Damaged("the file ends inside a member")
                got = self.stream.decompress(packed, INFLATE_BYTES)
            except (Damaged, zlib.error) as e:
                self.broken = str(e) if isinstance(e, Damaged) else "a member that can't be inflated"
                self.rest = packed if self.begun else packed[1:]
                raise Damaged(self.broken) from e
            self.begun = True
            if self.stream.eof:
                self.rest = self.stream.unused_data
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before the next mark, which goes with it."""
        searched = 0
        while (at := self.held.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.held)
            if searched > most or not self.more():
                raise Damaged("no header")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def skip(self) -> bytes:
        """Passes over what is left of the member; what was read beyond it."""
        try:
            while self.more():
                self.held = b""
        except Damaged:
            pass
        return self.rest

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise Damaged("the block is shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def headers(text: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in text.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def stated_digest(value: str) -> str:
    return value.rpartition(":")[2].upper()


def read_record(body: Member, payload: bool) -> dict:
    """The record of a member. The block of an HTTP message has headers, an empty line, and the payload; other blocks are the payload."""
    head = body.until(END, HEADER_BYTES)
    if not head.startswith(b"WARC/"):
        raise Damaged("no WARC record")
    named = headers(head)
    try:
        length = int(named["content-length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no Content-Length") from e
    block_hash, payload_hash = hashlib.sha1(), hashlib.sha1()
    message, size, kept = b"", 0, []
    in_payload = not named.get("content-type", "").startswith("application/http")
    for piece in body.take(length):
        block_hash.update(piece)
        if not in_payload:
            message += piece
            if (at := message.find(END)) >= 0:
                in_payload, piece, message = True, message[at + len(END) :], message[:at]
            elif len(message) > HEADER_BYTES:
                raise Damaged("no HTTP header")
            else:
                continue
        payload_hash.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    tail = b""
    while body.held or body.more():
        tail, body.held = (tail + body.held)[:8], b""
    digest = base64.b32encode(payload_hash.digest()).decode()
    kind = named.get("warc-type")
    stated = headers(b"\r\n" + message).get("content-length", "")
    found = {
        "page_id": named.get("warc-page-id"), "url": named.get("warc-target-uri"), "record_type": kind, "record_id": named.get("warc-record-id"), "refers_to_record": named.get("warc-refers-to"),
        "refers_to": named.get("warc-refers-to-page-id"), "stated_bytes": int(stated) if stated.isdigit() else None, "payload_bytes": size, "payload_digest": digest, "payload": b"".join(kept) if payload else None,
    }
    if kind == "revisit":  # the payload is that of another record
        found |= {"payload_bytes": None, "payload": None, "payload_digest": stated_digest(named.get("warc-payload-digest", ""))}
    elif "warc-payload-digest" in named and stated_digest(named["warc-payload-digest"]) != digest:
        found["problem"] = "another payload than its digest states"
    if "warc-block-digest" in named and stated_digest(named["warc-block-digest"]) != base64.b32encode(block_hash.digest()).decode():
        found["problem"] = "another block than its digest states"
    if tail != END:
        found["problem"] = "no end of the record after its block"
    return found


#: How a gzip member begins.
MAGIC = re.compile(rb"\x1f\x8b\x08")


def records_of(source: BinaryIO, payload: bool = False) -> Iterator[dict]:
    """The records of an archive in sequence, each with the place of its member."""
    rest, read = b"", 0

    class Counted:
        def read(self, n: int) -> bytes:
            nonlocal read
            got = source.read(n)
            read += len(got)
            return got

    counted = Counted()
    while rest or (rest := counted.read(READ_BYTES)):
        at = read - len(rest)
        body = Member(counted, rest)
        try:
            found = read_record(body, payload)
        except Damaged as e:
            found = {"problem": str(e)}
        yield {"at": at} | found
        rest = body.skip()
        while body.broken and not (begin := MAGIC.search(rest)):
            if not (more := counted.read(READ_BYTES)):
                return
            rest = rest[-2:] + more
        if body.broken:
            rest = rest[begin.start() :]


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """The records (RECORD) of archives (file), a file a task at a time; `payload` returns what responses hold."""
    n = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, {"payload": pa.binary(), "at": pa.int64(), "stated_bytes": pa.int64(), "payload_bytes": pa.int64()}.get(c, pa.string())) for c in RECORD_FIELDS])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = open_folder(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for r in records_of(source, payload):
                        rows.append(r | {"file": file})
                        held += 500 + len(r.get("payload") or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file").repartition(max(1, n)).mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload's size for revisits too: that of the response which they name, whose digest must be theirs. A revisit without one has
    a problem."""
    responses = records.where("record_type = 'response' AND problem IS NULL").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("payload_bytes").alias("there_bytes"), F.first("payload_digest").alias("there_digest")
    )
    told = as_table(responses)  # joined as a table, so a response that many revisit can be split
    is_revisit = F.equal_null("record_type", F.lit("revisit"))
    revisits = records.where(is_revisit).join(told, "refers_to_record", "left")
    same = F.equal_null("there_digest", "payload_digest") & F.equal_null("there_bytes", "stated_bytes")
    problem = F.coalesce("problem", F.when(~same, F.lit("its response isn't there or differs")))
    settled = revisits.withColumns({"problem": problem, "payload_bytes": F.col("there_bytes")})
    return records.where(~is_revisit).unionByName(settled.select(*records.columns))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, problem."""
    kind = pages.schema["page_id"].dataType.simpleString()
    files = write_archives(pages, f"{own_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}", least)
    records = as_table(read_archives(files).drop("payload"))
    return resolved(records).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url", "problem")
