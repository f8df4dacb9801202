"""Operator 12: WARC archives, written and read back.

An archive is a row of gzip members, one a record. The reader goes through it once: zlib takes
the bytes in slices, the record's head ends at its blank line, Content-Length says how many
bytes its block has, and the digests of block and payload are taken as the bytes come and
compared with those in the head. It holds one archive as it is stored and, with payloads
wanted, one record; without them, one slice.

Archives go through Spark's text sink, so they are committed like any other table and may lie
on any file system. That sink ends each row with a separator: the last byte of a member,
which is the high byte of its length and zero up to 16 MB. A longer record is followed by an
empty member, whose last byte is zero too. What is on disk is nothing but gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.columns import text_of
from limpid.storage import materialised, new_path

LEAST_REVISIT = 1000
RECORDS = 20_000  # of an archive; a further one is begun beyond it
SLICE = 1 << 16
BATCH = 16 << 20
BROADCAST_KEYS = 500_000  # of repeated payloads, about 60 bytes each
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 1 << 20  # no record head is longer
_SHORT = 1 << 24


# --- one archive --------------------------------------------------------------------------


def member(head: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member (and an empty one behind it if the record is long)."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packed = _packed(raw)
    return packed if len(raw) < _SHORT else packed + _packed(b"")


def _packed(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


@dataclass
class Record:
    offset: int
    head: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int | None = None
    payload_sha1: str | None = None
    error: str | None = None


class _Member:
    """Bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.z, self.held = data, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while not self.z.eof:
            left = self.z.unconsumed_tail
            if not left:
                left = self.data[self.at : self.at + SLICE]
                self.at += len(left)
                if not len(left):
                    raise ValueError("the archive ends inside a record")
            try:
                got = self.z.decompress(left, SLICE)
            except zlib.error as broken:
                raise ValueError(f"damaged member: {broken}") from None
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What stands before `mark`, or None where the member has it not within `most` bytes."""
        while mark not in self.held:
            if len(self.held) > most or not self.more():
                return None
        found, _, self.held = self.held.partition(mark)
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the block is shorter than its Content-Length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def rest(self, most: int) -> bytes:
        """What is left of the member, read no further than just beyond `most` bytes."""
        while len(self.held) <= most and self.more():
            pass
        return self.held

    def end(self) -> int:
        """Where the next member begins."""
        return self.at - len(self.z.unused_data)


def _fields(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _read(m: _Member, record: Record, with_payload: bool) -> None:
    raw = m.until(b"\r\n\r\n", _HEAD)
    if raw is None and not m.held:
        return  # the empty member behind a long record
    if raw is None or not raw.startswith(b"WARC/"):
        raise ValueError("no record head")
    record.head = head = _fields(raw)
    if not head.get("content-length", "").isdigit():
        raise ValueError("no Content-Length")
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    http = head.get("content-type", "").startswith("application/http")
    front: bytes | None = b"" if http else None  # of an HTTP message, until its blank line
    size = 0
    for part in m.take(int(head["content-length"])):
        block.update(part)
        if front is not None:
            front += part
            if b"\r\n\r\n" not in front:
                if len(front) > _HEAD:
                    raise ValueError("no end of the HTTP head")
                continue
            front, _, part = front.partition(b"\r\n\r\n")
            record.head |= {f"http:{k}": v for k, v in _fields(front).items()}
            front = None
        payload.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    if front is not None:
        raise ValueError("no blank line behind the HTTP head")
    if head.get("warc-block-digest") not in (None, sha1_name(block.digest())):
        raise ValueError("block digest differs")
    if m.rest(4) != b"\r\n\r\n":
        raise ValueError("the record is not closed by two line ends")
    if head.get("warc-type") == "revisit":
        # The payload stands in another record; what is known of it is what the head says.
        named = head.get("warc-payload-digest", "")
        record.payload_sha1 = base64.b32decode(named[5:]).hex() if named.startswith("sha1:") else None
        length = head.get("http:content-length", "")
        record.payload_bytes = int(length) if length.isdigit() else None
        return
    if head.get("warc-payload-digest") not in (None, sha1_name(payload.digest())):
        raise ValueError("payload digest differs")
    record.payload_sha1, record.payload_bytes = payload.hexdigest(), size
    record.payload = b"".join(kept) if with_payload else None


def records(archive: bytes, with_payload: bool = True) -> Iterator[Record]:
    """Every record of an archive, in order.

    A record that cannot be read, or whose digests differ from its bytes, comes with `error`.
    Reading goes on at the next place that looks like a member; damaged members that follow
    each other without a good one between them are one error.
    """
    data, at, damaged = memoryview(archive), 0, False
    while at < len(data):
        record, m = Record(at), _Member(data, at)
        try:
            _read(m, record, with_payload)
            at, damaged = m.end(), False
        except ValueError as wrong:
            record.error = str(wrong)
            after = archive.find(_MAGIC, at + 1)
            at = len(data) if after < 0 else after
            if damaged:
                continue
            damaged = True
        if record.error or record.head:
            yield record


# --- tables -------------------------------------------------------------------------------


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, sha1, refers_to for each row of `pages` (page_id, url, html).

    A null html is an empty payload. Of equal payloads of at least `least` bytes, that with the
    largest id is kept; the others refer to it. Rows that share the largest id are the same
    capture and are all kept; null ids are the smallest, and payloads that have no other id are
    all kept. Payloads are equal where their SHA-1 and a second hash are.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        text_of("html").cast("binary").alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "h": F.xxhash64("payload")})
    # Only the digests are shuffled, counted in each task first: a payload with a third of the
    # rows sends a row per task.
    repeated = materialised(
        page.filter(F.octet_length("payload") >= least).groupBy("sha1", "h")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").drop("n"),
        "repeated-payloads",
    )
    if repeated.count() <= BROADCAST_KEYS:
        joined = page.join(F.broadcast(repeated), ["sha1", "h"], "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = page.withColumn("salt", salt).join(salted, ["sha1", "h", "salt"], "left")
    older = F.coalesce(F.col("page_id") < F.col("last"), F.col("last").isNotNull())
    return joined.select("page_id", "url", "payload", "sha1", F.when(older, F.col("last")).alias("refers_to"))


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _member_of(page_id, url, payload: bytes, sha1: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id),
        "WARC-Target-URI": _uri(url), "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to),
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Payload-Digest": sha1_name(bytes.fromhex(sha1)),
        "WARC-Block-Digest": sha1_name(hashlib.sha1(block).digest()),
    }
    return member(head, block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = DATE) -> None:
    """A record per row of `pages`, in archives under `path`, each task its own.

    A null url leaves WARC-Target-URI out; control characters and blanks in it are escaped.
    """

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            out, size = [], 0
            for row in zip(*columns):
                # The sink's separator is the last byte.
                out.append(_member_of(*[v.as_py() for v in row], date)[:-1])
                size += len(out[-1])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = captures(pages, least).mapInArrow(run, "member binary")
    value = members.select(F.col("member").cast("string").alias("value"))
    value.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


READ = (
    "archive string, offset long, record_type string, record_id string, target_uri string, date string, "
    "refers_to string, payload_bytes long, payload_sha1 string, payload binary, error string"
)
_HEADS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to")


def read_archives(spark, path: str, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """A row for each record of the archives under `path`, each archive read by one task.

    Archives hold up to 2 GB as they are stored, which is what Spark reads as one value. A
    revisit has no payload of its own: its digest and length are those that its head states.
    A damaged record stops the job, or with on_error="row" is a row that has `error`.
    """
    names = [f.split()[0] for f in READ.split(", ")]
    schema = spark.createDataFrame([], READ).schema

    def row(archive: str, r: Record):
        if r.error and on_error == "raise":
            raise ValueError(f"{archive}, byte {r.offset}: {r.error}")
        return (archive, r.offset, *[r.head.get(h) for h in _HEADS], r.payload_bytes, r.payload_sha1, r.payload, r.error)

    def batch_of(rows):
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for r in records(content.as_py(), with_payload):
                    rows.append(row(archive.as_py(), r))
                    size += 400 + len(r.payload or b"")
                    if size >= BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def page_of(record_id) -> Column:
    """The page id in a record id; null where it has none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op12_warc(spark, folder):
    """All pages, written as archives and read back; a null html is an empty payload."""
    path = new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select(
        page_of("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"),
    )


OP12_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id < last THEN last END AS refers_to
FROM g
"""
