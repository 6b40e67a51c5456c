"""WARC archives: one gzip member per record, written and read in parallel.

Writing goes through Spark's own file committer, so a retried task or a lost
executor leaves no half archive, on any file system that Spark writes: each
record is compressed to one gzip member, and the members are the "lines" of a
text sink.  The sink must end every line with a separator; a member's last
byte is the high byte of its length, zero below 16 MiB, so that byte is the
separator (a longer record is followed by an empty gzip member, which ends in
a zero too, and which readers skip).  Archives hold nothing but gzip members.

Reading is sequential inside an archive: compressed bytes are fed to zlib in
small windows, one member after the other; the record's header gives its
content length, and the payload and block digests are verified while it
streams.  A damaged member yields a row with ``error`` and ends its archive.

Records with equal payloads of ``min_revisit`` bytes or more are stored once:
the one with the smallest id is the response, the others revisit it.

Cases: a null payload is empty; null ids are written as such and order last;
repeated rows (same id, same payload) are responses together if theirs is the
smallest id; an empty table writes no records and reads back none; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangoflow.session import scratch_path

ID_PREFIX = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
FEED = 1 << 16


def digest(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 20 bits, four letters at a time."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
            min_revisit: int = 0) -> DataFrame:
    """id, url, payload (null for revisits), payload_bytes, payload_digest,
    refers_to.  Only ids, lengths and digests are aggregated (partially before
    the shuffle); digests that occur once are not joined at all."""
    c = F.col
    p = pages.select(c(key).alias("id"), c(url).alias("url"),
                     F.coalesce(c(payload), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.length("payload").cast("long").alias("payload_bytes"), digest(c("payload")).alias("payload_digest"))
    first = (p.where(c("payload_bytes") >= min_revisit).groupBy("payload_digest", "payload_bytes")
             .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    j = p.join(first, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(c("first").isNotNull() & ~c("id").eqNullSafe(c("first")), c("first"))
    return j.select("id", "url", F.when(refers.isNull(), c("payload")).alias("payload"), "payload_bytes",
                    "payload_digest", refers.alias("refers_to"))


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value) -> str:
    return " ".join(str(value).split()) if value is not None else ""


def member(ident, url, payload: bytes | None, size: int, digest_: str, refers_to) -> bytes:
    """One record as a gzip member (with an empty one behind it if its last
    byte is not zero)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID_PREFIX}{'' if ident is None else ident}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest_}", f"WARC-Block-Digest: sha1:{_b32(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_warc(recs: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Write records (see ``records``) as gzip archives under ``path``.  The
    records of a file are bounded, since a reader holds a whole archive."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                m = member(*[col[i].as_py() for col in cols])
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1]], pa.binary())], names=["m"])

    packed = recs.select("id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "m binary")
    (packed.select(F.col("m").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path))


class _Members:
    """The uncompressed bytes of an archive's members, a window at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    def next(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if self.at >= len(self.data):
                raise ValueError("truncated gzip member")
            fed = self.data[self.at:self.at + FEED]
            out = z.decompress(fed)
            self.at += len(fed) - len(z.unused_data)
            if out:
                yield out


class _Stream:
    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, bytearray()

    def more(self) -> bool:
        x = next(self.chunks, None)
        if x is not None:
            self.held += x
        return x is not None

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end of the member."""
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("header without end")
                return None
        out = bytes(self.held[:i + len(mark)])
        del self.held[:i + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("record shorter than its Content-Length")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            yield out


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _ident(value: str | None) -> str | None:
    text = (value or "").strip("<>").removeprefix(ID_PREFIX)
    return text or None


def parse(data: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive, one after the other."""
    members = _Members(data)
    while members.at < len(members.data):
        try:
            stream = _Stream(members.next())
            head = stream.until(b"\r\n\r\n")
            if head is None:
                continue  # an empty member
            f = _fields(head)
            if not head.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            left = int(f["content-length"])
            block, body, start, http, size = hashlib.sha1(), hashlib.sha1(), b"", None, 0
            kept = []
            for chunk in stream.take(left):
                block.update(chunk)
                if http is None:
                    start += chunk
                    end = start.find(b"\r\n\r\n")
                    if end < 0:
                        continue
                    http, chunk = _fields(start[:end + 4]), start[end + 4:]
                body.update(chunk)
                size += len(chunk)
                if payloads:
                    kept.append(chunk)
            if stream.until(b"\r\n\r\n") != b"\r\n\r\n" or stream.held or stream.more():
                raise ValueError("record longer than its Content-Length")
            b32 = lambda h: base64.b32encode(h.digest()).decode()
            said = f.get("warc-payload-digest", "").removeprefix("sha1:")
            full = int((http or {}).get("content-length", size))
            revisit = f.get("warc-type") == "revisit"
            good = b32(block) == f.get("warc-block-digest", "sha1:" + b32(block)).removeprefix("sha1:")
            good = good and (revisit or (said in ("", b32(body)) and full == size))
            yield {"id": _ident(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": f.get("warc-type"),
                   "refers_to": _ident(f.get("warc-refers-to")), "payload_bytes": full,
                   "payload_digest": said or b32(body), "verified": good, "error": None,
                   "payload": b"".join(kept) if payloads and not revisit else None}
        except (ValueError, KeyError, zlib.error) as e:
            yield {"id": None, "url": None, "record_type": None, "refers_to": None, "payload_bytes": None,
                   "payload_digest": None, "verified": False, "error": f"{type(e).__name__}: {e}"[:200], "payload": None}
            return


READ = ("id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
        "verified boolean, error string, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True, names: str = "*") -> DataFrame:
    """All records of the files under ``path`` whose names match the glob
    ``names``, verified; ids as the archives have them."""
    schema = pa.schema([("id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("verified", pa.bool_()), ("error", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for r in parse(data.as_py(), payloads):
                    held.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("content")
    return files.mapInArrow(run, READ)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
            min_revisit: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(records(pages, key, url, payload, min_revisit), path)
    return read_warc(pages.sparkSession, path, payloads=False)
