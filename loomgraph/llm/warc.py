"""WARC archives: revisit resolution, and writing deduplicated archives with fresh headers.

Records have record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, payload (a revisit's payload is null), and may have the columns
of OPTIONAL, which ``read_archives`` gives: a record of an archive that was read is written again with its own id, HTTP head, content type and other headers. Only
headers are shuffled, by payload digest: within a digest the earliest response (by date, then record id) is the original, every
other response becomes a revisit of it, and every revisit is joined to it. Payloads stay where they were
read: the changed headers come to them by record id (broadcast only if few), and each task writes
its own archive of separately compressed records with new record ids, lengths and digests.

Defined results: a revisit whose digest no response has, or that has no digest, is unresolved: it is written as a revisit that refers to what it did before, if to anything. A
response with a null payload has the digest of an empty one. Digests may be 40 hexadecimal digits, "sha1:" and base 32, or of another algorithm; the same digest in another form is the same.
Records of other types (warcinfo, request, metadata ...) are written as they are; a null type is "response". Rows whose record id is null are left out; of rows that share an id
the one with the lowest (date, URI, digest, type, URN) counts, nulls first. Of responses with equal digests and dates the one with the lowest id is the original. An empty table writes no archive and gives an empty result. Null URIs and dates are written as empty and
1970-01-01T00:00:00Z. Columns other than those named are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import BATCH_BYTES, key_join, map_arrow, qualified, shared_dir, written

MANIFEST = "record_id bigint, warc_type string, payload_digest string, refers_to bigint, payload_bytes bigint, archive string, record_offset bigint, record_length bigint"
EPOCH = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class WarcParams:
    """``archive_bytes``: an archive is closed once its compressed size reaches this."""

    archive_bytes: int = 1_000_000_000
    level: int = 6


def sha1_of(payload) -> F.Column:
    return F.sha1(F.coalesce(payload, F.lit(b"")))


def crawl_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Records as a crawler that drops identical payloads leaves them: the first page of a payload is a response, later ones
    are revisits without payload. The digest is hexadecimal SHA-1. The scan's payload column is kept unshuffled: who is first is decided on headers."""
    base = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("record_id"), F.col(uri_col).alias("target_uri"), F.col(body_col).cast("binary").alias("payload"))
    heads = base.select("record_id", sha1_of(F.col("payload")).alias("payload_digest"))
    later = written(heads.withColumn("first", F.min("record_id").over(W.partitionBy("payload_digest"))).where("record_id != first").select("record_id").distinct(), "warc-later")
    marked = key_join(base, later.withColumn("later", F.lit(True)), "record_id", "left")
    return marked.select(
        "record_id",
        F.when(F.col("later"), "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        F.date_format(F.timestamp_seconds(F.col("record_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        sha1_of(F.col("payload")).alias("payload_digest"),
        F.lit(None).cast("bigint").alias("refers_to"),
        F.when(F.col("later"), F.lit(None)).otherwise(F.coalesce("payload", F.lit(b""))).alias("payload"),
    )


#: Columns that records may have beside the seven: kept from an archive that was read, written again as they are.
OPTIONAL = {"record_urn": "string", "http_head": "binary", "content_type": "string", "extra_headers": "string", "refers_to_urn": "string", "refers_to_uri": "string", "refers_to_date": "string"}
_ALPHABETS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def same_digest(digest: F.Column) -> F.Column:
    """One form for each digest: SHA-1 as 40 hexadecimal digits, whether it comes so, with "sha1:" before it or in base 32; others with a lower-case algorithm; '' as null."""
    plain = F.regexp_replace(F.trim(digest), "^(?i)sha1:", "")
    digits = F.translate(F.upper(plain), *_ALPHABETS)
    from_base32 = F.concat(*[F.lpad(F.conv(F.substring(digits, i, 8), 32, 16), 10, "0") for i in (1, 9, 17, 25)])
    other = F.concat(F.lower(F.regexp_extract(digest, "^[^:]*", 0)), F.regexp_extract(digest, ":.*$", 0))
    out = F.when(plain.rlike("^[0-9a-fA-F]{40}$"), plain).when(plain.rlike("^[A-Za-z2-7]{32}$"), from_base32)
    return F.when(F.trim(digest) == "", None).otherwise(F.when(out.isNotNull(), F.lower(out)).otherwise(other))


def normal(records: DataFrame) -> DataFrame:
    """Records with an id, all optional columns, and the digest in one form; a response without one gets that of its payload."""
    digest = same_digest(F.col("payload_digest"))
    digest = F.when(F.col("warc_type") == "response", F.coalesce(digest, sha1_of(F.col("payload")))).otherwise(digest)
    more = [F.col(c).cast(t).alias(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()]
    kind = F.coalesce("warc_type", F.lit("response")).alias("warc_type")
    return records.where(F.col("record_id").isNotNull()).withColumn("warc_type", kind).select("record_id", "warc_type", "target_uri", "warc_date", digest.alias("payload_digest"), "payload", *more)


#: Of rows that share an id the first in this order counts, everywhere.
ORDER = ["warc_date", "target_uri", "payload_digest", "warc_type", "record_urn"]


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, refers_to_urn, refers_to_uri, refers_to_date, is_resolved): headers only.
    ``warc_type`` is the type that the deduplicated archive gives the record. What an unresolved revisit said that it refers to stays."""
    told = ["refers_to_urn", "refers_to_uri", "refers_to_date"]
    heads = normal(records).select("record_id", *ORDER, *told)
    one = heads.groupBy("record_id").agg(F.min(F.struct(*ORDER, *told)).alias("h")).select("record_id", "h.*")
    # the originals by digest: one aggregate with map-side combining, so a digest of thousands of revisits is no hot window
    first = one.where((F.col("warc_type") == "response") & F.col("payload_digest").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("warc_date", "record_id", "target_uri", "record_urn")).alias("o"))
    both = one.join(first, "payload_digest", "left")
    kept = F.col("warc_type").isin("response", "revisit")
    own = F.col("o.record_id") == F.col("record_id")
    refers = kept & F.col("o").isNotNull() & ~own
    revisit = F.col("warc_type") == "revisit"
    return both.select(
        "record_id",
        F.when(kept & F.col("o").isNotNull(), F.when(own, "response").otherwise("revisit")).otherwise(F.col("warc_type")).alias("warc_type"),
        "target_uri",
        "warc_date",
        "payload_digest",
        F.when(refers, F.col("o.record_id")).alias("refers_to"),
        *[F.when(refers, F.col(f"o.{c}")).when(revisit, F.col(a)).alias(a) for c, a in (("record_urn", "refers_to_urn"), ("target_uri", "refers_to_uri"), ("warc_date", "refers_to_date"))],
        F.coalesce(~revisit | F.col("o").isNotNull(), F.lit(False)).alias("is_resolved"),
    )


def digest_header(digest: str | None) -> str:
    """A digest as an archive has it: SHA-1 in base 32, from hexadecimal digits too; others as they are."""
    if digest and re.fullmatch("[0-9a-fA-F]{40}", digest):
        return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    return digest or ""


def urn(record_id: int) -> str:
    """A stable record id: the same record has the same one in any archive that refers to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record_id))}>"


def id_of(record_urn: str) -> int:
    """A number for a record of an archive that was read."""
    return int.from_bytes(hashlib.sha1(record_urn.encode()).digest()[:8], "big") >> 1


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(r: dict) -> bytes:
    """One record with fresh headers: lengths and digests are those of what is written. Only responses and revisits have an HTTP head, their own or else a plain one;
    the block of any other record is its payload."""
    kind, payload = r["warc_type"], r["payload"] or b""
    http = kind in ("response", "revisit")
    block = payload if kind != "revisit" else b""
    if http:
        head = r.get("http_head")
        if head is None:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
        block = head + block
    out = [("WARC-Type", kind), ("WARC-Record-ID", r.get("record_urn") or urn(r["record_id"])), ("WARC-Date", r["warc_date"] or EPOCH), ("WARC-Target-URI", _line(r["target_uri"])), ("WARC-Payload-Digest", digest_header(r["payload_digest"])), ("WARC-Block-Digest", digest_header(hashlib.sha1(block).hexdigest()))]
    if kind == "revisit":
        out.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if r.get("refers_to") is not None or r.get("refers_to_urn"):
            out += [("WARC-Refers-To", r.get("refers_to_urn") or urn(r["refers_to"])), ("WARC-Refers-To-Target-URI", _line(r.get("refers_to_uri"))), ("WARC-Refers-To-Date", r.get("refers_to_date") or EPOCH)]
    usual = "application/http; msgtype=response" if http else "application/http; msgtype=request" if kind == "request" else "application/warc-fields" if kind in ("warcinfo", "metadata") else "application/octet-stream"
    out += [("Content-Type", r.get("content_type") or usual), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in out if v) + (r.get("extra_headers") or "").encode() + b"\r\n" + block + b"\r\n\r\n"


class _Archive:
    """An archive under a name of its own; a failed attempt's leftovers are in no manifest."""

    def __init__(self, folder: str):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        self.uri = f"{folder}/{self.path.rsplit('/', 1)[1]}"
        self.out, self.at = self.files.open_output_stream(self.path, compression=None), 0

    def add(self, record: bytes, level: int) -> tuple[int, int]:
        packed = gzip.compress(record, level, mtime=0)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)


def write_archives(records: DataFrame, folder: str | None = None, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the deduplicated archives and return MANIFEST, one row for each record; it is written too, so reading it writes nothing again."""
    spark = records.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = qualified(spark, folder)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    heads = resolve(records)
    # most records are responses that stay as they are: only the headers of revisits are joined
    changed = heads.where("warc_type = 'revisit'").select("record_id", F.lit(True).alias("_revisit"), "refers_to", *[F.col(c).alias(f"_{c}") for c in ("refers_to_urn", "refers_to_uri", "refers_to_date")])
    changed = written(changed, "warc-changed")
    own = normal(records)
    repeated = written(own.groupBy("record_id").count().where("count > 1").select("record_id"), "warc-repeated")
    if not repeated.isEmpty():
        once = key_join(own, repeated, "record_id", "left_semi")
        lead = F.row_number().over(W.partitionBy("record_id").orderBy(*ORDER, sha1_of(F.col("payload"))))
        own = key_join(own, repeated, "record_id", "left_anti").unionByName(once.withColumn("_n", lead).where("_n = 1").drop("_n").select(own.columns))
    joined = key_join(own, changed, "record_id", "left")
    level, limit = params.level, params.archive_bytes

    def run(it: Iterator[pa.RecordBatch]):
        archive = None
        for b in it:
            rows = []
            for r in b.to_pylist():
                if r["_revisit"]:
                    r |= {"warc_type": "revisit"} | {c: r[f"_{c}"] for c in ("refers_to_urn", "refers_to_uri", "refers_to_date")}
                if archive is None or archive.at >= limit:
                    if archive:
                        archive.out.close()
                    archive = _Archive(folder)
                at, n = archive.add(record_bytes(r), level)
                rows.append((r["record_id"], r["warc_type"], r["payload_digest"], r["refers_to"], 0 if r["_revisit"] else len(r["payload"] or b""), archive.uri, at, n))
            if rows:
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in MANIFEST.split(", ")])
        if archive:
            archive.out.close()

    return written(map_arrow(joined, run, MANIFEST), "warc-manifest")


class _Members(io.RawIOBase):
    """What the members of a gzip file hold, one after the other, as a stream; ``starts`` has where each begins: (here, in the file)."""

    def __init__(self, file):
        self.file, self.at, self.position, self.data = file, 0, 0, b""
        self.inflate, self.out = zlib.decompressobj(31), b""
        self.starts: deque[tuple[int, int]] = deque([(0, 0)])

    def readable(self):
        return True

    def readinto(self, room):
        while not self.out:
            if self.inflate.eof:  # the next member begins where this one's data ends
                self.data = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
                self.starts.append((self.position, self.at - len(self.data)))
            if not self.data:
                self.data = self.file.read(1 << 18)
                self.at += len(self.data)
                if not self.data:
                    return 0
            self.out = self.inflate.decompress(self.data, 1 << 20)
            self.data = self.inflate.unconsumed_tail
        n = min(len(room), len(self.out))
        room[:n], self.out = self.out[:n], self.out[n:]
        self.position += n
        return n

    def offset(self, position: int) -> int:
        while len(self.starts) > 1 and self.starts[1][0] <= position:
            self.starts.popleft()
        return self.starts[0][1]


def parse(file) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """(offset, headers, block) of every record of an archive, read once from front to back; compressed record by record, as a whole, or not. ``offset`` is where
    the record's gzip member begins, or the record itself. What isn't a record, or is cut short, raises a ValueError."""
    first = file.read(2)
    file.seek(0)
    members = _Members(file) if first == b"\x1f\x8b" else None
    stream = io.BufferedReader(members, 1 << 18) if members else file
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {start}")
        head: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            at += len(line)
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and head:  # a folded line
                head[-1] = head[-1][0], head[-1][1] + " " + text.strip()
            else:
                name, _, value = text.partition(":")
                head.append((name.strip(), value.strip()))
        at += len(line)
        size = next((v for k, v in head if k.lower() == "content-length"), "")
        if not size.isdigit():
            raise ValueError(f"the record at {start} has no length")
        block = stream.read(int(size))
        at += len(block)
        if len(block) < int(size):
            raise ValueError(f"the record at {start} is cut short")
        yield members.offset(start) if members else start, head, block


#: Headers that are columns of their own or made afresh.
_OWN = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "warc-block-digest", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "content-type", "content-length"}
READ = "archive string, record_offset bigint, record_id bigint, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to bigint, payload binary, record_urn string, http_head binary, content_type string, extra_headers string, refers_to_urn string, refers_to_uri string, refers_to_date string"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _row(path: str, at: int, head: list[tuple[str, str]], block: bytes) -> tuple:
    h = {k.lower(): v for k, v in reversed(head)}
    kind, payload, http = h.get("warc-type"), block, None
    if kind in ("response", "revisit") and h.get("content-type", "").lower().startswith("application/http"):
        body, mark, rest = block.partition(b"\r\n\r\n")
        http, payload = body + mark, rest
    if kind == "revisit":
        payload = None
    extra = "".join(f"{k}: {v}\r\n" for k, v in head if k.lower() not in _OWN)
    name, other = h.get("warc-record-id", ""), h.get("warc-refers-to")
    return (path, at, id_of(name), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), id_of(other) if other else None, payload, name, http, h.get("content-type"), extra or None, other, h.get("warc-refers-to-target-uri"), h.get("warc-refers-to-date"))


def read_archives(spark, folder: str) -> DataFrame:
    """READ: every record of all archives of a folder, of any type, so that ``write_archives`` can write it again. ``record_id`` is a number made of the record's URN. A task streams
    one archive at a time and holds one batch of records; the payload of a revisit is null."""
    fields = [f.split() for f in READ.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(it):
        for b in it:
            for path in b.column("path").to_pylist():
                files, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                rows, held = [], 0
                with files.open_input_file(name) as file:
                    for at, head, block in parse(file):
                        rows.append(_row(path, at, head, block))
                        held += len(block)
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    n = max(1, min(paths.count(), 100_000))
    return map_arrow(paths.repartition(n, "path"), run, READ)
