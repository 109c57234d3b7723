"""WARC archives: a writer with revisit records and a salvage reader.

Writing. A payload's SHA-256 names it. Of the records with equal payloads of at least MIN_REVISIT
bytes, the one with the smallest page_id is a `response`, the others are `revisit` records that
refer to it and carry only their HTTP head. The smallest page_id per digest is an aggregation
combined before its shuffle; what joins back on the digest is ids and digests only, and the payloads
move once, by page_id, so a payload that a third of all pages share makes no hot task. Each record
is one gzip member; members are packed into archives of about ARCHIVE_BYTES, each a file of its own,
which Spark's committer writes under a task attempt's name and moves into place, through the Hadoop
file system of the path. An archive ends with an empty gzip member, whose last byte is what that writer
puts after a row, so the files hold gzip members and nothing else; once all are there, they are renamed to `.warc.gz`.

Reading. An archive is taken record by record. A record counts if its member inflates, its version
line, headers (folded ones too) and Content-Length hold, and its block and payload digests match:
MD5, SHA-1 and SHA-2, in hexadecimal or base 32. A digest that can't be checked (another algorithm, a
truncated or segmented payload) doesn't fail a record but is named in `unchecked`. The payload is the
entity after the HTTP head in an application/http block, and the whole block otherwise. After a
failed check the reader searches from the next byte on for a gzip member or a version line that
starts a valid record, goes on there, and reports the bytes passed over as a quarantined gap.

Archives of up to WHOLE_BYTES are rows of Spark's binaryFile source. Larger ones are read in pieces by a
task, as long as the store can be opened from Python too (local and shared folders, and what
pyarrow.fs knows); its memory is that of a record, of at most MAX_RECORD bytes.

Defined results: a null html is an empty payload; a null url has no WARC-Target-URI; a null page_id
is never referred to and always a response; repeated rows are repeated records, all response if
theirs is the smallest page_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
WHOLE_BYTES = 256 << 20
MAX_RECORD = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 15
READ_PIECE = 4 << 20
MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes.
EMPTY_MEMBER = MAGIC + b"\0" * 6 + b"\x03" + b"\x03\0" + b"\0" * 8
PADDING = re.compile(rb"\0+")
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/(?:0\.1[78]|1\.[01])\r\n")
LONGEST_START = 11
ALGORITHMS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}
CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")


class Record(NamedTuple):
    """A record that passed all checks; length is that in the archive.

    payload_bytes is None if a revisit doesn't tell it. payload_digest is the SHA-256 in hexadecimal, of a revisit what
    its header says (with the algorithm's name if that is another). unchecked names digests that couldn't be checked.
    """

    offset: int
    length: int
    kind: str
    record_id: str
    refers_to: str | None
    uri: str | None
    payload: bytes
    payload_bytes: int | None
    payload_digest: str
    unchecked: str | None = None


class Gap(NamedTuple):
    """Quarantined bytes and what was wrong with their first record."""

    offset: int
    length: int
    reason: str


class Bad(ValueError):
    pass


class Short(Bad):
    """The bytes end before the record does."""


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def page_of(name: str | None) -> int | None:
    tail = (name or "").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def build(page_id: int | None, uri: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; payload is left out if it refers to another."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def digest_matches(label: str, content: bytes) -> bool | None:
    """Whether `algorithm:value` is the digest of the content; None if the algorithm is unknown."""
    name, _, value = label.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ALGORITHMS:
        return None
    raw = hashlib.new(name, content).digest()
    value = value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the uncompressed record at `at`; Bad if a check fails, Short if bytes are missing."""
    if not (m := VERSION.match(data, at)):
        raise (Short if len(data) - at < LONGEST_START else Bad)("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Short("headers have no end")
    headers: dict[str, str] = {}
    name = None
    for line in data[m.end() : end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header line has no colon")
        name = key.strip().lower().decode("latin-1")
        headers[name] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise Bad("no Content-Length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if len(data) < stop + 4:
        raise Short("the block doesn't end at Content-Length")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("the block doesn't end at Content-Length")
    block = data[start:stop]
    if (want := headers.get("warc-block-digest")) and digest_matches(want, block) is False:
        raise Bad("block digest")
    return headers, block, stop + 4


def unchunked(body: bytes) -> bytes | None:
    """The entity of a body in chunked transfer coding; None if it isn't one."""
    parts, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(parts)
        at = m.end() + size
        if body[at : at + 2] != b"\r\n":
            return None
        parts.append(body[m.end() : at])
        at += 2
    return None


def finish(offset: int, length: int, headers: dict[str, str], block: bytes) -> Record:
    """The record of a block; Bad if its payload digest fails."""
    kind, label = headers.get("warc-type", ""), headers.get("warc-payload-digest", "")
    http = headers.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    notes = [f"block digest {want}" for want in [headers.get("warc-block-digest")] if want and digest_matches(want, b"") is None]
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})", head)
        payload, size, digest = b"", int(m[1]) if m else None, label
        if label.lower().replace("-", "").startswith("sha256:") and len(value := label.partition(":")[2].strip()) in (52, 56, 64):
            digest = value.lower() if len(value) == 64 else base64.b32decode(value.upper().rstrip("=") + "====").hex()
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        same = digest_matches(label, payload) if label else True
        if same is False and http and re.search(rb"(?i)\r\ntransfer-encoding: *chunked", head):
            same = (entity := unchunked(payload)) is not None and digest_matches(label, entity)
        partial = headers.keys() & {"warc-truncated", "warc-segment-number"}
        if same is False and not partial:
            raise Bad("payload digest")
        if not same:
            notes.append(f"payload digest {label}")
    name = lambda k: headers[k].strip("<>") if k in headers else None
    return Record(offset, length, kind, name("warc-record-id") or "", name("warc-refers-to"), headers.get("warc-target-uri"), payload, size, digest, ", ".join(notes) or None)


def take(data: bytes, at: int, base: int = 0) -> tuple[list[Record | Gap], int]:
    """The valid record, in a gzip member or plain, at `at`, and the end of its bytes; Bad or Short if there is none.

    A member of more than one record gives all that are valid, and its gaps, each at the whole member's place;
    a member of no bytes gives none. base: the place of data in its archive.
    """
    if data.startswith(MAGIC, at):
        z, parts, fed, view = zlib.decompressobj(31), [], at, memoryview(data)
        try:
            while not z.eof and fed < len(data):
                parts.append(z.decompress(view[fed : fed + PIECE]))
                fed = min(fed + PIECE, len(data))
        except zlib.error as e:
            raise Bad(f"member: {e}") from None
        if not z.eof:
            raise Short("the member has no end")
        plain = b"".join(parts)
        stop = fed - len(z.unused_data)
        if not plain:
            return [], stop
        try:
            headers, block, end = parse_record(plain)
            if end == len(plain):
                return [finish(base + at, stop - at, headers, block)], stop
            reason = "a member of more than one record"
        except Bad as e:
            reason = str(e)
        found = [x._replace(offset=base + at, length=stop - at) for x in salvage(plain)]
        if not any(isinstance(x, Record) for x in found):
            raise Bad(reason)
        return found, stop
    headers, block, end = parse_record(data, at)
    return [finish(base + at, end - at, headers, block)], end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive in order, and a gap for each stretch of other bytes."""
    return salvage_stream(io.BytesIO(data).read, max(1, len(data)))


def salvage_stream(read: Callable[[int], bytes], piece: int = READ_PIECE) -> Iterator[Record | Gap]:
    """`salvage` of what read(n) gives piece by piece; b"" is the end. What is held is one record, or a piece."""
    data, base, at, done = b"", 0, 0, False  # data begins at `base` of the archive; `at` counts within data
    lost, reason = None, ""

    def more() -> bool:
        nonlocal data, base, at, done
        if done:
            return False
        new = read(max(piece, len(data) - at))  # twice as much each time a record doesn't fit
        done = not new
        data, base, at = data[at:] + new, base + at, 0
        return bool(new)

    while at < len(data) or more():
        if lost is None and (pad := PADDING.match(data, at)):
            at = pad.end()
            continue
        try:
            found, end = take(data, at, base)
        except Bad as e:
            if isinstance(e, Short) and len(data) - at < MAX_RECORD and more():
                continue
            if lost is None:
                lost, reason = base + at, str(e)
            at += 1
            while not (m := STARTS.search(data, at)):
                at = max(at, len(data) - LONGEST_START + 1)  # a start may go on in the next piece
                if not more():
                    at = len(data)
                    break
            else:
                at = m.start()
            continue
        if lost is not None:
            yield Gap(lost, base + at - lost, reason)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield Gap(lost, base + at - lost, reason)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null if it refers to another), size, digest, refers_to."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    ids = p.where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    again = ids.join(spread(firsts), "digest").where("page_id > refers_to").distinct()
    out = p.join(again, ["page_id", "digest"], "left")
    return out.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select("page_id", "url", "payload", "size", "digest", "refers_to")


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> None:
    """Write the pages as WARC archives `part-*.warc.gz` below path."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, EMPTY_MEMBER[:-1]])], pa.binary())], ["archive"])

        for b in batches:
            for page, url, payload, n, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                held.append(member(build(page, url, payload or b"", n, digest, refers)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    packed = plan_records(pages, min_revisit).mapInArrow(pack, "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.endswith(".txt") and f.getLen() == 0:
            fs.delete(f.getPath(), False)
        elif name.endswith(".txt") and not fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(at, name[:-4] + ".warc.gz")):
            raise OSError(f"could not rename {name}")


FIELDS = "archive string, offset long, length long, kind string, page_id long, refers_to long, record_id string, uri string, payload binary, payload_bytes long, payload_digest string, unchecked string, reason string"


def _rows(payloads: bool) -> Callable[[str, Iterator[Record | Gap]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in FIELDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    def run(name: str, found: Iterator[Record | Gap]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for x in found:
            if isinstance(x, Gap):
                rows.append((name, x.offset, x.length, "gap", *[None] * 8, x.reason))
            else:
                rows.append((name, x.offset, x.length, x.kind, page_of(x.record_id), page_of(x.refers_to), x.record_id, x.uri, x.payload if payloads else None, x.payload_bytes, x.payload_digest, x.unchecked, None))
                size += len(x.payload)
            if size > ARCHIVE_BYTES or len(rows) >= 5000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """All records below path and, with kind 'gap', the quarantined stretches. page_id and refers_to are those of this module's own names."""
    rows = _rows(payloads)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from rows(b.column(0)[i].as_py(), salvage(b.column(1)[i].as_py()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with store.open_input_stream(at, compression=None) as f:
                    yield from rows(name, salvage_stream(f.read))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > whole_bytes).select("path")
    small = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(whole, FIELDS)
    if large.isEmpty():
        return small
    return small.unionByName(large.mapInArrow(pieces, FIELDS))


def round_trip(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A gap in an archive just written is an error.
    """
    at = f"{ws.path}/archives"
    write(pages, at)
    records = read(pages.sparkSession, at, payloads=False)
    kind = F.when(F.col("kind") == "gap", F.raise_error(F.concat(F.lit("a gap in "), "archive", F.lit(": "), "reason"))).otherwise(F.col("kind"))
    return records.select("page_id", "payload_bytes", "payload_digest", kind.cast("string").alias("record_type"), "refers_to")


#: The round trip's rows, from the pages alone.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, CASE WHEN strlen(h) >= {MIN_REVISIT} AND page_id > min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM q
"""
