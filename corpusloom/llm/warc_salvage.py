"""WARC archives as tables of bytes: a deduplicating writer and a salvage reader.

Archives are rows of ``archive, bytes``: each task writes its records as gzip members, and ends an
archive when it is large enough. Rows reach any store that Spark reaches; archives that exist as
files are read with :func:`archive_files`. The reader checks the gzip member, the version line, the
length and the block digest of each record. After a failed check inside a member it carries on at the
next version line of the inflated bytes; of a broken member it reads the bytes before the break and
takes the records whose block digests hold. Their heads have no check of their own, so they are not
certain, and are marked. After that, and outside of members, it searches for the next gzip member that
starts a record, or the next version line, carries on there, and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Compressed bytes after which a task ends an archive.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_STEP = 1 << 16


def _digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def digest_holds(stated: str, block: bytes) -> bool:
    """Whether a block has the stated digest: any algorithm that the library knows, in base32 or hexadecimal of any case.

    A digest of an unknown algorithm says nothing, so it does not fail.
    """
    name, colon, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(name, block, usedforsecurity=False).digest()
    value = value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP head with the full payload's length and no body."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%-._~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: fields, block and where it ends; raises ValueError if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    fields = _fields(data[at:stop])
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record end is not where the length says")
    block = data[start:end]
    if not digest_holds(fields.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    return fields, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member at ``at``, where it ends, and why it is broken, if it is.

    A broken member gives the bytes before the break and how far it was read.
    """
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and pos < len(data):
            out.append(unpacker.decompress(data[pos : pos + _STEP]))
            pos += _STEP
    except zlib.error as e:
        return *_before_break(data, at, pos), f"broken member: {e}"
    plain = b"".join(out)
    if not unpacker.eof:
        return plain, len(data), "member without end"
    return plain, min(pos, len(data)) - len(unpacker.unused_data), ""


def _before_break(data: bytes, at: int, pos: int) -> tuple[bytes, int]:
    """What a member gives before it breaks in the step at ``pos``: an error drops the step's bytes, so they come one by one."""
    unpacker = zlib.decompressobj(31)
    out = [unpacker.decompress(data[k : min(k + _STEP, pos)]) for k in range(at, pos, _STEP)]
    try:
        while pos < len(data):
            out.append(unpacker.decompress(data[pos : pos + 1]))
            pos += 1
    except zlib.error:
        pass
    return b"".join(out), pos


def _member_records(plain: bytes, sure: bool) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The records in a member's bytes, and the first reason for bytes that are none. Unless ``sure``, a record must have a digest."""
    found, why, pos = [], "" if plain else "empty member", 0
    while pos < len(plain):
        try:
            fields, block, end = parse_record(plain, pos)
            if not sure and "warc-block-digest" not in fields:
                raise ValueError("no block digest in a broken member")
        except ValueError as e:
            why = why or str(e)
            line = _VERSION.search(plain, pos + 1)
            pos = line.start() if line else len(plain)
            continue
        found.append((fields, block))
        pos = end
    return found, why


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 512], 10)))
    except zlib.error:
        return False


def _next_start(data: bytes, at: int) -> int:
    """The next gzip member that begins with a version line, or the next bare version line."""
    line = _VERSION.search(data, at)
    stop = line.start() if line else len(data)
    pos = data.find(_MEMBER, at, stop + 2)
    while 0 <= pos < stop:
        if _starts_record(data, pos):
            return pos
        pos = data.find(_MEMBER, pos + 1, stop + 2)
    return stop


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, bytes, bool]]:
    """Events in order: ``("record", start, end, fields, block, certain)`` or ``("gap", start, end, reason, b"", True)``.

    Records and gaps cover all bytes; touching gaps are one gap with the first reason. A member with
    good and bad records, or one whose own check fails, is a gap, and its good records come before it
    with no bytes of their own. A record is not certain if its member's check fails: its block holds
    its digest, but what its head says may be damaged.
    """
    at, gap_at, why = 0, -1, ""
    seen, seen_to = [], 0
    while at < len(data):
        found, bad, end, certain = [], "", at, True
        if data.startswith(_MEMBER, at):
            plain, end, broken = inflate(data, at)
            # without an error the bytes before a lost end are sure
            certain = not broken.startswith("broken")
            found, bad = _member_records(plain, certain)
            if broken:
                # a member that is not compressed shows its records in the archive's bytes too
                seen, seen_to = found, end
                bad, end = broken, _next_start(data, at + 1)
        else:
            try:
                fields, block, end = parse_record(data, at)
                if at < seen_to and (fields, block) in seen:
                    raise ValueError("record of a broken member")
                found.append((fields, block))
            except ValueError as e:
                bad, end = str(e), _next_start(data, at + 1)
        if gap_at >= 0 and (found or not bad):
            yield "gap", gap_at, at, why, b"", True
            gap_at = -1
        for fields, block in found:
            yield "record", at, at if bad else end, fields, block, certain
        if bad and gap_at < 0:
            gap_at, why = at, bad
        at = end
    if gap_at >= 0:
        yield "gap", gap_at, len(data), why, b"", True


def mark_revisits(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload binary, payload_digest, refers_to``: one row for each input row.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is
    the response and the others refer to it. A null payload is empty. Rows without an id are
    responses; repeated rows with the smallest id are all responses. The smallest ids are partly
    aggregated before the shuffle, only for payloads that repeat, and joined back, so AQE can split
    a payload that many rows share.
    """
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    first = (
        pages.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("same"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    return pages.join(first, F.col("payload_digest") == F.col("same"), "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive string, bytes binary`` from the rows of :func:`mark_revisits`, stored in the shared folder.

    Null ids, addresses and payloads make records without them; repeated rows are records of their
    own; an empty table gives no archive. :func:`write_files` makes files of the rows.
    """
    import pyarrow as pa

    from .common import bounded_batches

    bounded_batches(pages.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("bytes", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, members, size = 0, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for record in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    members.append(member(record_bytes(*record)))
                    size += len(members[-1])
                    if size >= archive_bytes:
                        yield row()
                        number, members, size = number + 1, [], 0
        if members:
            yield row()

    return stored(pages.mapInArrow(run, "archive string, bytes binary"), "warc")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """``archive, path, size`` of ``.warc.gz`` files in a folder that all executors reach, one for each row of ``archive, bytes``.

    Each file is written under another name and then moved to its own, so a task that is run again
    leaves whole files with the same content. ``folder`` is an absolute path or any address that Arrow's
    file systems know. A null archive is an empty file; of archives of one name one stays; other columns,
    whatever their names, are not read; an empty table gives none. Files are written when the result is read.
    """
    import pyarrow as pa

    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64())])

    def run(batches):
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, path, hidden = data.as_py() or b"", f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden, compression=None) as out:
                    out.write(data)
                system.move(hidden, path)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(data)])], schema=schema)

    return archives.select("archive", "bytes").mapInArrow(run, "archive string, path string, size long")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives that exist as files (``.warc`` or ``.warc.gz``, below 2 GB each) as rows of ``archive, bytes``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("bytes"))


def read_archives(archives: DataFrame) -> DataFrame:
    """All records and gaps of archives, in one pass.

    ``archive, kind ('record' or 'gap'), start_byte, end_byte, reason, record_type, page_id, url,
    payload_digest, refers_to, payload_bytes, payload, certain``. A gap has only the first five; a record
    that is not ``certain`` comes from a member whose own check fails. A revisit's
    ``payload_bytes`` and ``payload_digest`` are those of the full payload; its ``payload`` is empty.
    A null or empty archive gives no rows.
    """
    page = re.compile(r"<urn:page:(-?\d+)>")
    length = re.compile(rb"(?im)^content-length:\s*(\d+)")

    def number(value: str) -> int | None:
        found = page.fullmatch(value)
        return int(found[1]) if found else None

    def make():
        def work(archive, data):
            for kind, start, end, what, block, certain in salvage(data or b""):
                if kind == "gap":
                    yield (archive, kind, start, end, what, None, None, None, None, None, None, None, None)
                    continue
                head, _, body = block.partition(b"\r\n\r\n")
                found = length.search(head)
                record_type = what.get("warc-type")
                revisit = record_type == "revisit"
                yield (
                    archive, kind, start, end, None, record_type, number(what.get("warc-record-id", "")), what.get("warc-target-uri"),
                    what.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest(),
                    number(what.get("warc-refers-to", "")), int(found[1]) if revisit and found else len(body), body, certain,
                )

        return work

    return map_rows(
        archives.select("archive", "bytes"),
        "archive string, kind string, start_byte long, end_byte long, reason string, record_type string, page_id long, url string, payload_digest string, refers_to long, payload_bytes long, payload binary, certain boolean",
        make,
    )
