"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

Every record is a gzip member of its own.  The reader checks each member and record
(checksum, version line, lengths, digests).  Where a check fails it searches for the
next place at which a member opens and begins with a version line, or, in plain
bytes, for the next version line, goes on from there, and logs the bytes between as
a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import shared_files
from storyloom.llm.common import frames, octets, stored

#: Bytes after which a task begins a new archive.
ROLL = 16 << 20
#: Archives that a task reads.
FILES = 8
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as plain bytes; a revisit keeps the headers of the answer, not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(key)}",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Archives of all rows in a fresh shared folder; returns their names, records and bytes.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    smallest key is the response and the others revisit it; rows that repeat that
    key are responses too, and where no row of a payload has a key, all are.  A
    null payload is empty, a null address is left out.  Only files named in the
    result count: a task run again writes files of its own.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("_k"), F.col(url).cast("string").alias("_u"), octets(payload).alias("_p"))
    rows = rows.withColumn("_h", F.sha1("_p"))
    shared = rows.where(F.length("_p") >= least).groupBy("_h").agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(shared.select("_h", "_first"), "_h", "left").select("_k", "_u", "_p", "_first")
    folder = shared_files.new_folder(pages.sparkSession, "warc")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, size, records, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", [], 0, 0, 0

        def close():
            name = f"part-{task}-{n:05d}.warc.gz"
            return pd.DataFrame([(name, records, shared_files.write(folder, name, held))], columns=["file", "records", "bytes"])
        for batch in batches:
            for k, u, p, first in zip(batch["_k"], batch["_u"], batch["_p"], batch["_first"]):
                k, first = (None if pd.isna(x) else x for x in (k, first))
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(k, u, p, first, first is not None and first != k)) + packer.flush()
                held.append(data)
                size, records = size + len(data), records + 1
                if size >= ROLL:
                    yield close()
                    held, size, records, n = [], 0, 0, n + 1
        if held:
            yield close()
    assert kind in ("bigint", "int", "string"), kind
    return stored(frames(rows, work, "file string, records long, bytes long"), "archives").withColumn("folder", F.lit(folder))


# ---------------------------------------------------------------------------------- reading


@dataclass
class Found:
    """A record (``reason`` is None) or a gap of ``length`` bytes at ``offset`` of the file."""
    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place of plain bytes; raises when a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[version.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start, size = end + 4, int(headers["content-length"])
    block = data[start:start + size]
    if len(block) < size or data[start + size:start + size + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        raise Damaged("block digest differs")
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != digest(payload_of(block)):
        raise Damaged("payload digest differs")
    return headers, block, start + size + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _plain(data: bytes, at: int, stop: int) -> Iterator[Found]:
    """Records and gaps of plain bytes up to a place."""
    while at < stop:
        try:
            headers, block, end = parse(data, at)
            yield Found(at, end - at, None, headers, block)
            at = end
        except Damaged as why:
            later = _VERSION.search(data, at + 1)
            end = min(later.start(), stop) if later else stop
            yield Found(at, end - at, str(why))
            at = end


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place; raises when it is damaged."""
    unpacker, parts, step = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and step < len(data):
            parts.append(unpacker.decompress(data[step:step + 65536]))
            step += 65536
    except zlib.error as why:
        raise Damaged(f"gzip: {why}") from None
    if not unpacker.eof:
        raise Damaged("gzip: member does not end")
    return b"".join(parts), min(step, len(data)) - len(unpacker.unused_data)


def _opens(data: memoryview, at: int) -> bool:
    """Whether a member begins here that holds a version line."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(data[at:at + 4096], 64)))
    except zlib.error:
        return False


def _next(raw: bytes, view: memoryview, at: int) -> int:
    """The next place where a member or a plain record begins, or the end."""
    plain = _VERSION.search(raw, at)
    plain = plain.start() if plain else len(raw)
    member = raw.find(_MEMBER, at)
    while 0 <= member < plain and not _opens(view, member):
        member = raw.find(_MEMBER, member + 1)
    return min(plain, member) if member >= 0 else plain


def salvage(raw: bytes) -> Iterator[Found]:
    """All records that pass their checks and all gaps, which together cover the file."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        if raw.startswith(_MEMBER, at):
            try:
                inner, end = _member(view, at)
            except Damaged as why:
                end = _next(raw, view, at + 1)
                yield Found(at, end - at, str(why))
                at = end
                continue
            for f in _plain(inner, 0, len(inner)):  # places inside a member are the member's own
                yield Found(at, end - at, f.reason and f"in member, {f.length} bytes at {f.offset}: {f.reason}", f.headers, f.block)
            at = end
            continue
        try:
            headers, block, end = parse(raw, at)
            yield Found(at, end - at, None, headers, block)
        except Damaged as why:
            end = _next(raw, view, at + 1)
            yield Found(at, end - at, str(why))
        at = end


_READ = ("file string, offset long, length long, gap string, key string, type string, uri string, payload_bytes long, "
         "payload_digest string, refers_to string")
_KEY = re.compile(r"<urn:page:(.*)>$")
_LENGTH = re.compile(rb"\r\n[Cc]ontent-[Ll]ength:\s*(\d+)")


def _row(file: str, f: Found) -> tuple:
    if f.reason is not None:
        return (file, f.offset, f.length, f.reason, None, None, None, None, None, None)
    h, body = f.headers, payload_of(f.block)
    key, refers = (_KEY.match(h.get(n, "")) for n in ("warc-record-id", "warc-refers-to"))
    if h.get("warc-type") == "revisit":
        size = _LENGTH.search(f.block)
        n, sha = int(size[1]) if size else None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        n, sha = len(body), digest(body)
    return (file, f.offset, f.length, None, key[1] if key else None, h.get("warc-type"), h.get("warc-target-uri"), n, sha, refers[1] if refers else None)


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of archives (columns folder, file), a row each; ``gap`` says what failed, null for records.

    A file is read whole by one task, so archives should be rolled as :func:`write`
    does.  Tasks are dealt by number of files, as the rows that name them say nothing
    of their size.  Headers that are not there are null; an empty file has no rows.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for folder, file in zip(rows["folder"], rows["file"]):
                system, path = fs.FileSystem.from_uri(folder)
                with system.open_input_stream(f"{path}/{file}") as f:
                    raw = f.read()
                found = list(salvage(raw))
                made = pd.DataFrame([_row(file, f) for f in found], columns=[c.split()[0] for c in _READ.split(", ")], dtype=object)
                if with_payload:
                    made["payload"] = [payload_of(f.block) if f.reason is None else None for f in found]
                yield made
    count = files.count()
    tasks = max(-(-count // FILES), min(count, files.sparkSession.sparkContext.defaultParallelism), 1)
    return frames(files.select("folder", "file").repartition(tasks, "file"), work, _READ + (", payload binary" if with_payload else ""))
