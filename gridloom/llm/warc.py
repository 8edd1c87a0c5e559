"""Operator 8, WARC: write pages as archives of web records and read them back, salvaging what damage leaves.

Of records with equal payloads the one with the least id is a ``response``, the others are ``revisit`` records that
refer to it. The first of each payload is found from digests alone, with partial minima before the shuffle; pages
then meet their payload's first by one join on the digest, whose hot keys Spark splits at run time. Each task writes its
rows as archives of bounded size into the shared folder, one gzip member a record, and returns a manifest row for
each; names are new for each attempt, so a task that is run again leaves at worst a file that no manifest names.

The reader checks each member, version line, length and digest. When a check fails it looks for the next place where a
member or a version line starts and passes its checks, goes on from there, and logs the bytes in between as a
quarantined gap. Within a member of several records it looks for version lines in the same way; of a damaged member it keeps the
records with a digest that end before the last byte that the member still yields, so never its last one.

Defined cases: null html is an empty payload; a null page id is kept, and is the first of its payload only if no id is
given; rows that repeat the least id of a payload are responses all; a null url becomes an empty target; line ends
within a url are percent-encoded; an empty table gives an empty table; further columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import in_arrow, settled, shared_dir

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")


def digest(data: bytes) -> str:
    """Base32 SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def encode(page_id: int | None, url: str | None, payload: bytes, own: str, first: int | None, revisit: bool, date: str, level: int = 1) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {'' if first is None else first}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def payload(self) -> tuple[int, bytes]:
        """The full payload's length, and as much of it as the record holds."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return (int(length[1]) if length else len(body)), body


@dataclass
class Archive:
    records: list[Record] = field(default_factory=list)
    #: (start, end, reason) of quarantined bytes.
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _parse(data: bytes, pos: int, last_end: int) -> tuple[Record, int]:
    """The record at ``pos`` and where it ends; raises ValueError if it fails a check. Nothing but the record is copied.

    ``last_end`` is the place of the last end of headers in ``data``, so that none is looked for after it.
    """
    version = _VERSION.match(data, pos)
    if not version:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", pos) if pos <= last_end else -1
    if end < 0:
        raise ValueError("no end of headers")
    headers = {}
    for x in data[version.end() : end].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon:
            raise ValueError("bad header")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    n = int(headers["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) < n:
        raise ValueError("cut short")
    if (given := headers.get("warc-block-digest")) and given != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    end += 4 + n
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end of record")
    return Record(headers, block), end + 4


def _member(data: bytes, pos: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``pos`` holds, where it ends, and, if it is damaged, how; then the bytes are those before the damage."""
    reader, parts, at, step = zlib.decompressobj(31), [], pos, 16 << 10
    while not reader.eof and at < len(data):
        try:
            parts.append(reader.decompress(data[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(parts), at, f"bad member: {e}"
            # Once more to the start of this piece, and then byte by byte up to the damage.
            reader, step = zlib.decompressobj(31), 1
            parts = [reader.decompress(data[pos:at])]
            continue
        at = min(at + step, len(data))
    if not reader.eof:
        return b"".join(parts), at, "member cut short"
    return b"".join(parts), at - len(reader.unused_data), ""


def _within(inner: bytes, damaged: bool) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The records in a member's bytes that pass their checks, and the gaps between them."""
    found, gaps, at, gap, why = [], [], 0, None, ""
    last_end = inner.rfind(b"\r\n\r\n")
    while at < len(inner):
        try:
            record, end = _parse(inner, at, last_end)
            if damaged and (end == len(inner) or "warc-block-digest" not in record.headers):
                raise ValueError("not sure in a damaged member")
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = _VERSION.search(inner, at + 1)
            at = m.start() if m else len(inner)
            continue
        if gap is not None:
            gaps.append((gap, at, why))
            gap = None
        found.append(record)
        at = end
    if gap is not None:
        gaps.append((gap, len(inner), why))
    return found, gaps


def salvage(data: bytes) -> Archive:
    """Every record of an archive that passes its checks, and the gaps between them.

    A gap within a member has the member's place, and its own place among the member's bytes in its reason.
    """
    out, pos, gap, why = Archive(), 0, None, ""
    last_end = data.rfind(b"\r\n\r\n")
    while pos < len(data):
        found, gaps, damage = [], [], ""
        try:
            if data[pos : pos + 2] == b"\x1f\x8b":
                inner, end, damage = _member(data, pos)
                found, gaps = _within(inner, bool(damage))
                if not found and (damage or gaps):
                    raise ValueError(damage or gaps[0][2])
            else:
                record, end = _parse(data, pos, last_end)
                found = [record]
        except ValueError as e:
            if gap is None:
                gap, why = pos, str(e)
            m = _START.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if gap is not None:
            out.gaps.append((gap, pos, why))
            gap = None
        out.records += found
        if damage:  # where it ends is not known
            gap, why = pos, damage + "".join(f"; lost of its bytes: {a} to {b}" for a, b, _ in gaps)
            m = _START.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        out.gaps += [(pos, end, f"bytes {a} to {b} of the member: {x}") for a, b, x in gaps]
        pos = end
    if gap is not None:
        out.gaps.append((gap, len(data), why))
    return out


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes all pages; returns the manifest (path, records, bytes), settled in the shared folder."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first")).withColumnRenamed("sha", "_sha")
    told = rows.join(firsts, F.col("sha") == F.col("_sha")).select(
        "page_id", "url", "html", "sha", "first", (~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)).alias("revisit")
    )
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        stream, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, page, sha, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = encode(page_id, url, page.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), first, revisit, date)
                if stream is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream, n, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                stream.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    stream.close()
                    done.append((f"{folder}/{name}", n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", n, size))
        paths, ns, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return settled(in_arrow(told, run, "path string, records long, bytes long"))


_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, gap_start long, gap_end long, gap_reason string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record that passes its checks, and one with ``gap_start`` and ``gap_end`` for each quarantined gap.

    Each task reads the archives of its manifest rows, one at a time; an archive's size is bounded by its writer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in _SCHEMA.split(", ")])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as f:
                    archive = salvage(f.read())
                rows = []
                for r in archive.records:
                    h, (size, body) = r.headers, r.payload()
                    own = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if h.get("warc-type") == "response":
                        size, own = len(body), digest(body)
                    rows.append((number(h.get("x-page-id")), size, own, h.get("warc-type"), number(h.get("x-refers-to-page")), path, None, None, None))
                rows += [(None, None, None, None, None, path, *g) for g in archive.gaps]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return in_arrow(manifest.select("path"), run, _SCHEMA)


def warc_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every page as its archived record tells it."""
    rows = read_archives(write_archives(pages, min_bytes)).filter(F.col("gap_start").isNull())
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
