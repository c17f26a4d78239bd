"""Web archives: one gzip member per record, and a sequential reader that checks them.

The writer stores a payload once, as a response; further records with the same payload are
revisits that name it. The reader inflates a member piece by piece, frames blocks by their
content length and recomputes the digests, so a record of any size needs little memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import stored, text_of
from folioscan.sources.shared import new_folder

CHUNK = 1 << 16
HEADER_LIMIT = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_digest(hashed) -> str:
    return base64.b32encode(hashed.digest()).decode()


def record(
    kind: str, record_id: str, uri: str | None, date: str, payload: bytes,
    refers_to: str | None = None, level: int = 3,
) -> bytes:
    """One gzip member: the record's header, its HTTP head and, unless a revisit, its payload."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{base32_digest(hashlib.sha1(payload))}"),
        ("WARC-Block-Digest", f"sha1:{base32_digest(hashlib.sha1(block))}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


@dataclass
class Record:
    """What the reader found; `problem` says why a record must not be trusted."""

    fields: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None
    problem: str | None = None


class _Parts:
    """Consumes one member's bytes: record header, block of stated length, closing blank lines."""

    def __init__(self, keep: bool):
        self.record = Record(payload=b"" if keep else None)
        self._head = bytearray()
        self._http: bytearray | None = bytearray()
        self._left: int | None = None
        self._tail = b""
        self._block, self._payload = hashlib.sha1(), hashlib.sha1()
        self._kept: list[bytes] = []

    def feed(self, data: bytes) -> None:
        if self._left is None:
            self._head += data
            end = self._head.find(b"\r\n\r\n")
            if end < 0:
                if len(self._head) > HEADER_LIMIT:
                    raise ValueError("header too long")
                return
            data = bytes(self._head[end + 4:])
            self.record.fields = _fields(bytes(self._head[:end]), b"WARC/")
            self._left = int(self.record.fields["content-length"])
        block, rest = data[:self._left], data[self._left:]
        self._left -= len(block)
        self._block.update(block)
        if self._http is None:
            self._pay(block)
        else:
            self._http += block
            end = self._http.find(b"\r\n\r\n")
            if end >= 0:
                body = bytes(self._http[end + 4:])
                self._stated = _fields(bytes(self._http[:end]), b"HTTP/").get("content-length")
                self._http = None
                self._pay(body)
        self._tail += rest
        if len(self._tail) > 4:
            raise ValueError("bytes after the block")

    def _pay(self, data: bytes) -> None:
        self._payload.update(data)
        self.record.payload_bytes += len(data)
        if self.record.payload is not None:
            self._kept.append(data)

    def close(self) -> Record:
        done = self.record
        if self._left is None or self._left or self._tail != b"\r\n\r\n" or self._http is not None:
            raise ValueError("record ends early")
        stated = done.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        done.payload_digest = base32_digest(self._payload)
        if done.fields.get("warc-block-digest") != f"sha1:{base32_digest(self._block)}":
            done.problem = "block digest"
        elif done.fields["warc-type"] == "revisit":
            # The payload is elsewhere; the record states its size and digest.
            done.payload_bytes, done.payload_digest = int(self._stated), stated
        elif stated != done.payload_digest or int(self._stated) != done.payload_bytes:
            done.problem = "payload digest"
        if done.payload is not None:
            done.payload = b"".join(self._kept)
        return done


def _fields(head: bytes, version: bytes) -> dict[str, str]:
    first, *lines = head.split(b"\r\n")
    if not first.startswith(version):
        raise ValueError("no version line")
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order; a damaged member ends it with a problem record."""
    data = b""
    while data or (data := stream.read(CHUNK)):
        inflate, parts = zlib.decompressobj(31), _Parts(keep_payload)
        try:
            while not inflate.eof:
                if not data and not (data := stream.read(CHUNK)):
                    raise ValueError("member ends early")
                parts.feed(inflate.decompress(data, CHUNK))
                data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            yield parts.close()
        except (ValueError, KeyError, zlib.error) as fault:
            parts.record.problem = str(fault) or type(fault).__name__
            yield parts.record
            return  # where the next member starts is not known


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Each page as response or revisit: page, row_no, url, body, first_page, first_row.

    Of equal payloads of at least `min_bytes`, the one with the smallest id (nulls last,
    then the first row) is the response; the first_ columns of the others name it.
    """
    kept = pages.select(
        F.col(id_col).alias("page"), F.monotonically_increasing_id().alias("row_no"),
        F.col(url_col).alias("url"), text_of(body_col).alias("body"),
    ).withColumns({
        "digest": F.unhex(F.sha1(F.encode("body", "UTF-8"))), "size": F.octet_length("body"),
    })
    # Reduced to one row per payload before the shuffle; only repeated payloads come back.
    first = (
        kept.filter(F.col("size") >= min_bytes).groupBy("digest", "size")
        .agg(F.min(F.struct(F.col("page").isNull(), "page", "row_no")).alias("first"),
             F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "size", "first")
    )
    repeats = F.col("first.row_no") != F.col("row_no")
    return kept.join(first, ["digest", "size"], "left").select(
        "page", "row_no", "url", "body",
        F.when(repeats, F.col("first.page")).alias("first_page"),
        F.when(repeats, F.col("first.row_no")).alias("first_row"),
    )


def write_archives(
    planned: DataFrame, folder: str, max_bytes: int = 128 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the planned records as .warc.gz files below `folder`; returns path, n_records.

    Every task opens files of its own and starts another at `max_bytes`. The names are
    unique, so an attempt that is repeated leaves files that the returned table never names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, written, count = None, "", 0, 0
        made: list[tuple[str, int]] = []
        for batch in batches:
            for page, row, url, body, first_page, first_row in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, written, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                again = first_row is not None
                member = record(
                    "revisit" if again else "response", _record_id(page, row), url, date,
                    body.encode(), _record_id(first_page, first_row) if again else None,
                )
                out.write(member)
                written += len(member)
                count += 1
                if written >= max_bytes:
                    out.close()
                    made.append((path, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count))
        paths, counts = [m[0] for m in made], [m[1] for m in made]
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64())],
            names=["path", "n_records"],
        )

    return planned.mapInArrow(run, "path string, n_records bigint")


def _record_id(page: int | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives named in `path`, each archive read in sequence by one task.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, problem (null for
    a record whose framing and digests hold).
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    page = re.compile(r"<urn:page:(-?\d*):\d+>")

    def number(text: str | None) -> int | None:
        match = page.fullmatch(text or "")
        return int(match[1]) if match and match[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows(path: str) -> Iterator[tuple]:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None) as stream:
                for r in read_records(stream):
                    get = r.fields.get
                    yield (number(get("warc-record-id")), r.payload_bytes, r.payload_digest,
                           get("warc-type"), number(get("warc-refers-to")), r.problem)

        def packed(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        found: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    found.append(row)
                    if len(found) == 8192:
                        yield packed(found)
                        found = []
        yield packed(found)

    # Paths are tiny, so adaptive plans would put all archives into one task.
    tasks = max(1, archives.count())
    return archives.select("path").repartition(tasks).mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
             "refers_to bigint, problem string")


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write archives of the pages into the shared folder and read them back.

    A row per page; an empty table gives no archive and no row. A null body is an empty
    payload, a null id stays null. Raises if a record comes back damaged.
    """
    folder = new_folder(pages.sparkSession, "warc")
    archives = stored(write_archives(plan_records(pages, **columns), folder), "warc-list")
    return read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(
            F.raise_error(F.concat(F.lit("damaged record: "), "problem"))
        ).alias("record_type"),
        "refers_to",
    )
