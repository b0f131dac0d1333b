"""WARC records in ZIP packages, read by byte ranges.

A package is a ZIP file with two stored members: the WARC file, each record a gzip member of
its own as the format recommends, and a line index of its records. A reader parses the end record, the ZIP64 records where present and
the central directory, finds where the members' bytes lie, and reads single records by
range; nothing is extracted. Packages are written by tasks to the shared folder; only the
packages listed in the manifest, which Spark commits, exist for readers.

Defined cases: a null payload is empty, a null address is left out of the record, a null id
is kept as null, an empty input gives no package, repeated rows give one record each.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm import store
from hazardframe.operators.common import materialise

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its WARC member has so many bytes.
PACKAGE_BYTES = 32 << 20
#: Payloads below this size are never stored as revisits.
REVISIT_MIN_BYTES = 100

MANIFEST = "package string, records long"
INDEX = "package string, record_at long, record_bytes long, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, declared_digest string, payload binary"


def classify(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, body, bytes, digest, first) - ``first`` is the page a revisit refers to, else null."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    first = rows.filter(F.col("bytes") >= REVISIT_MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(first.filter("n > 1").drop("n"), "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("first", F.when(~own, F.col("first")))


def _line(text: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, body: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; a revisit keeps the payload's digest and size but not its bytes."""
    kind = "response" if first is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    head += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    if first is None:
        block += body
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the digest is computed from the payload where the record has it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": None, "declared_digest": declared}
    if out["record_type"] == "revisit":
        return out | {"refers_to": int(fields["X-Refers-To-Page"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": declared, "payload": None}
    payload = block.partition(b"\r\n\r\n")[2]
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def write_package(out, records: Iterator[tuple[dict, bytes]], force_zip64: bool = False) -> int:
    """Write one package to a stream; returns the number of records."""
    n, at, index = 0, 0, io.StringIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(WARC_MEMBER, "w", force_zip64=force_zip64) as member:
            for entry, raw in records:
                member.write(raw)
                index.write(json.dumps(entry | {"offset": at, "length": len(raw)}) + "\n")
                at, n = at + len(raw), n + 1
        with z.open(INDEX_MEMBER, "w", force_zip64=force_zip64) as member:
            member.write(index.getvalue().encode())
    return n


def write_packages(classified: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row of ``classify`` as a record; returns the committed manifest."""
    store.make_folder(folder)

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        pending = next(rows, None)
        while pending is not None:
            name, size = store.new_name(folder, "package", ".zip"), 0

            def some():
                nonlocal pending, size
                while pending is not None and size < package_bytes:
                    r, raw = pending, record(pending["page_id"], pending["url"], pending["body"], pending["digest"], pending["first"])
                    raw = gzip.compress(raw, 6, mtime=0)
                    size += len(raw)
                    yield {"page_id": r["page_id"], "type": "response" if r["first"] is None else "revisit"}, raw
                    pending = next(rows, None)

            with store.open_output(name) as out:
                n = write_package(out, some())
            yield pa.RecordBatch.from_pydict({"package": [name], "records": [n]}, pa.schema([("package", pa.string()), ("records", pa.int64())]))

    return materialise(classified.select("page_id", "url", "body", "digest", "first").mapInArrow(run, MANIFEST), "packages")


def _extra64(extra: bytes, want: list[str]) -> dict:
    """The 64-bit values of the ZIP64 extra field, for the fields that are saturated."""
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        if kind == 1:
            return dict(zip(want, struct.unpack_from(f"<{size // 8}Q", extra, 4)))
        extra = extra[4 + size :]
    return {}


def members(source) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, size) of every stored member, from the central directory."""
    size = source.size()
    tail_at = max(0, size - (22 + 0xFFFF + 20))
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark may stand inside the comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, dir_size, dir_at = struct.unpack_from("<HLL", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        at64 = struct.unpack_from("<Q", tail, locator + 8)[0]
        head = source.read_at(56, at64)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        count, dir_size, dir_at = struct.unpack_from("<QQQ", head, 32)
    directory, found, at = source.read_at(dir_size, dir_at), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<LLHHH", directory, at + 20)
        local_at = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        wide = _extra64(extra, [k for k, v in (("full", full), ("packed", packed), ("at", local_at)) if v == 0xFFFFFFFF])
        packed, local_at = wide.get("packed", packed), wide.get("at", local_at)
        if method == 0:  # stored: its bytes can be addressed
            local = source.read_at(30, local_at)
            found[name] = (local_at + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_n + extra_n + comment_n
    return found


def list_records(packages: DataFrame) -> DataFrame:
    """One row per record of every package, with the byte range that holds it."""

    def run(batches):
        for b in batches:
            for name in b.column("package").to_pylist():
                with store.open_input(name) as f:
                    at = members(f)
                    base = at[WARC_MEMBER][0]
                    lines = [json.loads(x) for x in f.read_at(at[INDEX_MEMBER][1], at[INDEX_MEMBER][0]).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lines), pa.string()), pa.array([base + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64()), pa.array([x["page_id"] for x in lines], pa.int64()), pa.array([x["type"] for x in lines], pa.string())],
                    names=["package", "record_at", "record_bytes", "page_id", "record_type"],
                )

    return packages.select("package").mapInArrow(run, INDEX)


def read_records(records: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-read the listed records (any subset of ``list_records``)."""
    types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary())]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, rows = b.slice(i, 256).to_pydict(), []
                opened: dict = {}
                for name, at, size in zip(part["package"], part["record_at"], part["record_bytes"]):
                    if name not in opened:
                        opened[name] = store.open_input(name)
                    rows.append(parse_record(gzip.decompress(opened[name].read_at(size, at))))
                for f in opened.values():
                    f.close()
                if not payloads:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    return records.select("package", "record_at", "record_bytes").mapInArrow(run, RECORD)
