"""WARC records in ZIP packages: written with stored members and an index, read by ranges without extraction.

A package holds ``archive/data.warc`` and ``indexes/index.cdxj`` (sorted by SURT key), both stored.  Packages are kept as a table
of blocks (package, size, block, bytes), since Spark has no writer of raw files; ``blocks_of`` cuts the files that
``spark.read.format("binaryFile")`` gives into the same form.  The reader asks for byte ranges only: the tail with the end record
(and the ZIP64 one), the central directory, the members' local headers and the indexes, and then the range of each record.  Where
the blocks of a package of at most ``HELD_BYTES`` follow each other in a task, as they are written, its ranges are cut there, and no
block is shuffled.  Of larger packages, and of those that lie otherwise, a range is joined with just the blocks that it touches, so
neither such a package nor a member of it is ever put together.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import measured, stored

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdxj"
#: A package is closed when its records reach this size; it is kept in blocks of that one.
PACKAGE_BYTES, BLOCK_BYTES = 4 << 20, 128 << 10
#: Packages of up to this size are read where they lie.
HELD_BYTES = 16 << 20
#: Ranges, or payloads that stand several times, that may be broadcast: about 100 bytes each.  More are joined by a shuffle, hot
#: payloads dealt over so many parts.
BROADCAST_ROWS, SALTS = 50_000, 64
#: Fixed values of the ZIP format: signatures, the mark of a size that a ZIP64 field holds, and that field's tag.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16, TAG64 = 0xFFFFFFFF, 0xFFFF, 1
#: The end record with the longest comment, the ZIP64 locator and the ZIP64 end record.
TAIL_BYTES = 22 + FULL16 + 20 + 56


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(page_id, url: str | None, payload_bytes: int, digest: str, payload: bytes | None, refers_to) -> bytes:
    """A response record, or, without a payload, a revisit record, whose HTTP head still names the payload's length."""
    kind = "response" if payload is not None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(members: dict[str, bytes], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ``zip64`` all sizes and offsets stand in ZIP64 fields."""
    out, directory = bytearray(), bytearray()
    for name, data in members.items():
        at, crc, raw = len(out), zlib.crc32(data), name.encode()
        big = zip64 or max(len(data), at) >= FULL32
        size = FULL32 if big else len(data)
        extra = struct.pack("<HHQQ", TAG64, 16, len(data), len(data)) if big else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", TAG64, 24, len(data), len(data), at) if big else b""
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if big else at) + raw + extra
    start, n = len(out), len(members)
    out += directory
    if zip64 or start + len(directory) >= FULL32:
        end = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), start) + LOCATOR64 + struct.pack("<IQI", 0, end, 1)
        out += END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), start, 0)
    return bytes(out)


def surt(url: str) -> str:
    """Sort-friendly form of a URL: the host's parts reversed, then port, path and query; white space as %20."""
    try:
        at = urlsplit(url)
        host, port = at.hostname or "", f":{at.port}" if at.port else ""
    except ValueError:  # no URL that can be taken apart
        return "%20".join(url.split())
    rest = (at.path or "/") + (f"?{at.query}" if at.query else "")
    return "%20".join((",".join(reversed(host.split("."))) + port + ")" + rest if host else url).split())


def _writer(zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, index, size, closed, part = [], [], 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            whole = package({WARC_MEMBER: b"".join(records), INDEX_MEMBER: "".join(sorted(index)).encode()}, zip64)
            records.clear()
            index.clear()
            blocks = [whole[i : i + BLOCK_BYTES] for i in range(0, len(whole), BLOCK_BYTES)]
            n = len(blocks)
            columns = [pa.array([f"{part:06d}-{closed:06d}.wacz"] * n), pa.array([len(whole)] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(blocks, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["package", "size", "block", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                kept = None if row["refers_to"] is not None else row["payload"]
                data = record(row["page_id"], row["url"], row["payload_bytes"], digest, kept, row["refers_to"])
                place = {"url": row["url"] or "", "digest": f"sha1:{digest}", "offset": size, "length": len(data), "filename": WARC_MEMBER}
                index.append(f"{surt(row['url'] or '')} 19700101000000 {json.dumps(place)}\n")
                records.append(data)
                size += len(data)
                if size >= PACKAGE_BYTES:
                    yield close()
                    size, closed = 0, closed + 1
        if records:
            yield close()

    return run


def write_packages(pages: DataFrame, least_revisit_bytes: int = 0, zip64: bool = False, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table (package, size, block, bytes) of ZIP packages with one record per page.

    Of the pages with equal payloads of at least ``least_revisit_bytes``, the one with the smallest id is a response and the
    others revisit it; smaller payloads are all responses.  Null html: an empty payload.  Null or odd URLs are kept as they are.
    Rows that repeat the smallest id are all responses; a page without an id revisits if a page with one has its payload, else
    it is a response.  An empty table gives no packages; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_bytes") >= least_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first, small = measured(first.where("n > 1 and first is not null").drop("n"), "repeated", broadcast_rows)
    if small:  # payloads stay where they are
        rows = rows.join(first, "sha1", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", salt).join(dealt, ["sha1", "salt"], "left")
    rows = rows.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return rows.select("page_id", "url", "payload", "sha1", "payload_bytes", "refers_to").mapInArrow(_writer(zip64), "package string, size long, block long, bytes binary")


def blocks_of(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The blocks (package, size, block, bytes) of files with a path and a binary content; null content: no blocks."""
    size = F.octet_length(content_col).cast("long")
    rows = files.where(size > 0).select(F.col(path_col).alias("package"), size.alias("size"), F.col(content_col).alias("_content"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK_BYTES))))
    return rows.select("package", "size", "block", F.substring("_content", (F.col("block") * BLOCK_BYTES + 1).cast("int"), F.lit(BLOCK_BYTES)).alias("bytes"))


# Reading


def fetch(blocks: DataFrame, ranges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ranges`` (package, at, n above 0, and others) with ``pieces``: their bytes in order, from the blocks that they touch."""
    first, last = F.floor(F.col("at") / BLOCK_BYTES), F.floor((F.col("at") + F.col("n") - 1) / BLOCK_BYTES)
    own = ranges.columns
    touched = ranges.withColumn("_blocks", last - first + 1).withColumn("block", F.explode(F.sequence(first, last)))
    touched, _ = measured(touched, "ranges", broadcast_rows)
    begin = F.col("block") * BLOCK_BYTES
    start, stop = F.greatest(F.col("at") - begin, F.lit(0)), F.least(F.col("at") + F.col("n") - begin, F.lit(BLOCK_BYTES))
    piece = F.substring("bytes", (start + 1).cast("int"), (stop - start).cast("int"))
    parts = blocks.select("package", "block", "bytes").join(touched, ["package", "block"]).select(*own, "_blocks", "block", piece.alias("piece"))
    whole = parts.where("_blocks = 1").select(*own, F.array("piece").alias("pieces"))
    several = parts.where("_blocks > 1").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"))
    return whole.union(several.select(*own, F.col("p.piece").alias("pieces")))


def end_record(tail: bytes, size: int) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory, from the last bytes of a package of ``size`` bytes."""
    end, tail_at = tail.rfind(END), size - len(tail)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if FULL16 == n or FULL32 in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0] - tail_at
        if at < 0 or tail[at : at + 4] != END64:
            raise ValueError("ZIP64 end record is missing")
        n, length, start = struct.unpack("<QQQ", tail[at + 32 : at + 56])
    return start, length, n


def directory(block: bytes) -> list[tuple[str, int, int, int]]:
    """(name, offset of its local header, stored bytes, method) of each entry of a central directory."""
    at, out = 0, []
    while at < len(block):
        if block[at : at + 4] != CENTRAL:
            raise ValueError("central directory is broken")
        method = struct.unpack("<H", block[at + 10 : at + 12])[0]
        packed, full = struct.unpack("<II", block[at + 20 : at + 28])
        names, extras, comment = struct.unpack("<HHH", block[at + 28 : at + 34])
        header = struct.unpack("<I", block[at + 42 : at + 46])[0]
        name = block[at + 46 : at + 46 + names].decode()
        extra, e = block[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            tag, length = struct.unpack("<HH", extra[e : e + 4])
            if tag == TAG64:
                fields = iter(struct.unpack(f"<{length // 8}Q", extra[e + 4 : e + 4 + length // 8 * 8]))
                full = next(fields) if full == FULL32 else full
                packed = next(fields) if packed == FULL32 else packed
                header = next(fields) if header == FULL32 else header
            e += 4 + length
        out.append((name, header, packed, method))
        at += 46 + names + extras + comment
    return out


def data_offset(local: bytes) -> int:
    """Where a member's data begins after the start of its local header, which has its own name and extra lengths."""
    if local[:4] != LOCAL:
        raise ValueError("local header is broken")
    names, extras = struct.unpack("<HH", local[26:30])
    return 30 + names + extras


def _mapped(parse, schema: str):
    """A kernel that calls ``parse(row with its bytes)`` for every fetched range and puts out the rows (tuples) that it gives."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in parse(row, b"".join(row.pop("pieces")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    return run


def _places(row: dict, tail: bytes) -> Iterator[tuple]:
    start, length, n = end_record(tail, row["size"])
    if n:
        yield row["package"], row["size"], start, length


def _members(row: dict, block: bytes) -> Iterator[tuple]:
    for name, header, size, method in directory(block):
        if method:
            raise ValueError(f"{name} is compressed; records can only be read by range from stored members")
        # An index is read with its header; of an archive the header alone.
        slack = len(name.encode()) + FULL16
        yield row["package"], name, size, header, min(30 + slack + size, row["size"] - header) if name.startswith("indexes/") else 30


def _entries(row: dict, data: bytes) -> Iterator[tuple]:
    begin = data_offset(data)
    if not row["name"].startswith("indexes/"):
        yield row["package"], row["name"], row["at"] + begin, None, None
        return
    for line in data[begin : begin + row["held"]].decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])  # SURT key, timestamp, JSON
        yield row["package"], entry["filename"], None, entry["offset"], entry["length"]


def record_ranges(blocks: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """package, at, n: the byte range of every record that the indexes of the packages name."""
    tail_at = F.greatest(F.col("size") - TAIL_BYTES, F.lit(0))
    ends = blocks.where(F.col("block") == 0).select("package", "size", tail_at.alias("at"), (F.col("size") - tail_at).alias("n"))
    schema = "package string, size long, at long, n long"
    found = fetch(blocks, ends, broadcast_rows).select("package", "size", "pieces").mapInArrow(_mapped(_places, schema), schema)
    schema = "package string, name string, held long, at long, n long"
    found = fetch(blocks, found, broadcast_rows).select("package", "size", "pieces").mapInArrow(_mapped(_members, schema), schema)
    schema = "package string, name string, base long, offset long, length long"
    found = fetch(blocks, found, broadcast_rows).select("package", "name", "held", "at", "pieces").mapInArrow(_mapped(_entries, schema), schema)
    found = stored(found, "index")
    base = found.where("base is not null").select("package", "name", "base")
    places = found.where("offset is not null").drop("base").join(base, ["package", "name"])
    return places.select("package", (F.col("base") + F.col("offset")).alias("at"), F.col("length").alias("n"))


def parsed(data: bytes) -> tuple[str, str, int, str, str | None, bytes | None]:
    """record type, page id, payload length, payload digest, id referred to, payload; a response's digest is verified."""
    cut = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:cut].decode().split("\r\n")[1:])
    block = data[cut + 4 : cut + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Record-ID"][len("<urn:page:") : -1]
    if head["WARC-Type"] == "response":
        if len(payload) != length or base32_sha1(payload) != digest:
            raise ValueError(f"payload of page {page} does not fit its length and digest")
        return "response", page, length, digest, None, payload
    return head["WARC-Type"], page, length, digest, head["WARC-Refers-To"][len("<urn:page:") : -1], None


def records_within(package: str, whole: bytes) -> Iterator[bytes]:
    """The records that the indexes of a package name, by the same steps as ``record_ranges``."""
    size = len(whole)
    for _, _, start, length in _places({"package": package, "size": size}, whole[-TAIL_BYTES:]):
        members = list(_members({"package": package, "size": size}, whole[start : start + length]))
        found = [e for _, name, held, at, n in members for e in _entries({"package": package, "name": name, "held": held, "at": at}, whole[at : at + n])]
        bases = {name: base for _, name, base, _, _ in found if base is not None}
        for _, name, base, offset, length in found:
            if base is None and name in bases:
                yield whole[bases[name] + offset : bases[name] + offset + length]


RECORD = "page string, payload_bytes long, payload_digest string, record_type string, refers string"
BLOCK = "package string, size long, block long, bytes binary"


def _record_rows(payloads: bool):
    def run(data: bytes) -> tuple:
        kind, page, size, digest, refers, payload = parsed(data)
        return (page, size, digest, kind, refers, payload) if payloads else (page, size, digest, kind, refers)

    return run


def _in_place(payloads: bool):
    """A kernel that puts out the records of packages whose blocks follow each other, and all other blocks as they are."""
    row_of, width = _record_rows(payloads), 5 + payloads
    names = [c.split()[0] for c in f"{RECORD}{', payload binary' * payloads}, {BLOCK}".split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payloads, pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple], first: int) -> pa.RecordBatch:
        """Rows of columns from the ``first`` on; the others are null."""
        columns = list(zip(*rows))
        arrays = [pa.array(columns[i - first], t) if first <= i < first + len(columns) else pa.nulls(len(rows), t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # blocks 0, 1, ... of one package
        for batch in batches:
            for package, size, block, data in zip(*(batch.column(c) for c in ("package", "size", "block", "bytes"))):
                row = (package.as_py(), size.as_py(), block.as_py(), data.as_py())
                if held and (row[:2] != held[0][:2] or row[2] != len(held)):
                    yield batch_of(held, width)
                    held = []
                if not held and row[2]:
                    yield batch_of([row], width)
                    continue
                held.append(row)
                if (row[2] + 1) * BLOCK_BYTES >= row[1]:
                    if rows := [row_of(data) for data in records_within(row[0], b"".join(r[3] for r in held))]:
                        yield batch_of(rows, 0)
                    held = []
        if held:
            yield batch_of(held, width)

    return run


def read_packages(blocks: DataFrame, id_type: str = "long", payloads: bool = False, broadcast_rows: int = BROADCAST_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    payload_digest is bare base32 SHA-1; a revisit has the length and digest of the payload it refers to, and no payload.  An
    empty id reads as null.  A broken package raises ValueError.  An empty table gives no rows; other columns are not read.
    Packages of up to ``held_bytes`` are read where their blocks lie together; the result is the same in any order of the blocks.
    """
    schema = RECORD + ", payload binary" * payloads
    own = [c.split()[0] for c in schema.split(", ")]
    blocks = blocks.select("package", "size", "block", "bytes")
    read = stored(blocks.where(F.col("size") <= held_bytes).mapInArrow(_in_place(payloads), f"{schema}, {BLOCK}"), "records")
    found = read.where("package is null").select(*own)
    rest = blocks.where(F.col("size") > held_bytes).union(read.where("package is not null").select(*blocks.columns))
    if not rest.isEmpty():
        row_of = _record_rows(payloads)
        ranged = fetch(rest, record_ranges(rest, broadcast_rows), broadcast_rows).select("pieces").mapInArrow(_mapped(lambda _, data: [row_of(data)], schema), schema)
        found = found.union(stored(ranged, "ranged"))
    return found.select(_id("page", id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _id("refers", id_type).alias("refers_to"), *["payload"] * payloads)


def _id(column: str, kind: str) -> Column:
    return F.when(F.col(column) != "", F.col(column)).cast(kind)


def archive_and_read(pages: DataFrame, least_revisit_bytes: int = 0, zip64: bool = False, payloads: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes the pages' packages to the shared folder and reads their records back, one row per page as of ``read_packages``.

    Every revisit must find the response that it names, with the length and digest that were computed from its bytes; else
    ValueError.  Null html or URL, repeated rows and an empty table: as of ``write_packages``.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    blocks = stored(write_packages(pages, least_revisit_bytes, zip64, broadcast_rows=broadcast_rows), "packages")
    found = read_packages(blocks, kind, payloads, broadcast_rows)
    named = ["page_id", "payload_bytes", "payload_digest"]
    responses = found.where("record_type = 'response'").select(*named)
    revisits = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *named[1:]).distinct()
    if not revisits.join(responses, named, "left_anti").isEmpty():
        raise ValueError("a revisit names a response that the packages do not hold")
    return found
