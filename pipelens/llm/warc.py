"""WARC archives: a writer, and a salvage reader that goes on after damage.

The writer makes archives of one gzip member per record. Of records with equal payloads of
at least MIN_REVISIT bytes the smallest page is the response and the others revisit it.
Each task writes files of its own name; the manifest that Spark commits says which count,
so a repeated or lost task leaves no record twice.

The reader takes members and plain records alike. A record must have a version line,
headers, its full length, the closing blank lines, and a payload that fits its digest (a
member also its CRC). Digests are checked in hex or base32 of the algorithms of DIGESTS;
a record with another digest is kept and noted as unchecked. After a failed check it
searches for the next gzip member or version line that passes all checks, goes on from
there, and logs the bytes between as a quarantined gap. The same search goes through the
bytes unpacked from a member, also from one that is cut or damaged further on; its rows
have the member's place, and the reason of a gap within it says which unpacked bytes. In
such a member a record is taken only if another one follows it, and where the member is
damaged, not only cut, only if its digest was checked.

Defined results: a null html is the empty payload; a null url is empty; rows with the
smallest page id of their payload are responses, also where that row is repeated; a null
page id is the largest id and can only be a revisit or alone; other columns are ignored;
an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 32 << 20
#: Bytes given to the unpacker at a time; what it does not use is copied, so they are few.
CHUNK = 1 << 15

#: Bytes of a file name or a comment in the header of a member, at most.
NAME = 1 << 16

#: Digests that are checked, by the name in the header.
DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512}

_VERSION = b"WARC/1.1\r\n"
_GZIP = b"\x1f\x8b\x08"
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_HEADLINE = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD = re.compile(rb"WARC/1\.[01]\r?\n((?:[^\r\n:]+:[^\r\n]*\r?\n(?:[ \t][^\r\n]*\r?\n)*)*)\r?\n")
_URN = "urn:page:"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, revisit: bool) -> bytes:
    """One record, not yet compressed; a revisit has no payload of its own."""
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        head.insert(2, ("WARC-Refers-To", f"<{_URN}{refers_to}>"))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and the place after it; ValueError if any check fails."""
    head = _HEAD.match(data, at)
    if not head:
        raise ValueError("no version line and headers")
    fields = {}
    # Lines may end in a line feed alone, and one that begins with white space goes on with the one before.
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head[1].decode("utf-8", "replace")))[:-1]:
        key, _, value = line.partition(":")
        fields[key.lower()] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        raise ValueError("no content length")
    end = head.end() + int(length)
    if end > len(data):
        raise ValueError("record is cut or its length is wrong")
    blank = next((x for x in (b"\r\n\r\n", b"\n\n") if data[end : end + len(x)] == x), None)
    fields["payload"] = data[head.end() : end]
    if fields.get("warc-type") != "revisit":
        _check_digest(fields)
    if blank is None:
        # Its payload fits its digest, so only the lines that close it are lost.
        if not fields.get("checked"):
            raise ValueError("record is cut or its length is wrong")
        fields["note"] = "closing lines are missing"
        blank = re.compile(rb"[\r\n]{0,3}").match(data, end)[0]
    return fields, end + len(blank)


def _check_digest(fields: dict) -> None:
    """ValueError if the payload does not fit its digest; a digest that can't be checked is noted."""
    if "warc-payload-digest" not in fields:
        return
    name, _, value = fields["warc-payload-digest"].partition(":")
    algorithm = DIGESTS.get(name.strip().lower().replace("-", ""))
    if algorithm is None:
        fields["note"] = f"digest not checked: {name}"
        return
    # A payload digest of HTTP is of the entity, the block without its HTTP header.
    block = fields["payload"]
    bodies = [block]
    if re.match(r"application/http\b", fields.get("content-type", "")) and b"\r\n\r\n" in block:
        bodies.append(block.split(b"\r\n\r\n", 1)[1])
    found = [algorithm(b).digest() for b in bodies]
    if not any(value.strip().lower() in (d.hex(), base64.b32encode(d).decode().lower(), base64.b32encode(d).decode().rstrip("=").lower()) for d in found):
        raise ValueError("payload does not fit its digest")
    fields["checked"] = True


def _member_header(data: bytes, at: int) -> int:
    """The place after the header of the member at ``at``; ValueError if it is none, so that chance finds of its first bytes cost little."""
    if len(data) < at + 10 or data[at : at + 3] != _GZIP or data[at + 3] & 0xE0:
        raise ValueError("no header of a member")
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            end = data.find(b"\0", end, end + NAME) + 1
            if not end:
                raise ValueError("no end of a name in the header of a member")
    return end + (2 if flags & 2 else 0)


def unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the member that begins at ``at``, as far as they unpack, the place after it, and what is wrong with it."""
    unpacker, parts, end, size = zlib.decompressobj(31), [], at, max(64, _member_header(data, at) - at)
    while not unpacker.eof and end < len(data):
        chunk = memoryview(data)[end : end + size]
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(chunk))
        except zlib.error as e:
            # The bytes before the damage: halves of what is left of the chunk, as long as they unpack.
            good, step = 0, len(chunk)
            while step > 1:
                step = (step + 1) // 2
                trial = before.copy()
                try:
                    parts.append(trial.decompress(chunk[good : good + step]))
                except zlib.error:
                    continue
                before, good = trial, good + step
            return b"".join(parts), end + good, f"member: {e}"
        end += len(chunk)
        size = min(CHUNK, 4 * size)
    if not unpacker.eof:
        return b"".join(parts), end, "member is cut"
    return b"".join(parts), end - len(unpacker.unused_data), ""


def _plain(data: bytes):
    """('record', start, end, fields) and ('gap', start, end, reason) over unpacked bytes, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            record, end = parse_record(data, at)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            found = _HEADLINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, record
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def parse_at(data: bytes, at: int) -> tuple[list[tuple[str, dict | str]], int, str]:
    """The records and gaps of the member, or the plain record, that begins at ``at``, the place after it, and what is wrong with the member.

    ValueError if there is no sound record.
    """
    if data[at : at + 3] != _GZIP:
        record, end = parse_record(data, at)
        return [("record", record)], end, ""
    plain, end, wrong = unpack(data, at)
    found = []
    for kind, start, stop, what in _plain(plain):
        # A digest that fits speaks for itself; a record without one is taken from a cut member if another one follows.
        if kind == "record" and wrong and not what.get("checked") and not (wrong == "member is cut" and _HEADLINE.match(plain, stop)):
            kind, what = "gap", "record without a checked digest at the end of a cut member or in a damaged one"
        found.append((kind, what if kind == "record" else f"{what} (unpacked bytes {start} to {stop})"))
    if wrong and len(found) > 1 and found[-1][0] == "gap":
        found.pop()  # what is wrong with the member covers what follows its last record
    if not any(kind == "record" for kind, _ in found) and (found or wrong):
        raise ValueError(wrong or found[0][1].rpartition(" (")[0])
    return found, end, wrong


def salvage(data: bytes):
    """('record', start, end, fields) and ('gap', start, end, reason) over a whole archive, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found, end, wrong = parse_at(data, at)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            near = _CANDIDATE.search(data, at + 1)
            at = near.start() if near else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        if wrong:
            # Sound members may begin before the place where the damage showed.
            near = _CANDIDATE.search(data, at + 1)
            while near and not _sound(data, near.start(), found):
                near = _CANDIDATE.search(data, near.start() + 1)
            end = near.start() if near else len(data)
        for kind, what in found:
            yield kind, at, end, what
        if wrong:
            yield "gap", at, end, wrong
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _sound(data: bytes, at: int, known: list) -> bool:
    """Whether a member or record begins here that is not one of ``known``; packed bytes can hold records as they are."""
    try:
        return any(x[0] == "record" and x not in known for x in parse_at(data, at)[0])
    except ValueError:
        return False


def _write(folder: str, archive_bytes: int):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        rows, out, size, name = [], None, 0, ""
        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _member(record_bytes(page_id, url, (html or "").encode(), refers_to, digest, revisit))
                out.write(data)
                size += len(data)
                n += 1
                if size >= archive_bytes:
                    out.close()
                    rows.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            rows.append((name, n, size))
        yield pa.record_batch({"name": pa.array([r[0] for r in rows], pa.string()), "records": pa.array([r[1] for r in rows], pa.int64()), "bytes": pa.array([r[2] for r in rows], pa.int64())})

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) of each row. Payload groups are summed before they are shuffled; a hot payload's rows can be split by the join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    groups = (
        rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("group"), "first")
    )
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, F.col("digest") == F.col("group"), "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages under ``folder``, which driver and executors share, and the manifest of those that count."""
    common.ship_package(pages.sparkSession)
    store, root = fs.FileSystem.from_uri(f"{folder}/archives" if ":" in folder else f"file://{folder}/archives")
    store.create_dir(root, recursive=True)
    uri = f"{folder}/archives" if ":" in folder else f"file://{folder}/archives"
    plan_records(pages).mapInArrow(_write(uri, archive_bytes), "name string, records long, bytes long").write.parquet(f"{folder}/manifest")


def _read(batches, payloads: bool = True):
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            name = path.rsplit("/", 1)[-1]
            rows = {c: [] for c in _READ_TYPES}
            size = 0
            for kind, start, end, what in salvage(data):
                record = what if kind == "record" else {}
                page = re.fullmatch(rf"<{_URN}(-?[0-9]+)>", record.get("warc-record-id", ""))
                refers = re.fullmatch(rf"<{_URN}(-?[0-9]+)>", record.get("warc-refers-to", ""))
                payload = record.get("payload")
                for value, values in zip(
                    (
                        kind, name, start, end, what if kind == "gap" else record.get("note"), record.get("warc-type"), int(page[1]) if page else None, int(refers[1]) if refers else None,
                        record.get("warc-target-uri"), record.get("warc-payload-digest", "").removeprefix("sha256:") or None, payload.decode("utf-8", "replace") if payloads and payload is not None else None,
                        None if payload is None or record.get("warc-type") == "revisit" else len(payload),
                        None if payload is None or record.get("warc-type") == "revisit" else hashlib.sha256(payload).hexdigest(),
                    ),
                    rows.values(),
                    strict=True,
                ):
                    values.append(value)
                size += len(payload or b"")
                if size > 8 << 20:
                    yield pa.record_batch({c: pa.array(v, _READ_TYPES[c]) for c, v in rows.items()})
                    rows, size = {c: [] for c in _READ_TYPES}, 0
            yield pa.record_batch({c: pa.array(v, _READ_TYPES[c]) for c, v in rows.items()})


_READ_TYPES = {
    "kind": pa.string(), "archive": pa.string(), "start": pa.int64(), "end": pa.int64(), "reason": pa.string(), "record_type": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(),
    "url": pa.string(), "header_digest": pa.string(), "payload": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
}
_READ_SCHEMA = "kind string, archive string, start long, end long, reason string, record_type string, page_id long, refers_to long, url string, header_digest string, payload string, payload_bytes long, payload_digest string"


def read_archives(spark, folder: str, names: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Rows of kind 'record' and 'gap' of all archives under ``folder``; ``names`` limits them to a manifest's; without ``payloads`` their digests and lengths alone come back."""
    common.ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(f"{folder}/archives").select("path", "content")
    if names is not None:
        files = files.join(names.select("name"), F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")
    return files.mapInArrow(lambda batches: _read(batches, payloads), _READ_SCHEMA)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's query: all pages are written, read back, and revisits resolved through their responses."""
    folder = common.scratch(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), folder)
    read = read_archives(spark, folder, spark.read.parquet(f"{folder}/manifest"), payloads=False)
    read = common.written(read.select("kind", "archive", "start", "end", "reason", "page_id", "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest"), "warc-rows")
    gap = read.where("kind = 'gap'").first()
    if gap is not None:
        raise ValueError(f"{gap['archive']}: bytes {gap['start']} to {gap['end']} were lost: {gap['reason']}")
    rows = read.where("kind = 'record'")
    responses = (
        rows.where("record_type = 'response' and page_id is not null")
        .join(rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy("page_id", "payload_digest")
        .agg(F.max("payload_bytes").alias("original_bytes"))
        .select(F.col("page_id").alias("original"), F.col("payload_digest").alias("original_digest"), "original_bytes")
    )
    resolved = rows.join(responses, (F.col("refers_to") == F.col("original")) & (F.col("header_digest") == F.col("original_digest")), "left")
    return resolved.select(
        "page_id",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "original_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.first IS NULL OR g.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 100
"""
