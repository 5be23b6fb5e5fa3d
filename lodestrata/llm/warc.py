"""WARC archives: a writer with revisits and a reader that salvages damaged files.

The writer makes one gzip member per record and lets Spark's text sink put the
members into files, so that archives reach any file system that Spark writes to and
lost tasks are done again.  The sink ends each row with a separator of one byte;
that byte is 0x00, the last byte of a member of under 16 MB; a larger record is
followed by an empty member, which ends in 0x00 too.

The reader takes whole files, so the writer bounds them by bytes.  Plain and gzip
archives are told apart record by record.  Where a member's checksum or a version
line, header, length or digest fails, it searches for the next valid member or
version line, goes on there, and reports the bytes between as quarantined.  A member
may hold many records: a bad one doesn't take the others with it, and of a member
that can't be read to its end those records are kept whose digest proves them and
after which more was read.
Payload digests are those of the body where the block is an HTTP message, else of
the block.

Nulls in payloads count as empty; rows that repeat an id write records of their own,
rows without one too (they can be a response only if no row of their payload has an
id); empty tables write empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, scratch, spill

_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Base32 of SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member whose header doesn't depend on when it is made; it ends in 0x00."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    out = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return out if out.endswith(b"\x00") else out + _EMPTY_MEMBER


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has no block and says what its payload was."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p.as_buffer()) if p.is_valid else 0 for p in payloads], pa.int64()), pa.array([digest(p.as_buffer()) if p.is_valid else digest(b"") for p in payloads], pa.string())],
            names=["page_id", "payload_bytes", "payload_digest"],
        )


#: Bytes of members from which on they make a row of the text sink.
ROW_BYTES = 4 << 20


def _records(date: str, smallest: int):
    """For mapInArrow over (page_id, url, payload, first): rows of many members each, without the last one's last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            ids, urls, firsts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "first"))
            for i, payload in enumerate(batch.column(batch.schema.get_field_index("payload"))):
                data = (payload.as_py() if payload.is_valid else None) or b""
                revisit = firsts[i] is not None and firsts[i] != ids[i] and len(data) >= smallest
                out.append(member(record(ids[i], urls[i], data, firsts[i] if revisit else None, date, revisit)))
                held += len(out[-1])
                if held >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, smallest: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: datetime = datetime(2024, 1, 1, tzinfo=timezone.utc), bytes_per_file: int = 128 << 20) -> None:
    """Writes a folder of files of gzip members.

    Of rows with equal payloads of at least ``smallest`` bytes the one with the
    smallest id is a response, the others revisit it.  A file has at most about
    ``bytes_per_file`` bytes, unless a single record has more.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    seen = spill(pages.select("page_id", "payload").mapInArrow(_digests, "page_id long, payload_bytes long, payload_digest string"), "digests")
    eligible = seen.filter(F.col("payload_bytes") >= smallest)
    firsts = eligible.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("payload_digest", "first")
    # rows that revisit another; a row is known by its id, its payload's digest by its position in the join
    later = eligible.join(firsts, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "payload_digest", "first").distinct()
    later = spill(later, "revisits")
    size = (later.count()) * 96
    # SHA-1 of the payload, again, in the engine: the join then tells apart rows that share an id
    keyed = pages.withColumn("sha", F.sha1(F.coalesce("payload", F.lit(b""))))
    by_hex = later.mapInArrow(_hex, "id long, sha string, first long")
    joined = keyed.join(F.broadcast(by_hex) if size <= BROADCAST_BYTES else by_hex, F.col("page_id").eqNullSafe(F.col("id")) & (keyed["sha"] == by_hex["sha"]), "left")
    records = joined.select("page_id", "url", "payload", "first").mapInArrow(_records(date.strftime("%Y-%m-%dT%H:%M:%SZ"), smallest), "value binary")
    # the sink writes a string's bytes as they are
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", max(1, bytes_per_file // ROW_BYTES)).text(path)


def _hex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [base64.b32decode(d).hex() for d in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), batch.column(2)], names=["id", "sha", "first"])


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_HEADER_END = re.compile(rb"\r\n\r\n")
_MAGIC = b"\x1f\x8b\x08"


class Gap(Exception):
    """What stands here isn't a whole valid record."""


def _differs(said: str, data: bytes) -> bool:
    """Whether a SHA-1 digest, in base32 or hex, isn't that of data; other digests aren't tested."""
    kind, _, value = said.partition(":")
    return kind.lower() == "sha1" and value.upper() not in (digest(data), hashlib.sha1(data).hexdigest().upper())


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, bool]:
    """The payload in a record's block, and whether its digest is that of these bytes."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block, True
    head, _, body = block.partition(b"\r\n\r\n")
    return body, b"transfer-encoding:" not in head.lower()


def _parse(data: bytes | memoryview, at: int, proven: bool = False) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the plain record at a position; proven: only if a digest could be tested."""
    m = _VERSION.match(data, at)
    if not m:
        raise Gap("no version line")
    stop = _HEADER_END.search(data, m.end())  # a header can be of any length
    if not stop:
        raise Gap("no end of header")
    headers = {}
    for line in bytes(data[m.end() : stop.start()]).split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and headers:  # a folded line goes on with the last value
            last = next(reversed(headers))
            headers[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Gap("a header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Gap("no length")
    begin = stop.end()
    end = begin + int(length)
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Gap("the block doesn't end where it should")
    block = bytes(data[begin:end])
    of_block, of_payload = headers.get("warc-block-digest", ""), headers.get("warc-payload-digest", "")
    if _differs(of_block, block):
        raise Gap("the block's digest differs")
    payload, testable = payload_of(headers, block)
    testable &= headers.get("warc-type") != "revisit"  # a revisit's digest is that of what it refers to
    if testable and _differs(of_payload, payload):
        raise Gap("the payload's digest differs")
    if proven and not of_block.startswith("sha1:") and not (testable and of_payload.startswith("sha1:")):
        raise Gap("no digest proves it")
    return headers, payload, end + 4


def _split(content: bytes, proven: bool) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of the content of a gzip member, as salvage() has them."""
    at, bad, why = 0, None, ""
    while at < len(content):
        try:
            headers, payload, end = _parse(content, at, proven)
        except Gap as e:
            if bad is None:
                bad, why = at, str(e)
            m = _VERSION.search(content, at + 1)
            at = m.start() if m else len(content)
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        yield "record", at, end, (headers, payload)
        at = end
    if bad is not None:
        yield "gap", bad, len(content), why


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at a position, and what is wrong with it (its checksum and length are tested)."""
    step = 1 << 16
    z = zlib.decompressobj(31)
    parts, pos, why = [], at, ""
    try:
        while not z.eof and pos < len(data):
            piece = data[pos : pos + step]
            parts.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        why = str(e)
    if not z.eof and not why:
        why = "the member has no end"
    return b"".join(parts), pos - len(z.unused_data), why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, (headers, payload)) and ("gap", begin, end, reason) of an archive, in order and without holes.

    begin and end are the file's bytes; records of one member have the member's, and
    the reason of a gap inside a member says which bytes of its content are lost.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    while at < len(data):
        found: list[tuple] = []
        fault, end = "", at
        if data[at : at + 3] == _MAGIC:
            content, end, fault = _member(view, at)
            found = list(_split(content, proven=bool(fault)))
            if fault:  # what stands last is where the member breaks off
                found = [x for x in found if x[0] == "record" and x[2] < len(content)]
        else:
            try:
                headers, payload, end = _parse(view, at)
                found = [("record", at, end, (headers, payload))]
            except Gap as e:
                fault = str(e)
        if bad is not None and (found or not fault):
            yield "gap", bad, at, why
            bad = None
        if fault:
            m = _VERSION.search(data, at + 1)
            end = min((p for p in (data.find(_MAGIC, at + 1), m.start() if m else -1) if p >= 0), default=len(data))
        for kind, a, b, what in found:
            yield kind, at, end, what if kind == "record" else f"{what} (bytes {a} to {b} of the member)"
        if fault and found:
            yield "gap", at, end, f"{fault}; {len(found)} records before it are kept"
        elif fault and bad is None:
            bad, why = at, fault
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


READ = "path string, begin long, end long, fault string, page_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x and re.fullmatch(r"-?\d+", x) else None
        names = [f.split()[0] for f in READ.split(", ")] + ["payload"] * with_payload
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for kind, begin, end, what in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((path, begin, end, what, None, None, None, None, None, None) + (None,) * with_payload)
                    else:
                        h, payload = what
                        row = (path, begin, end, None, number(h.get("x-page-id")), h.get("warc-target-uri"), number(h.get("x-payload-length")) if h.get("warc-type") == "revisit" else len(payload))
                        row += (h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-type"), number(h.get("x-refers-to-page")))
                        rows.append(row + (payload,) * with_payload)
                    if len(rows) >= (500 if with_payload else 20_000):
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records (fault null) and quarantined byte gaps (fault set) of all files in a folder; a file of at most 2 GB is one task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), READ + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Writes pages into archives and returns what the reader finds there: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Fails when read if the reader quarantines anything that was written.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, smallest)
    fault = F.concat_ws(" ", F.lit("quarantined:"), "path", "begin", "end", "fault")
    return read_archives(spark, path).filter(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(fault).cast("boolean"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
