"""Legacy archive converter: ARC records become WARC records, written to archives and read back.

An ARC record is one header line and a block of the declared length. The line's fields depend on the version:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length``

From these the WARC identifier, timestamp, type and digests follow. Of records with equal payloads one stays a
response and the others become revisits that refer to it. Archives are written by Spark's text writer, with the end
of a WARC record (two empty lines) as the line separator, so the executors need no file system but Spark's.

Two passes read the records: the first yields only digests, which are grouped with a combine before the shuffle;
the second joins the few columns of each revisit to its record and writes. A payload that very many records share
therefore costs one small row for each of them and no group is ever gathered. Equal rows collapse to one with their number
before they are numbered, so each copy has an identifier of its own. Compressed archives are read as a stream of pieces:
memory holds one record, however large the archive.

What cannot be parsed is a row with an ``error``, never a failed job: the rest of an ARC file from a malformed header on, a
malformed record (a ``metadata`` record in the archive), a WARC record without a length, and the end of a cut archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.store import fresh_path, joined_in_parts, stored, until_exit

END = "\r\n\r\n"
FIELDS = {1: 5, 2: 10}
_DATE = re.compile(rb"\d{14}\Z")
_SPACE = re.compile(r"\s+")
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class ArcError(ValueError):
    """A header line that does not have its version's fields; ``at`` is where it begins."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: bytes
    content_type: str
    block: bytes
    truncated: bool = False


def parse_record(data: bytes, version: int, at: int = 0) -> tuple[ArcRecord, int]:
    """The record that starts at ``at`` and where its block ends. A URL may hold spaces; the other fields may not."""
    if version not in FIELDS:
        raise ArcError(f"unknown ARC version {version}", at)
    end = data.find(b"\n", at)
    line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
    parts = line.rsplit(b" ", FIELDS[version] - 1)
    if end < 0 or len(parts) != FIELDS[version] or not parts[-1].isdigit():
        raise ArcError(f"not a version {version} header line: {line[:200]!r}", at)
    length = int(parts[-1])
    block = data[end + 1 : end + 1 + length]
    url, ip, date, kind = (p.decode("utf-8", "replace") for p in parts[:4])
    return ArcRecord(url, ip, parts[2], kind, block, len(block) < length), end + 1 + len(block)


def parse_archive(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, version, bytes) of every record of an ARC file; its first record names the version."""
    head, at = parse_record(data, 1)
    version, named = 1, head.url.startswith("filedesc:")
    if named:
        told = head.block.split(None, 1)
        if not told or told[0] not in (b"1", b"2"):
            raise ArcError("the first record names no known version")
        version = int(told[0])
    at = at if named else 0
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at < len(data):
            _, end = parse_record(data, version, at)
            yield at, version, data[at:end]
            at = end


def timestamp(date: bytes) -> str:
    """``YYYYMMDDhhmmss`` as WARC writes it; anything else is the epoch."""
    d = date.decode() if _DATE.match(date) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parts_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with the empty line) and payload; a block without an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, n = min(ends)
    return block[: at + n], block[at + n :]


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _joined(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def to_warc(record: ArcRecord, key: str, refers_to: str | None = None, own_id: str | None = None, refers_id: str | None = None) -> bytes:
    """The WARC record without the two empty lines that end it. ``refers_to`` is the key of the response that a revisit repeats;
    the identifiers default to those of the keys."""
    head, payload = parts_of(record.block)
    url, date, digest = _SPACE.sub("%20", record.url), timestamp(record.date), base32_sha1(payload)
    kind = "revisit" if refers_to is not None else "response" if head or record.url.startswith("dns:") else "resource"
    block = head if kind == "revisit" else record.block
    fields: list[tuple[str, object]] = [
        ("WARC-Type", kind), ("WARC-Record-ID", own_id or record_id(key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Source-Key", key), ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response" if head else _SPACE.sub(" ", record.content_type)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", refers_id or record_id(refers_to)), ("X-Refers-To-Key", refers_to), ("WARC-Truncated", "length")]
    elif record.truncated:
        fields.append(("WARC-Truncated", "unspecified"))
    return _joined(fields, block)


def unparsed(raw: bytes, key: str, error: str, own_id: str) -> bytes:
    """A metadata record that holds what could not be parsed."""
    fields = [("WARC-Type", "metadata"), ("WARC-Record-ID", own_id), ("WARC-Date", timestamp(b"")), ("WARC-Block-Digest", f"sha1:{base32_sha1(raw)}"), ("X-Source-Key", key), ("X-Error", _SPACE.sub(" ", error)), ("Content-Type", "application/octet-stream")]
    return _joined(fields, raw)


def split_archives(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``key`` (path and offset), ``version``, ``record``, ``error`` of every record of ARC files, one file a row.

    A null or empty file has none. From a malformed header on, the rest of the file is one row with an ``error`` and a null
    version; a record that ends before its length is cut short. Records leave a few at a time; a file is held whole.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.string()))], names=["key", "version", "record", "error"])

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data, rows, size = content.as_py() or b"", [], 0
                try:
                    for at, version, record in parse_archive(data) if data else ():
                        rows.append((f"{path.as_py()}:{at:012d}", version, record, None))
                        size += len(record)
                        if size > 1 << 24 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                except ArcError as e:
                    rows.append((f"{path.as_py()}:{e.at:012d}", None, data[e.at :], str(e)))
                yield batch_of(rows)

    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(split, "key string, version int, record binary, error string")


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """``key``, ``version``, ``record``: each page as an ARC record, of version 1 where the id is even or null and 2 where it is odd.

    A null page is empty and a null URL is ``about:blank``; both lengths are of the UTF-8 bytes.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), r"\s", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    version = F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(2)), F.lit(0)).cast("int") + 1
    rows = pages.select(F.col(id_col).alias("key"), version.alias("version"), url.alias("url"), head.alias("head"), html.alias("html"))
    more = F.when(F.col("version") == 2, " 200 - - 0 pages.arc ").otherwise(" ")
    line = F.concat(F.col("url"), F.lit(f" 0.0.0.0 {date} text/html"), more, (F.octet_length("head") + F.octet_length("html")).cast("string"), F.lit("\n"))
    return rows.select("key", "version", F.concat(line, F.col("head"), F.col("html")).cast("binary").alias("record"))


def _parsed(raw: bytes | None, version: int | None) -> tuple[ArcRecord | None, str]:
    try:
        return parse_record(raw or b"", version)[0], ""
    except ArcError as e:
        return None, str(e)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, prints = [], []
        for version, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            record, _ = _parsed(raw := data.as_py() or b"", version)
            found.append(None if record is None else base32_sha1(parts_of(record.block)[1]))
            prints.append(hashlib.sha1(raw).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), pa.array(found, pa.string())], names=["key", "print", "digest"])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, version, record, print, to_key, to_print, revisit, copy) as WARC records."""
    for batch in batches:
        out = []
        for key, version, data, own, to_key, to_own, revisit, copy in zip(*(batch.column(k) for k in range(8))):
            text = lambda x: "" if x.as_py() is None else str(x.as_py())
            name, raw = record_id(text(key), text(own), copy.as_py()), data.as_py() or b""
            record, error = _parsed(raw, version.as_py())
            if record is None:
                out.append(unparsed(raw, text(key), error, name))
            elif revisit.as_py():
                out.append(to_warc(record, text(key), text(to_key), name, record_id(text(to_key), text(to_own), 0)))
            else:
                out.append(to_warc(record, text(key), None, name))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_warc(records: DataFrame, path: str | None = None, per_file: int = 4000, per_task: int = 1000) -> str:
    """Convert ARC records (``key``, ``version``, ``record``; other columns are not read) and write them as ``.gz`` archives; returns their folder.

    Of records with equal payloads, also empty ones, that with the largest key is a response and all others are revisits
    of it. All records of that key are responses. Repeated rows are written as often as they come, each with an identifier of its own.
    A null key counts as smaller than any other; a null record is an empty one. Malformed records become metadata records. An
    archive holds at most ``per_file`` records. An empty table writes archives without records.
    """
    spark = records.sparkSession
    own_path = path is None
    path = path or fresh_path(spark, "warc")
    kind = records.schema["key"].dataType.simpleString()
    records = records.select("key", "version", F.coalesce("record", F.lit(b"")).alias("record"))
    found = stored(records.mapInArrow(_digests, f"key {kind}, print string, digest string"), "arc-digests")
    each = stored(found.groupBy("key", "print", "digest").agg(F.count("*").alias("n")), "arc-records")
    shared = each.where("digest is not null").groupBy("digest").agg(F.max(F.struct("key", "print")).alias("to"), F.count("*").alias("sharing")).where("sharing > 1")
    total = each.count()
    later = joined_in_parts(each, stored(shared, "arc-shared"), "digest", "sharing", total).where(~F.col("key").eqNullSafe(F.col("to.key")))
    later = later.select("key", "print", "n", F.col("to.key").alias("to_key"), F.col("to.print").alias("to_print"), F.lit(True).alias("revisit"))
    copied = each.where("n > 1").select("key", "print", "n")
    marks = later.unionByName(copied, allowMissingColumns=True).groupBy("key", "print").agg(F.max("n").alias("n"), F.max("to_key").alias("to_key"), F.max("to_print").alias("to_print"), F.coalesce(F.max("revisit"), F.lit(False)).alias("revisit"))
    marks = stored(marks.select(F.col("key").alias("k"), F.col("print").alias("p"), "n", "to_key", "to_print", "revisit"), "arc-marks")
    rows = records.withColumn("print", F.sha1("record"))
    rows = rows.join(marks, rows["key"].eqNullSafe(marks["k"]) & (rows["print"] == marks["p"]), "left")
    names = ["key", "version", "record", "print", "to_key", "to_print", F.coalesce("revisit", F.lit(False)).alias("revisit")]
    out = rows.where("n is null or n = 1").select(*names, F.lit(0).cast("long").alias("copy"))
    if not copied.isEmpty():
        one = rows.where("n > 1").groupBy("key", "print").agg(*[F.any_value(c).alias(c) for c in ("version", "record", "to_key", "to_print", "revisit", "n")])
        parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / per_task)))).repartition("key", "print", "part")
        numbers = F.sequence(F.col("part") * per_task, F.least(F.col("n"), (F.col("part") + 1) * per_task) - 1)
        out = out.unionByName(parts.withColumn("copy", F.explode(numbers)).select(*names, "copy"))
    out = out.mapInArrow(_convert, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    if own_path:
        until_exit(spark, path)
    return path


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields in lower case, block, error) of each record, by declared lengths; holds one record at a time."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (start := held.find(b"WARC/")) < 0 or (end := held.find(b"\r\n\r\n", start)) < 0:
            if not more():
                if held.strip():
                    yield {}, bytes(held), "the archive ends inside a header"
                return
        fields = dict(x.split(":", 1) for x in held[start:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        if not fields.get("content-length", "").isdigit():
            yield fields, b"", "the record has no length"
            del held[: end + 4]
            continue
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop:
            if not more():
                yield fields, bytes(held[end + 4 :]), "the archive ends inside a record"
                return
        yield fields, bytes(held[end + 4 : stop]), None
        del held[:stop]


_READ = ("source_key", "record_type", "record_id", "refers_to", "refers_to_key", "url", "date", "payload_digest", "error")
_FIELDS = ("x-source-key", "warc-type", "warc-record-id", "warc-refers-to", "x-refers-to-key", "warc-target-uri", "warc-date")


def _read_row(fields: dict[str, str], block: bytes, error: str | None) -> tuple:
    payload = parts_of(block)[1]
    if fields.get("warc-type") == "revisit":
        length = fields.get("x-payload-length", "")
        digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(length) if length.isdigit() else None
    else:
        digest, size = base32_sha1(payload), len(payload)
    return (*(fields.get(k) for k in _FIELDS), digest, error or fields.get("x-error"), size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ``.gz`` and ``.warc`` archives under ``path``, of any writer: fields that a record lacks are null.

    The digest and length are of the payload as read; a revisit has those of the payload that it stands for. Records that could not
    be parsed have an ``error``. A ``.gz`` archive is read as a stream; an uncompressed one is held whole by its task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, piece) for batch in batches for path, piece in zip(batch.column(0).to_pylist(), batch.column(1)))
        held: list[tuple] = []
        for _, pieces in groupby(rows, key=itemgetter(0)):
            whole = (b"\r\n\r\n" * (k > 0) + piece.as_py() for k, (_, piece) in enumerate(pieces))
            for found in parse_warc(whole):
                held.append(_read_row(*found))
                if len(held) >= 1000:
                    yield _read_batch(held)
                    held = []
        yield _read_batch(held)

    packed = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.input_file_name().alias("path"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("path", F.col("content").alias("piece"))
    return packed.unionByName(plain).mapInArrow(read, ", ".join(f"{n} string" for n in _READ) + ", payload_bytes long")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 10
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:9]), pa.array(columns[9], pa.int64())], names=[*_READ, "payload_bytes"])
