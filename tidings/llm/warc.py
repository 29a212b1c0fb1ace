"""Operator 6, a converter of legacy ARC archives to WARC.

An ARC file begins with a version block, ``filedesc://`` with the version's own list of header fields: version 1 has five
(URL, IP address, date, type, length), version 2 ten (result code, checksum, location, offset and file name come
in before the length). Records follow as a header line, as many bytes as the line declares, and a line end. Records are found by
declared lengths alone, so a payload may hold anything that looks like a header.

Each ARC record becomes a WARC 1.0 record. What ARC lacks is synthesised from the record itself, so a rerun gives the
same: ``WARC-Record-ID`` is a name-based UUID of URL, date, payload digest, file name and place in the file, ``WARC-Date`` the 14 digits as a timestamp,
``WARC-Type`` response for content with an HTTP head, resource otherwise, ``WARC-Block-Digest`` and
``WARC-Payload-Digest`` SHA-1. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest
page id keeps its payload, the others are revisits that name it.

Every file below a path is read: gzip with one member per record, as such archives are stored, gzip with one for all, and
plain. Records stay bytes from end to end, so images and the like are as welcome as pages. Files are parsed twice and nothing
of them is shuffled: a first pass makes a narrow table of digests, on which the revisits are decided; the decisions, a list per
file, meet the files again, and each is written in one go. A record is known by its file and its place in it;
a page id in the HTTP head (``X-Page-Id``) is an extra that archives of other makers lack.

Defined results: null html is an empty payload; a null URL is written as ``-`` and its record is a resource in name only
(the HTTP head still makes it a response); spaces and line ends in a URL are percent-encoded; a null page id is smaller than
all others and comes back as null; repeated rows are records of their own with their own ids, equal page ids among the largest all
stay responses; payloads below the limit are never revisits; extra columns are ignored; an empty table gives empty
archives and an empty result; a record that is shorter than it declares stops the job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import prepare
from tidings.session import new_table_path, through_table

REVISIT_BYTES = 1000
#: Records in a file, and its bytes, at most (but two records always).
RECORDS_PER_FILE, FILE_BYTES = 1000, 256 << 20
#: Decisions on revisits are broadcast to the files up to this number.
BROADCAST_REVISITS = 50_000
# Fixed values of the two versions' formats: the header fields of each.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
RECORD_END = "\r\n\r\n"
RESULT_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string"
)


def safe_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def version_block(version: int, date: str) -> bytes:
    """The first record of an ARC file, without its last line end."""
    body = f"{version} 0 tidings\n{' '.join(FIELDS[version])}\n".encode()
    head = ["filedesc://landed.arc", "0.0.0.0", date, "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", "landed.arc"]
    return f"{' '.join(head)} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, content: bytes, offset: int) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", hashlib.md5(content).hexdigest(), "-", str(offset), "landed.arc"]
    return f"{' '.join(head)} {len(content)}\n".encode() + content


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record, the version block first."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        line_end = data.find(b"\n", at)
        if line_end < 0 or not data[at:line_end].strip():
            if line_end < 0:
                return
            at = line_end + 1
            continue
        values = data[at:line_end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if values[0].startswith("filedesc://"):
            # The block's own header line has the fields of the version that its content names.
            length = int(values[-1])
            content = data[line_end + 1 : line_end + 1 + length]
            first, names = content.decode().split("\n")[:2]
            fields = names.rstrip("\r").split(" ")
            if int(first.split(" ")[0]) not in FIELDS or len(fields) != len(values):
                raise ValueError(f"unknown version block: {first}")
        header = dict(zip(fields, values, strict=True))
        length = int(header["Archive-length"])
        if line_end + 1 + length > len(data):
            raise ValueError("a record is shorter than it declares")
        yield header, data[line_end + 1 : line_end + 1 + length]
        at = line_end + 1 + length + 1


def digest_text(sha1: bytes) -> str:
    return f"sha1:{base64.b32encode(sha1).decode()}"


def record_id(url: str, date: str, payload_sha1: str, file: str, no: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {payload_sha1} {file} {no}')}"


def unzipped(data: bytes) -> bytes:
    """A file's bytes, whether it is plain, gzip, or gzip with many members."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member ends too early")
        data = member.unused_data
    return b"".join(parts) if parts else data


def warc_date(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without its closing empty lines."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": str(len(block))}.items())
    return f"WARC/1.0\r\n{head}\r\n".encode("utf-8", "surrogateescape") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        body = data.find(b"\r\n\r\n", at)
        if body < 0:
            return
        lines = data[at:body].decode("utf-8", "surrogateescape").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError("no record where the length before it says")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = body + 4
        end = start + int(fields["Content-Length"])
        yield fields, data[start:end]
        at = end + len(RECORD_END)


def _http(page_id: int | None, payload: bytes) -> bytes:
    named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Head fields, the head's bytes and the payload. A block without an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, _, payload = block.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line), head + b"\r\n\r\n", payload


def _to_arc(version_of: int, date: str, per_file: int):
    """Archives of one version: a task's pages are cut into files of the writer's size, each opened by a version block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = version_block(version_of, date)
        n, offset = 0, 0
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if n % per_file == 0:
                    out.append(block)
                    n, offset = n + 1, len(block) + 1
                record = arc_record(version_of, safe_url(url), date, _http(page_id, (html or "").encode()), offset)
                out.append(record)
                n, offset = n + 1, offset + len(record) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def _files(records: DataFrame, path: str, line_end: str, per_file: int) -> None:
    """Byte strings one after another in files. Spark's text writer takes their bytes as they are."""
    writer = records.select(F.col("value").cast("string")).write.option("lineSep", line_end).option("compression", "gzip")
    # Archives are read again at once; the fastest level of compression does.
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their names; each fits in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20240229120000") -> None:
    """``pages(page_id, url, html)`` as legacy archives: version 1 for even page ids, version 2 for odd ones and null. All pages
    share one archive date, as one crawl does."""
    picked = pages.select(F.col("page_id").cast("long"), "url", "html")
    longest = picked.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    per_file = max(2, min(RECORDS_PER_FILE, FILE_BYTES // (longest + 1024)))
    for version, parity in ((1, 0), (2, 1)):
        some = picked.filter(F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(1)) == parity)
        _files(some.mapInArrow(_to_arc(version, date, per_file), "value binary"), f"{path}/version={version}", "\n", per_file)


def _records_of(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """Place, header and content of each record of an ARC file but the version blocks."""
    for no, (header, block) in enumerate(parse_arc(unzipped(content))):
        if not header["URL"].startswith("filedesc://"):
            yield no, header, block


HEADS = "path string, name string, no int, page_id long, url string, date string, payload_digest string, payload_bytes long"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in HEADS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content")), strict=True):
            rows = []
            for no, header, block in _records_of(content):
                fields, _, payload = _http_parts(block)
                page, url = fields.get("X-Page-Id"), header["URL"].encode("utf-8", "surrogateescape").decode("latin-1")
                rows.append((path, name, no, int(page) if page else None, url, header["Archive-date"], hashlib.sha1(payload).hexdigest(), len(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _to_warc(per_file: int):
    """The records of each file, those decided upon as revisits without their payload; a ``warcinfo`` record opens each file written."""

    def record(name: str, no: int, header: dict, block: bytes, decision: dict | None) -> bytes:
        _, head, payload = _http_parts(block)
        url, date, sha1 = header["URL"], header["Archive-date"], hashlib.sha1(payload)
        plain = url.encode("utf-8", "surrogateescape").decode("latin-1")
        kind = "response" if head else "resource"
        fields = {
            "WARC-Type": kind, "WARC-Record-ID": f"<{record_id(plain, date, sha1.hexdigest(), name, no)}>",
            "WARC-Date": warc_date(date), "WARC-Target-URI": url, "WARC-Payload-Digest": digest_text(sha1.digest()),
        }
        if decision:
            target = record_id(decision["to_url"], decision["to_date"], sha1.hexdigest(), decision["to_name"], decision["to_no"])
            fields |= {
                "WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                "WARC-Refers-To": f"<{target}>", "X-Payload-Length": str(len(payload)),
            } | ({} if decision["to_page"] is None else {"X-Refers-To-Page": str(decision["to_page"])})
            block = head
        fields |= {
            "WARC-Block-Digest": digest_text(hashlib.sha1(block).digest()),
            "Content-Type": "application/http; msgtype=response" if head else header["Content-type"],
        }
        return warc_record(fields, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, TaskContext.get().partitionId()
        info = b"software: tidings\r\nformat: WARC File Format 1.0\r\n"
        for batch in batches:
            for name, content, decided in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "decided")), strict=True):
                decisions = {d["no"]: d for d in decided or ()}
                out = []
                for no, header, block in _records_of(content):
                    if n % per_file == 0:
                        fields = {
                            "WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id('warcinfo', header['Archive-date'], '', name, n + made)}>",
                            "WARC-Date": warc_date(header["Archive-date"]), "Content-Type": "application/warc-fields", "WARC-Block-Digest": digest_text(hashlib.sha1(info).digest()),
                        }
                        out.append(warc_record(fields, info))
                        n += 1
                    out.append(record(name, no, header, block, decisions.get(no)))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """All ARC files below a path as WARC files."""
    files = _read_files(spark, arc_path)
    heads = through_table(files.mapInArrow(_heads, HEADS), "heads")
    large = heads.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    order = F.struct(F.col("page_id").isNotNull(), "page_id", "path", "no")
    kept = large.groupBy("payload_digest").agg(
        F.count("*").alias("n"), F.max_by(F.struct("page_id", "url", "date", "name", "path", "no"), order).alias("to")
    ).filter("n > 1").select("payload_digest", *[F.col(f"to.{a}").alias(f"to_{b}") for a, b in (("page_id", "page"), ("url", "url"), ("date", "date"), ("name", "name"), ("path", "path"), ("no", "no"))])
    itself = (F.col("path") == F.col("to_path")) & (F.col("no") == F.col("to_no"))
    revisits = large.select("path", "no", "page_id", "payload_digest").join(kept, "payload_digest").filter(
        ~itself & ~F.coalesce(F.col("page_id") == F.col("to_page"), F.lit(False))
    )
    revisits = through_table(revisits.drop("payload_digest", "page_id", "to_path"), "revisits")
    decided = revisits.groupBy("path").agg(F.collect_list(F.struct("no", "to_page", "to_url", "to_date", "to_name", "to_no")).alias("decided"))
    decided = F.broadcast(decided) if revisits.count() <= BROADCAST_REVISITS else decided
    most = heads.groupBy("path").agg(F.sum("payload_bytes").alias("b"), F.count("*").alias("n")).agg(F.max(F.col("b") / F.col("n"))).first()[0] or 0
    per_file = max(2, min(RECORDS_PER_FILE, int(FILE_BYTES // (most + 1024))))
    _files(files.join(decided, "path", "left").mapInArrow(_to_warc(per_file), "value binary"), warc_path, RECORD_END, per_file)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RESULT_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(unzipped(content.as_py())):
                if digest_text(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
                    raise ValueError("a block differs from its digest")
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = _http_parts(block)
                revisit = fields["WARC-Type"] == "revisit"
                declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                if not revisit and hashlib.sha1(payload).digest() != declared:
                    raise ValueError("a payload differs from its digest")
                rows.append((
                    number(http.get("X-Page-Id")), int(fields["X-Payload-Length"]) if revisit else len(payload), declared.hex(), fields["WARC-Type"],
                    number(fields.get("X-Refers-To-Page")), fields["WARC-Record-ID"].strip("<>"), fields["WARC-Date"],
                    fields["WARC-Target-URI"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"),
                ))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below a path, with its digests checked."""
    return _read_files(spark, path).mapInArrow(_records, RESULT_SCHEMA)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    prepare(spark)
    arc, warc = new_table_path(spark, "arc"), new_table_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
