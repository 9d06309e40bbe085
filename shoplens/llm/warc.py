"""WARC archives compressed record by record with Zstandard.

An archive is a sequence of Zstandard frames. A leading skippable frame holds
the dictionary the following frames were compressed with; after it comes one
frame per WARC record, so a reader can start at any frame.

``write_archives`` packs rows into archives of bounded size, each with a
dictionary trained on its own first records, and lets Spark's text writer
commit them: one archive is one row of one file, and the row separator is
itself an empty skippable frame (its eight bytes are all ASCII), so the files
are valid archives on any file system Spark can write. ``read_archives`` reads
whole files back, decodes each frame on its own and validates headers,
lengths and digests.

Defined cases: a null payload is empty; a null page id or url is written as
absent and comes back null; rows that repeat a page id keep one record each,
and all of those with the group's smallest id are responses; an empty table
gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import salted_join, stage_path

DICT_MAGIC = 0x184D2A5D                     # skippable frame that holds the dictionary
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
EMPTY_SKIP = "P*M\x18\x00\x00\x00\x00"      # skippable frame of length 0, as text
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
NAMES = {n.lower(): n for n in (*REQUIRED, "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-Refers-To",
                                "WARC-Target-URI")}                # header names hold in any case
PIECE = 1 << 16                                 # compressed bytes handed to the decoder at a time

RECORDS = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, warc_date string")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(pairs: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def build_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit (``refers_to`` is
    not None) whose block keeps the HTTP header with the full length only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    revisit = refers_to is not None
    block = http if revisit else http + payload
    pairs = [("WARC-Type", "revisit" if revisit else "response"),
             ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        pairs.append(("WARC-Target-URI", urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=~-._")))
    pairs += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
              ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if revisit:
        pairs += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    pairs += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(pairs) + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dict_bytes: int = 16384, level: int = 3) -> bytes:
    """Dictionary frame (if one can be trained) and one frame per record."""
    import zstandard as zstd
    head, trained = b"", None
    sample = [r[:65536] for r in records[:400]]
    if len(sample) >= 16:
        try:
            trained = zstd.train_dictionary(dict_bytes, sample, level=level)
            body = trained.as_bytes()
            head = struct.pack("<II", DICT_MAGIC, len(body)) + body
        except zstd.ZstdError:                # too few or too uniform samples
            trained = None
    c = zstd.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return head + b"".join(c.compress(r) for r in records)


def iter_frames(archive: bytes) -> Iterator[bytes]:
    """The record of every frame, decoded with the leading dictionary."""
    import zstandard as zstd
    view, at, trained, first = memoryview(archive), 0, None, True
    d = zstd.ZstdDecompressor()
    while at < len(view):
        if at + 4 > len(view):
            raise WarcError(f"{len(view) - at} stray bytes at {at}")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIP_MAGICS:
            if at + 8 > len(view):
                raise WarcError(f"cut skippable frame at {at}")
            size = struct.unpack_from("<I", view, at + 4)[0]
            if at + 8 + size > len(view):
                raise WarcError(f"skippable frame at {at} is longer than the archive")
            if magic == DICT_MAGIC:
                if not first:
                    raise WarcError("the dictionary frame does not lead the archive")
                body = bytes(view[at + 8:at + 8 + size])
                if body[:4] == struct.pack("<I", ZSTD_MAGIC):      # the dictionary may itself be compressed
                    body = zstd.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                trained = zstd.ZstdCompressionDict(body)
                d = zstd.ZstdDecompressor(dict_data=trained)
            at += 8 + size
        elif magic == ZSTD_MAGIC:
            length = zstd.frame_content_size(view[at:at + 18])
            o, parts, end = d.decompressobj(), [], at
            while not o.eof and end < len(view):                   # in pieces: what lies behind the frame is copied back
                piece = view[end:end + PIECE]
                parts.append(o.decompress(piece))
                end += len(piece)
            if not o.eof:
                raise WarcError(f"cut frame at {at}")
            record = b"".join(parts)
            if length >= 0 and length != len(record):
                raise WarcError(f"frame at {at} says {length} bytes, has {len(record)}")
            at = end - len(o.unused_data)
            yield record
        else:
            raise WarcError(f"unknown frame {magic:#x} at {at}")
        first = False


def _page_id(uri: str) -> int | None:
    """The number of a record id; None where the record has none."""
    pid = uri.strip("<>").removeprefix(URN)
    if pid and not pid.removeprefix("-").isdigit():
        raise WarcError(f"{uri[:60]!r} is no id of a page")
    return int(pid) if pid else None


def parse_record(record: bytes) -> dict:
    """Validated fields of one record."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or k.strip() != k or not k:
            raise WarcError(f"bad header line {line[:60]!r}")
        name = k.decode()
        fields[NAMES.get(name.lower(), name)] = v.strip().decode()
    for k in REQUIRED:
        if k not in fields:
            raise WarcError(f"{k} is missing")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 \
            or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    block = rest[:-4]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest does not fit")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    digest = fields.get("WARC-Payload-Digest", "")
    if not sep or not digest.startswith("sha1:"):
        raise WarcError("no payload header or digest")
    digest = digest[5:]
    refers = None
    if kind == "response":
        if length != len(payload) or digest != sha1_base32(payload):
            raise WarcError("payload length or digest does not fit")
    else:
        if payload or length < 0 or "WARC-Refers-To" not in fields:
            raise WarcError("bad revisit record")
        refers = _page_id(fields["WARC-Refers-To"])
    url = fields.get("WARC-Target-URI")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": None if url is None else urllib.parse.unquote(url),
            "payload": payload if kind == "response" else None, "payload_bytes": length,
            "payload_digest": digest, "record_type": kind, "refers_to": refers, "warc_date": fields["WARC-Date"]}


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): rows whose payload of at least
    ``min_bytes`` equals that of a smaller id point to the smallest such id.

    Only digests that occur more than once are joined back, salted, so a
    payload shared by a third of all pages is spread over tasks."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_size", F.octet_length("payload").cast("long")) \
        .withColumn("_key", F.when(F.col("_size") >= min_bytes, F.sha2("payload", 256)))
    first = rows.where("_key is not null").groupBy("_key") \
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = salted_join(rows, first, ["_key"], F.coalesce("page_id", F.lit(0)), how="left")
    refers = F.when(F.col("_first") < F.coalesce("page_id", F.lit(2**63 - 1)), F.col("_first"))
    return out.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   max_bytes: int = 8 << 20) -> None:
    """Archives of (page_id, url, payload, refers_to) rows under ``path``;
    each holds whole records of at most ``max_bytes`` together, or one record."""
    def pack(batches):
        import pyarrow as pa
        held, size = [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([build_archive(held)], pa.binary())], ["archive"])
        for b in batches:
            for pid, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                r = build_record(pid, url, payload, refers, date)
                if held and size + len(r) > max_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield archive()

    made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(pack, "archive binary")
    (made.select(F.col("archive").cast("string").alias("value")).write
     .option("lineSep", EMPTY_SKIP).option("maxRecordsPerFile", 1).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit record of the archives under ``path``.
    A record or frame that breaks the format fails the read (``WarcError``)."""
    def parse(batches):
        import pyarrow as pa
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("warc_date", pa.string())])
        for b in batches:
            for content in b.column(0):
                got, size = [], 0
                for record in iter_frames(content.as_py()):
                    fields = parse_record(record)
                    if fields["record_type"] in ("response", "revisit"):
                        got.append(fields)
                        size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(got, schema)
                        got, size = [], 0
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder
    and return the records read back from them."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_archives(mark_revisits(pages, min_bytes=min_bytes), path)
    return read_archives(spark, path)
