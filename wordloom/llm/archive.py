"""Zstandard WARC archives: one frame per record, a dictionary in the leading
skippable frame; a writer and a validating reader."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch
from .registry import register

# Fixed values of the WARC 1.1 format and of its Zstandard form.
VERSION = b"WARC/1.1"
MANDATORY = ("warc-record-id", "warc-date", "warc-type", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_LOW, SKIPPABLE_HIGH = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
# An empty skippable frame; it stands between records as the text sink's
# line separator, so that the sink can write binary files.
SEPARATOR = struct.pack("<II", SKIPPABLE_LOW, 0).decode("latin-1")

#: Payloads from this many bytes on are revisited when they repeat.
REVISIT_BYTES = 100
#: Bytes of the first payloads of an archive that its dictionary is trained on,
#: and the dictionary's size.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: A record's largest length that the reader accepts.
MAX_RECORD = (1 << 31) - 1
#: Bytes that the reader feeds to a frame's decoder at a time.
FEED = 16 << 10


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def _record(page_id, url, payload: bytes, refers_to, full_digest: str, full_length: int) -> bytes:
    revisit = refers_to is not None
    block = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{full_digest}:{url}")
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Page-ID", "" if page_id is None else str(page_id)),
            ("WARC-Target-URI", "" if url is None else "".join(url.split())),
            ("WARC-Payload-Digest", full_digest), ("WARC-Payload-Length", str(full_length)),
            ("WARC-Block-Digest", _digest(block))]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page", str(refers_to))]
    head.append(("Content-Type", "text/html; charset=utf-8"))
    head.append(("Content-Length", str(len(block))))
    lines = b"\r\n".join(f"{k}: {v}".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches):
    """Arrow batches (page_id, url, payload, digest, length, refers_to) ->
    frames, the dictionary's first."""
    import pyarrow as pa
    import zstandard as zstd

    def out(frames):
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    def rows():
        for b in batches:
            for i in range(b.num_rows):
                yield [b.column(k)[i].as_py() for k in range(6)]

    def record(r):
        return _record(r[0], r[1], r[2] or b"", r[5], "sha256:" + base64.b32encode(bytes.fromhex(r[3])).decode(), r[4])

    rows = rows()
    first, held = [], 0
    for r in rows:
        first.append(record(r))
        held += len(first[-1])
        if held >= DICTIONARY_SAMPLE:
            break
    if not first:
        return
    plain = zstd.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
    packer = plain
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, [x[:32768] for x in first])
        raw = trained.as_bytes()
        packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
        inside = plain.compress(raw)
        yield out([struct.pack("<II", DICTIONARY_MAGIC, len(inside)) + inside])
    except zstd.ZstdError:
        pass  # too few or too uniform samples for a dictionary: an archive may have none
    for x in first:
        yield out([packer.compress(x)])
    for r in rows:
        yield out([packer.compress(record(r))])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> None:
    """One archive per task, one record per row of ``pages``.

    Of rows with equal payloads of REVISIT_BYTES or more, those of the smallest
    page_id are responses, the others revisit it and carry no block.  A null
    html is the empty payload; a null page_id sorts last and may only revisit;
    rows repeated whole are responses each if their id is the smallest.  Only
    the three columns are read.  Files are written by Spark's committer, so a
    lost task leaves no half archive; an empty table writes no record."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    p = (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
         .withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long")))
    # one row per payload that repeats; a hot payload is counted map-side
    ids = (pages.select(F.col(page_id).alias("page_id"), payload.alias("payload"))
           .where(F.octet_length("payload") >= REVISIT_BYTES)
           .groupBy(F.sha2("payload", 256).alias("_digest"))
           .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    p = p.join(ids, p.digest == ids._digest, "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = p.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"),
                    "digest", "length", refers.alias("refers_to"))
    frames = rows.mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR) \
        .option("compression", "none").text(path)


class ArchiveError(ValueError):
    """An archive that breaks the format: where and why."""


def parse_record(data: bytes, where: str) -> tuple[dict, bytes]:
    """(headers by lower-case name, block) of one record, checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ArchiveError(f"{where}: no {VERSION.decode()} header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"{where}: header line without a colon")
        headers[name.strip().lower().decode()] = value.strip().decode()
    for name in MANDATORY:
        if not headers.get(name):
            raise ArchiveError(f"{where}: header {name} is missing")
    if not headers["content-length"].isdigit():
        raise ArchiveError(f"{where}: Content-Length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: Content-Length says {length}, the record holds {len(rest) - 4}")
    block = rest[:length]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != _digest(block):
        raise ArchiveError(f"{where}: block digest differs")
    return headers, block


def records_of(data: bytes, where: str):
    """(headers, block) of each frame of one archive, in order."""
    import zstandard as zstd
    at, n, frames = 0, len(data), 0
    plain = zstd.ZstdDecompressor(max_window_size=1 << 27)
    reader = plain
    while at < n:
        if n - at < 8:
            raise ArchiveError(f"{where}: {n - at} bytes after the last frame")
        magic, length = struct.unpack_from("<II", data, at)
        if SKIPPABLE_LOW <= magic <= SKIPPABLE_HIGH:
            if at + 8 + length > n:
                raise ArchiveError(f"{where}: skippable frame at {at} is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ArchiveError(f"{where}: dictionary at {at} is not the leading frame")
                inside = data[8:8 + length]
                if inside[:4] == struct.pack("<I", FRAME_MAGIC):
                    inside = plain.decompress(inside)
                reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(inside), max_window_size=1 << 27)
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"{where}: no frame at {at}")
        size = zstd.frame_content_size(data[at:at + 18])
        if size is not None and size > MAX_RECORD:
            raise ArchiveError(f"{where}: frame at {at} says {size} bytes")
        one, parts, end = reader.decompressobj(), [], at
        try:
            while not one.eof and end < n:
                parts.append(one.decompress(data[end:end + FEED]))
                end = min(end + FEED, n)
        except zstd.ZstdError as e:
            raise ArchiveError(f"{where}: frame at {at}: {e}") from e
        if not one.eof:
            raise ArchiveError(f"{where}: frame at {at} is cut off")
        record = b"".join(parts)
        if size not in (None, -1) and len(record) != size:
            raise ArchiveError(f"{where}: frame at {at} says {size} bytes and holds {len(record)}")
        yield parse_record(record, f"{where}: record {frames}")
        frames += 1
        at = end - len(one.unused_data)


def _read_batches(batches):
    import pyarrow as pa
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("block", pa.binary())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        for i in range(b.num_rows):
            where, data, rows, held = b.column(0)[i].as_py(), b.column(1)[i].as_py(), [], 0
            for h, block in records_of(data, where):
                kind = h["warc-type"]
                digest = h["warc-payload-digest"]
                if kind == "response" and (digest != _digest(block) or int(h["warc-payload-length"]) != len(block)):
                    raise ArchiveError(f"{where}: payload digest or length differs")
                rows.append((int(h["warc-page-id"]) if h.get("warc-page-id") else None, h.get("warc-target-uri") or None,
                             int(h["warc-payload-length"]),
                             base64.b32decode(digest.partition(":")[2]).hex(), kind,
                             int(h["warc-refers-to-page"]) if kind == "revisit" else None,
                             block if kind == "response" else None))
                held += len(block)
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, block (null for a revisit).  Each
    archive is one task's row.  A frame, header, length or digest that does
    not hold fails the job with the file and record (ArchiveError)."""
    files = (spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content"))
    return files.mapInArrow(_read_batches, "page_id long, url string, payload_bytes long, payload_digest string, "
                                           "record_type string, refers_to long, block binary")


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
g as (select payload_digest, min(page_id) as first_id from q group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from q join g using (payload_digest)
"""


@register("op1_warc", _SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages."""
    return round_trip(read(spark, sf_dir, "pages")).drop("url", "block")
