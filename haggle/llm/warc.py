"""WARC archives (operator 11): monolithic gzip files, normalised to a member per record, with an offset index.

``write_archives`` writes records as a crawler that compresses whole files
would: each file is one gzip stream, of use only from its start.  ``normalise``
inflates every such stream once, writes each record as a gzip member of its
own, and adds a sidecar index (file, offset, length and the record's main
fields), so that a reader can start at any record.

All files are written by Spark's own writers, which commit whole tasks and
reach every store that Spark reaches; a lost executor leaves no half archive.
A record is a string of its bytes, ended by the two line ends that WARC asks
for.  Members are written one after another with an empty gzip member between
them, which any gzip reader skips.  A member names its length in the 'sl' field
of its header, so the index is made from the headers alone.

Scale.  Bodies are shuffled only if the table of repeated payloads is too large
to be broadcast, and then those of the commonest payloads stay where they are.  An
archive is no larger than the share of a scan task, or ``records_per_archive``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm.spark import BROADCAST_ROWS, checkpoint

RESPONSE, REVISIT = "response", "revisit"
LEAST_BYTES = 100         # smaller payloads are stored again rather than referred to
HEAVY_SHARE = 1000        # a payload with over 1/1000 of the records is heavy; there are fewer than 1000
RECORDS_PER_ARCHIVE = 100_000
STEP = 1 << 20            # bytes inflated at once
BATCH_BYTES = 4 << 20

# FIXED VALUES: names of the WARC 1.1 format
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

# An empty gzip member: header, an empty deflate block, check sum and size 0.
BETWEEN = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])

INDEX_SCHEMA = ("file string, offset long, length long, page_id long, url string, record_type string, "
                "refers_to long, payload_digest string, payload_bytes long")
RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
                 "payload_bytes long, payload binary")


# -- writing

def _name(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), digest, F.lit(">"))


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (id, url, payload) plus digest, size and refers_to (null for responses)."""
    rows = pages.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256),
                              "size": F.octet_length("payload").cast("long")})
    groups = checkpoint(rows.where(F.col("size") >= least).groupBy(F.unhex("digest").alias("key"))
                        .agg(F.min("id").alias("first"), F.count("*").alias("times"))
                        .where("times > 1 and first is not null"))
    rows = rows.withColumn("key", F.unhex("digest"))
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(groups), "key", "left")
    else:
        total = pages.count()
        heavy = F.broadcast(groups.where(F.col("times") * HEAVY_SHARE > total))  # under HEAVY_SHARE rows
        light = groups.where(F.col("times") * HEAVY_SHARE <= total)
        joined = rows.join(heavy, "key").unionByName(rows.join(heavy, "key", "left_anti").join(light, "key", "left"))
    return joined.select("id", "url", "payload", "digest", "size",
                         F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")).alias("refers_to"))


def _record(date: str) -> Column:
    """The record of a row of ``with_revisits``, without the two line ends after it."""
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(HTTP_HEAD), F.col("size").cast("string"), F.lit(END + END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    return F.concat(
        F.lit(VERSION + END), line("WARC-Type", F.when(again, F.lit(REVISIT)).otherwise(F.lit(RESPONSE))),
        line("WARC-Record-ID", _name(F.col("id"), F.col("digest"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", _name(F.col("refers_to"), F.col("digest"))),
                               line("WARC-Profile", F.lit(SAME_PAYLOAD)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def write_archives(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z",
                   records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write a WARC record per row as whole-file gzip archives under ``out``.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    smallest page_id are responses and all others revisits of that page_id; smaller
    payloads are all responses.  A null payload counts as empty.  A row with a null
    page_id revisits the smallest page_id there is; payloads that only rows
    without page_id have can't be referred to, so these are responses.  A row
    that repeats page_id and payload is the same capture again and keeps its
    type (a record can't revisit itself).  Line ends within a url become %0D
    and %0A; a null url has no line.  Other columns are not written, whatever
    their names; an empty table gives archives without records."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    (with_revisits(rows, least).select(_record(date).alias("value")).write
     .option("lineSep", END + END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_archive).text(out))


# -- normalising

def inflate(data: bytes) -> Iterator[bytes]:
    """Contents of a gzip file of any number of members, in pieces of at most STEP bytes."""
    stream, fed, more = zlib.decompressobj(31), False, False
    for at in range(0, len(data), STEP):
        piece = data[at: at + STEP]
        while piece or more:
            out, fed = stream.decompress(piece, STEP), True
            if out:
                yield out
            if stream.eof:
                piece, stream, fed, more = stream.unused_data, zlib.decompressobj(31), False, False
            else:
                piece, more = stream.unconsumed_tail, len(out) == STEP
    if fed:
        raise ValueError("a gzip stream ends within a member")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, each with the two line ends after it."""
    have, at = bytearray(), 0
    for piece in pieces:
        have += piece
        while True:
            head = have.find(b"\r\n\r\n", at)
            if head < 0:
                break
            size = _fields(bytes(have[at:head])).get("content-length")
            if size is None:
                raise ValueError("a WARC record without Content-Length")
            end = head + 4 + int(size) + 4
            if end > len(have):
                break
            yield bytes(have[at:end])
            at = end
        if at > STEP:
            del have[:at]
            at = 0
    if at < len(have):
        raise ValueError("an archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's header, names in lower case."""
    lines = head.split(b"\r\n")
    if lines[0] != VERSION.encode():
        raise ValueError(f"not the start of a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(b":") for x in lines[1:])
    return {name.decode().lower(): value.removeprefix(b" ").decode("utf-8", "surrogateescape") for name, _, value in pairs}


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose header's 'sl' field holds its own and the record's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 24 + len(body) + 8
    return (struct.pack("<4BI2BH2BHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, ord("s"), ord("l"), 8, length, len(record))
            + body + struct.pack("<2I", zlib.crc32(record), len(record)))


def members(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of the members of a normalised archive, by their headers alone."""
    at = 0
    while at < len(data):
        if data[at: at + len(BETWEEN)] == BETWEEN:
            at += len(BETWEEN)
            continue
        if data[at: at + 4] != b"\x1f\x8b\x08\x04" or data[at + 12: at + 16] != b"sl\x08\x00":
            raise ValueError(f"no normalised record at {at}")
        length, = struct.unpack_from("<I", data, at + 16)
        yield at, length
        at += length


def _batched(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    have, held = [], 0
    for row in rows:
        have.append(row)
        held += weigh(row)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*have), schema)], schema=schema)
            have, held = [], 0
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*have), schema)], schema=schema)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("file")[i].as_py(), batch.column("content")[i].as_py()


def normalise(spark: SparkSession, source: str, out: str, level: int = 6) -> None:
    """Rewrite the archives under ``source``, whole-file streams or not, as
    ``out/archive`` with a gzip member per record, and write the sidecar index
    ``out/index``.  Every stream is inflated once and record by record.  Damaged
    archives raise ValueError; archives without records are left out."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((member(r, level),) for _, data in _contents(batches) for r in split_records(inflate(data)))
        yield from _batched(rows, pa.schema([("member", pa.binary())]), lambda row: len(row[0]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((file, at, length, *_described(_head(data, at, length)))
                for file, data in _contents(batches) for at, length in members(data))
        yield from _batched(rows, pa.schema([
            ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
            ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]), lambda row: 256 + len(row[4] or ""))

    (_files(spark, source).mapInArrow(rewrite, "member binary")
     .select(F.col("member").cast("string").alias("value")).write
     .option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{out}/archive"))
    _files(spark, f"{out}/archive").mapInArrow(index, INDEX_SCHEMA).write.parquet(f"{out}/index")


# -- reading

def _head(data: bytes, at: int, length: int) -> bytes:
    """The WARC and HTTP headers of a member; no more than they need is inflated."""
    stream, have = zlib.decompressobj(31), b""
    piece = data[at: at + length]
    while have.count(b"\r\n\r\n") < 2:
        out = stream.decompress(piece, 1024)
        if not out and (stream.eof or not piece):
            raise ValueError("a record without its two headers")
        have, piece = have + out, stream.unconsumed_tail
    return have


def _page(name: str | None) -> int | None:
    page = name.split(":")[2] if name else "-"
    return None if page == "-" else int(page)


def _described(record: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes of a record's headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(rest.partition(b"\r\n\r\n")[0].rpartition(b": ")[2])
    url = fields.get("warc-target-uri")
    return (_page(fields["warc-record-id"]), url and url.encode("utf-8", "surrogateescape").decode("utf-8", "replace"),
            fields["warc-type"], _page(fields.get("warc-refers-to")),
            fields["warc-payload-digest"].removeprefix("sha256:"), size)


def _read(record: bytes) -> tuple:
    """A row of RECORD_SCHEMA; a payload that doesn't fit its digest raises ValueError."""
    row = _described(record)
    if row[2] == REVISIT:
        return (*row, None)
    payload = record.split(b"\r\n\r\n", 2)[2][:-4]
    if len(payload) != row[5] or hashlib.sha256(payload).hexdigest() != row[4]:
        raise ValueError(f"the payload of page {row[0]} isn't the one that was written")
    return (*row, payload)


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                      ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                      ("payload", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives that ``normalise`` wrote under ``path``: page_id, url,
    record_type, refers_to, payload_digest, payload_bytes (both of the full
    payload, also for revisits) and payload (null for revisits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_read(zlib.decompress(data[at: at + length], 31))
                for _, data in _contents(batches) for at, length in members(data))
        yield from _batched(rows, _RECORDS, lambda row: 256 + len(row[6] or b""))

    return _files(spark, f"{path}/archive").mapInArrow(run, RECORD_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index: a row per record with its file, offset and length."""
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, page_ids: list[int]) -> DataFrame:
    """Records of some pages, as ``read_records`` gives them: the index names
    archives, offsets and lengths, only these members are inflated."""
    places = read_index(spark, path).where(F.col("page_id").isin(page_ids)).groupBy("file").agg(
        F.collect_list(F.struct("offset", "length")).alias("places"))
    wanted = {r.file: [(p.offset, p.length) for p in r.places] for r in places.collect()}  # as many as were asked for
    if not wanted:
        return spark.createDataFrame([], RECORD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_read(zlib.decompress(data[at: at + length], 31))
                for file, data in _contents(batches) for at, length in wanted[file])
        yield from _batched(rows, _RECORDS, lambda row: 256 + len(row[6] or b""))

    return _files(spark, [f"{path}/archive/{file}" for file in wanted]).mapInArrow(run, RECORD_SCHEMA)
