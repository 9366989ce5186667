"""Zstandard WARC archives: a writer and a reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then follows one
Zstandard frame per record. The reader loads the dictionary, finds each frame's end from its block headers,
decodes one frame at a time and validates what it finds: version line, mandatory headers, Content-Length
against the block, the closing line breaks, the inner Content-Length against the payload, and payload
digests. A record that fails raises BadRecord with archive and offset.

Of pages with equal payloads of at least LEAST_BYTES the smallest page_id is written as response, the others
as revisits with headers only; that is decided by digests before the write, aggregated before they are
shuffled. Archives roll at ROLL_BYTES, so that writer and reader hold one archive in memory at most. Their
names carry the task attempt, and only those of committed tasks are listed and read.

Defined cases: null html is an empty payload; a null page_id never stays where its group has a page_id, and
is read back as null; repeated rows of the smallest page_id are all responses; null addresses are left out;
an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import cut, local_form, put_file, shared_path

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
LEAST_BYTES = 100
ROLL_BYTES = 16 << 20
DICT_BYTES, DICT_PAGES, DICT_PAGE_BYTES = 64 << 10, 300, 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: Records decode to at most so many bytes.
MOST_BYTES = 1 << 30
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """What the reader found isn't a valid archive or record."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICT_BYTES; too few samples to train on are its content as they are."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 20 else b"".join(samples)[:DICT_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _uri(url: str) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {SAME}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def opening(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise BadRecord(f"no frame at {at}")
        flags = data[at + 4]
        single = flags >> 5 & 1
        p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            word = data[p] | data[p + 1] << 8 | data[p + 2] << 16
            last, kind, size = word & 1, word >> 1 & 3, word >> 3
            if kind == 3:
                raise BadRecord(f"reserved block in the frame at {at}")
            p += 3 + (1 if kind == 1 else size)
        p += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError) as e:
        raise BadRecord(f"the frame at {at} is cut off") from e
    if p > len(data):
        raise BadRecord(f"the frame at {at} is cut off")
    return p


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    offset: int


def _fields(lines: list[str], at: int) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"header without a name in the record at {at}: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes, at: int = 0) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord(f"no WARC version at {at}")
    headers = _fields(lines[1:], at)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise BadRecord(f"the record at {at} has no {need}")
    size = int(headers["content-length"]) if headers["content-length"].isdigit() else -1
    if len(rest) != size + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"the record at {at} says {headers['content-length']} bytes and has {len(rest) - 4}")
    block, http, payload = rest[:-4], {}, b""
    if headers["warc-type"] in ("response", "revisit"):
        first, gap, payload = block.partition(b"\r\n\r\n")
        said = first.decode("latin-1").split("\r\n")
        if not gap or not said[0].startswith("HTTP/"):
            raise BadRecord(f"the record at {at} has no HTTP header")
        http = _fields(said[1:], at)
        if headers["warc-type"] == "revisit":
            if payload or "warc-refers-to" not in headers:
                raise BadRecord(f"the revisit at {at} has a payload or refers to nothing")
        elif http.get("content-length") != str(len(payload)):
            raise BadRecord(f"the payload at {at} has {len(payload)} bytes, not {http.get('content-length')}")
        elif headers.get("warc-payload-digest", "").startswith("sha256:") and headers["warc-payload-digest"][7:] != hashlib.sha256(payload).hexdigest():
            raise BadRecord(f"the payload at {at} doesn't have its digest")
    return Record(headers, http, payload, at)


def _plain(reader: zstandard.ZstdDecompressor, frame: memoryview, at: int) -> bytes:
    """What a frame decodes to; frames of streaming writers don't say how much that is."""
    try:
        said = zstandard.frame_content_size(frame)
        if said > MOST_BYTES:
            raise BadRecord(f"the frame at {at} has {said} bytes, more than {MOST_BYTES}")
        if said > 0:
            return reader.decompress(frame)
        parts, size = [], 0
        with reader.stream_reader(frame) as stream:
            while part := stream.read(1 << 20):
                parts.append(part)
                size += len(part)
                if size > MOST_BYTES:
                    raise BadRecord(f"the frame at {at} has more than {MOST_BYTES} bytes")
        return b"".join(parts)
    except zstandard.ZstdError as e:
        raise BadRecord(f"the frame at {at} can't be decoded: {e}") from e


def _skippable_end(data: memoryview, at: int) -> int | None:
    """Where the skippable frame at `at` ends, None if there is none."""
    if len(data) < at + 8 or struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 != SKIPPABLE & 0xFFFFFFF0:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise BadRecord(f"the skippable frame at {at} is cut off")
    return end


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive, one frame decoded at a time. Skippable frames but the dictionary's are passed over."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = _skippable_end(data, 0)
        dictionary = bytes(data[8:at])
        if struct.unpack_from("<I", dictionary.ljust(4, b"\0"))[0] == FRAME:  # it may be compressed itself
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
    reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    while at < len(data):
        if (end := _skippable_end(data, at)) is None:
            end = frame_end(data, at)
            yield parse_record(_plain(reader, data[at:end], at), at)
        at = end


def get_file(uri: str) -> bytes:
    path = local_form(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(at) as f:
        return f.read()


MANIFEST = "archive string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) below folder; the manifest of the archives: archive, records, bytes."""
    spark = pages.sparkSession
    items = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    few = items.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(DICT_PAGES).withColumnRenamed("page_id", "f_id")
    sample = items.join(F.broadcast(few), items["page_id"] == few["f_id"]).select("page_id", F.substring("payload", 1, DICT_PAGE_BYTES).alias("payload"))  # DICT_PAGES numbers
    dictionary = spark.sparkContext.broadcast(train_dictionary([bytes(r[1]) for r in sorted(sample.limit(4 * DICT_PAGES).collect(), key=lambda r: (r[0], bytes(r[1])))]))
    marked = items.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.when(F.length("payload") >= LEAST_BYTES, F.col("digest")))
    firsts = marked.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("key").alias("f_key"), "first")
    told = marked.join(firsts, marked["key"] == firsts["f_key"], "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        known = dictionary.value
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}))
        made, held, size = [], [opening(known)], 0

        def close() -> None:
            nonlocal held, size
            if len(held) > 1:
                uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.warc.zst"
                made.append((uri, len(held) - 1, put_file(uri, held)))
            held, size = [opening(known)], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(packer.compress(make_record(*row)))
                size += len(held[-1])
                if size >= ROLL_BYTES:
                    close()
        close()
        if made:
            yield pa.record_batch([pa.array(c) for c in zip(*made, strict=True)], names=["archive", "records", "bytes"])

    return cut(told.mapInArrow(run, MANIFEST), "archives")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(r: Record):
        number = lambda v: None if v is None else int(v)
        return number(r.headers.get("x-page-id")), int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha256:"), r.headers["warc-type"], number(r.headers.get("x-refers-to-page"))

    for batch in batches:
        for uri, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [row(r) for r in read_archive(get_file(uri))]
            if len(rows) != records:
                raise BadRecord(f"{uri} has {len(rows)} records, not {records}")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's archives."""
    n = manifest.count()
    return manifest.select("archive", "records").repartition(max(1, min(n, 20_000))).mapInArrow(_read, ROWS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    spark: SparkSession = pages.sparkSession
    return read_archives(write_archives(pages, folder or shared_path(spark, "warc")))
