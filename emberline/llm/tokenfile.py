"""Token ids in flat binary files with 64-bit document offsets.

A data set is a folder of shards in ascending doc_id order, each of about SHARD_CHARS characters of text. A shard is two files: .bin, the ids of its
documents one after the other, unsigned 16-bit little-endian where the vocabulary allows it and 32-bit
otherwise; and .idx, the header MAGIC, version, bytes per id, number of documents, then that many doc_ids
(int64) and one more offset than that (int64, in ids, from 0). A shard's base, the number of ids in all earlier shards,
is a prefix sum over the shards' sizes. Documents are dealt to at most PARTITIONS tasks by ranges of doc_id before they are
encoded, so that no shard depends on another's size; a task writes as many shards as it needs, one after the other. Readers
map the files into memory.

Defined cases: null text is empty and has the end id only; a row with null doc_id comes first, and is read back
as null; repeated doc_ids are written each, ordered by text; a document is never divided, so a longer one makes a longer
shard; other columns are ignored; an empty table gives an empty data set.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import wordbpe
from emberline.llm.common import cut, local_form, put_file, shared_path, text_or_empty
from emberline.llm.warc import get_file

MAGIC, VERSION = b"EMBRTOK\0", 1
HEAD = struct.Struct("<8sIIQ")
NO_ID = np.iinfo(np.int64).min
#: Characters of text for a shard, roughly.
SHARD_CHARS = 24_000_000
PARTITIONS = 100_000
MANIFEST = "shard int, nth int, attempt long, docs long, tokens long"


def index_bytes(kind: np.dtype, ids: list[int | None], sizes: list[int]) -> bytes:
    offsets = np.zeros(len(ids) + 1, "<i8")
    np.cumsum(sizes, out=offsets[1:])
    return HEAD.pack(MAGIC, VERSION, kind.itemsize, len(ids)) + np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes() + offsets.tobytes()


def read_index(data: bytes) -> tuple[np.dtype, np.ndarray, np.ndarray]:
    magic, version, width, n = HEAD.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION) or width not in (2, 4) or len(data) != HEAD.size + 8 * (2 * n + 1):
        raise ValueError("not an index of this format")
    return np.dtype(f"<u{width}"), np.frombuffer(data, "<i8", n, HEAD.size), np.frombuffer(data, "<i8", n + 1, HEAD.size + 8 * n)


class Shard:
    """A shard mapped into memory (read whole where its store has no local files)."""

    def __init__(self, stem: str):
        self.kind, self.ids, self.offsets = read_index(get_file(f"{stem}.idx"))
        path, self._map = local_form(f"{stem}.bin"), None
        if path is None:
            data = get_file(f"{stem}.bin")
        elif self.offsets[-1]:
            with open(path, "rb") as f:
                data = self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            data = b""
        self.tokens = np.frombuffer(data, self.kind)
        if len(self.tokens) != self.offsets[-1]:
            raise ValueError(f"{stem}.bin has {len(self.tokens)} ids, its index says {self.offsets[-1]}")

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]


def write_tokens(docs: DataFrame, folder: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Writes docs below folder; the manifest of its shards: shard, attempt, docs, tokens."""
    path = path or wordbpe.default_path()
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    ordered = items.repartitionByRange(int(min(PARTITIONS, size // SHARD_CHARS + 1)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = ordered.select("doc_id", F.length("text").alias("chars"), F.col("text").cast("binary").alias("text"))
    most = SHARD_CHARS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get(), wordbpe.coder(path)
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
        nth, row = 0, next(rows, None)
        while row is not None:
            ids: list[int | None] = []
            sizes: list[int] = []

            def stream(ids=ids, sizes=sizes):
                nonlocal row
                chars = 0
                while row is not None and (not ids or chars + row[1] <= 2 * most):
                    ids.append(row[0])
                    chars += row[1]
                    got = code.encode(row[2].as_py())
                    sizes.append(len(got) // code.kind.itemsize)
                    row = next(rows, None)
                    yield got

            stem = f"{folder}/{task.partitionId():06d}-{nth:05d}-{task.taskAttemptId()}"
            put_file(f"{stem}.bin", stream())
            put_file(f"{stem}.idx", [index_bytes(code.kind, ids, sizes)])
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([nth], pa.int32()), pa.array([task.taskAttemptId()]), pa.array([len(ids)]), pa.array([sum(sizes)], pa.int64())], names=["shard", "nth", "attempt", "docs", "tokens"])
            nth += 1

    return cut(ordered.mapInArrow(run, MANIFEST), "shards")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest and each shard's base. There is one short row per shard, so they are ordered in one task."""
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the data set: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, nth, attempt, docs, base in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                shard = Shard(f"{folder}/{number:06d}-{nth:05d}-{attempt}")
                if len(shard) != docs:
                    raise ValueError(f"shard {number}-{nth} has {len(shard)} documents, not {docs}")
                crcs = np.fromiter((zlib.crc32(shard[k].astype("<u4").tobytes()) for k in range(docs)), np.int64, docs)
                yield pa.record_batch([pa.array(shard.ids, mask=shard.ids == NO_ID), pa.array(shard.offsets[:-1] + base), pa.array(np.diff(shard.offsets)), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    return with_bases(manifest).select("shard", "nth", "attempt", "docs", "base").repartition(max(1, min(n, 20_000))).mapInArrow(run, ROWS)


def round_trip(docs: DataFrame, folder: str | None = None, text: str = "text", path: str | None = None) -> DataFrame:
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, text, path), folder)
