"""Exact deduplication over a cuckoo-filter index of live digests.

A text's key is the SHA-256 of its white-space-normalised UTF-8 form. CuckooIndex guards a set of
stored keys: the filter answers most misses, a hit is verified against the stored keys of its bucket,
deleting a key takes its fingerprint out again, and a table that overflows is rebuilt at twice the size
from the stored keys. On a cluster each input partition collapses its own copies with such an index,
so a hot text crosses the shuffle once per input partition, and one index per hash partition of the
digests merges these.

Defined cases: null text is the empty text, and empty texts equal one another; a null doc_id never
stays where its group has a doc_id; repeated rows of one doc_id and text share one verdict and count
as rows of the group; texts of any length are digested whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import SPACES, cut, text_or_empty

GROUPS = "digest binary, keep_id long, copies long"
#: An index passes on what it holds and starts again beyond so many keys: memory stays bounded, and merging is associative.
FLUSH_KEYS = 200_000
#: Digests of a hash partition, about: an index that merges holds 300 bytes a key, and twice that while it is rebuilt.
PARTITION_KEYS = 500_000


class CuckooIndex:
    """Live digests with an entry [smallest id or None, copies] each, behind a cuckoo filter."""

    SLOTS, KICKS = 4, 64

    def __init__(self, buckets: int = 256):
        self._start(1 << max(1, (buckets - 1).bit_length()))

    def _start(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * buckets * self.SLOTS))
        self.content: list[dict | None] = [None] * buckets
        self.keys = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, bucket: int, mark: int) -> int:
        """Where mark is in bucket, -1 if it isn't."""
        at = bucket * self.SLOTS
        for k in range(at, at + self.SLOTS):
            if self.table[k] == mark:
                return k
        return -1

    def get(self, digest: bytes) -> list | None:
        mark, first, second = self._places(digest)
        if self._slot(first, mark) < 0 and self._slot(second, mark) < 0:
            return None
        bucket = self.content[first]
        return bucket.get(digest) if bucket else None

    def insert(self, digest: bytes, doc_id: int | None, copies: int = 1) -> bool:
        """Adds copies of a digest; True if the digest is new."""
        if (entry := self.get(digest)) is not None:
            if doc_id is not None and (entry[0] is None or doc_id < entry[0]):
                entry[0] = doc_id
            entry[1] += copies
            return False
        self._store(digest, [doc_id, copies])
        return True

    def _store(self, digest: bytes, entry: list) -> None:
        mark, first, second = self._places(digest)
        if self.content[first] is None:
            self.content[first] = {}
        self.content[first][digest] = entry
        self.keys += 1
        if not self._place(mark, first, second):
            self._resize()

    def _place(self, mark: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            if (k := self._slot(bucket, 0)) >= 0:
                self.table[k] = mark
                return True
        bucket = second
        for turn in range(self.KICKS):
            k = bucket * self.SLOTS + turn % self.SLOTS
            mark, self.table[k] = self.table[k], mark
            bucket = self._other(bucket, mark)
            if (k := self._slot(bucket, 0)) >= 0:
                self.table[k] = mark
                return True
        return False

    def _resize(self) -> None:
        """Rebuilds the filter at twice the size, or more, from the stored keys."""
        stored, buckets = list(self.items()), self.mask + 1
        while True:
            buckets *= 2
            self._start(buckets)
            for digest, entry in stored:
                mark, first, second = self._places(digest)
                if not self._place(mark, first, second):
                    break
                if self.content[first] is None:
                    self.content[first] = {}
                self.content[first][digest] = entry
                self.keys += 1
            else:
                return

    def delete(self, digest: bytes, copies: int | None = None) -> bool:
        """Takes copies of a digest out (all of them by default); True if the digest is no longer live."""
        if (entry := self.get(digest)) is None:
            return False
        entry[1] -= entry[1] if copies is None else copies
        if entry[1] > 0:
            return False
        mark, first, second = self._places(digest)
        k = self._slot(first, mark)
        self.table[k if k >= 0 else self._slot(second, mark)] = 0
        del self.content[first][digest]
        self.keys -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content:
            if bucket:
                yield from bucket.items()

    def __len__(self) -> int:
        return self.keys


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.record_batch(
            [pa.array([d for d, _ in part], pa.binary()), pa.array([e[0] for _, e in part], pa.int64()), pa.array([e[1] for _, e in part], pa.int64())],
            names=["digest", "keep_id", "copies"],
        )


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            index.insert(digest, doc_id)
        if len(index) > FLUSH_KEYS:
            yield from _emit(index)
            index = CuckooIndex()
    yield from _emit(index)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            index.insert(digest, keep, copies)
    yield from _emit(index)


def digest_table(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id and digest (and `row`) of each row; runs in the JVM."""
    return docs.select(*([row] if row else []), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text_or_empty(docs, text), SPACES, " "), 256)).alias("digest"))


def _dealt(rows: DataFrame, keys: int) -> DataFrame:
    """rows by hash of digest, in partitions of about PARTITION_KEYS of the `keys` digests at most."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-keys // PARTITION_KEYS)), "digest")


def group_index(digests: DataFrame) -> DataFrame:
    """One row per live digest: digest, keep_id, copies. digests is read twice, to be counted first."""
    return _dealt(digests.select("digest", "doc_id").mapInArrow(_collapse, GROUPS), digests.count()).mapInArrow(_merge, GROUPS)


def exact_dedup(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs; and its column `row`, if there is one."""
    digests = cut(digest_table(docs, text, row), "digests")
    groups = group_index(digests).where("copies > 1").toDF("g_digest", "g_keep", "g_copies")
    joined = digests.join(groups, digests["digest"] == groups["g_digest"], "left")
    # a digest without a row in groups stands alone; g_keep may be null for a group without ids
    keep = F.when(F.col("g_digest").isNull(), F.col("doc_id")).otherwise(F.col("g_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("g_copies", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([row] if row else []),
    )


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, doc_id, copies, gone) of one hash partition: all inserts, then all deletions."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, keep, copies, out in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if out:
                gone.append((digest, copies))
            else:
                index.insert(digest, keep, copies)
    for digest, copies in gone:
        index.delete(digest, copies)
    yield from _emit(index)


def update_index(index: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """The index table after further rows (added: digest, keep_id, copies) and deletions (deleted: digest, copies, null copies
    for all). Digests without copies left are gone, so a later equal text is new again. live (digest, doc_id) are the rows
    that are there afterwards; it is needed with deletions, since keep_id of a digest that lost copies is counted anew from
    them: it is always the smallest id of a row that is still there."""
    if deleted is not None and live is None:
        raise ValueError("after deletions keep_id comes from the rows that are left: give live")
    rows = index.select("digest", "keep_id", "copies", F.lit(False).alias("gone"))
    if added is not None:
        rows = rows.unionByName(added.select("digest", "keep_id", "copies", F.lit(False).alias("gone")))
    keys = rows.count()
    if deleted is not None:
        rows = rows.unionByName(deleted.select("digest", F.lit(None).cast("long").alias("keep_id"), F.col("copies").cast("long"), F.lit(True).alias("gone")))
    left = _dealt(rows, keys).mapInArrow(_apply, GROUPS)
    if deleted is None:
        return left
    touched = deleted.select(F.col("digest").alias("t_digest")).distinct()
    low = live.join(touched, live["digest"] == touched["t_digest"], "left_semi").groupBy("digest").agg(F.min("doc_id").alias("low")).select(F.col("digest").alias("l_digest"), "low", F.lit(True).alias("recount"))
    joined = left.join(low, left["digest"] == low["l_digest"], "left")
    return joined.select("digest", F.when(F.col("recount"), F.col("low")).otherwise(F.col("keep_id")).alias("keep_id"), "copies")
