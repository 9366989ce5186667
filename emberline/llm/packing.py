"""Best-fit packing of documents into sequences by exact-complement hashing.

What must be known in one place is only how many pieces there are of each length, LIMIT numbers whatever the
input's size. plan() packs these counts: the longest length left opens a sequence, and its gap is filled exactly
by one length, by a pair or by a triple, looked up by the gap in an index of the sums that the lengths left make (Sums);
what is used is taken out of the index, and a pattern is repeated as often as the counts allow. Where nothing fits exactly,
the longest length that fits is put in (best fit) and the rest of the gap is looked up again. The plan is a list of patterns with multiplicities; turned around, it says for the r-th piece of a
length in which sequence and where it goes. Pieces get their rank within their length from counts per input
partition and length and prefix sums over these, so no length's pieces ever meet in one task.

Defined cases: null text is empty and one piece of the end id; a null doc_id is kept; repeated rows are
packed each; of combinations that fill a gap the one with the longest part is taken, singles before pairs before triples; a text of any
length is cut into pieces, as many as it needs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import wordbpe
from emberline.llm.common import cut, text_or_empty, thrifty

LIMIT = 4096


@dataclass
class Plan:
    """patterns: (times, first sequence, [(length, how often), ...] in order of place)."""

    patterns: list[tuple[int, int, list[tuple[int, int]]]]
    sequences: int


class Sums:
    """An index of the sums that single lengths, pairs and triples of them make, under the counts of what is left.

    left[t], pairs[t] and triples[t] say, addressed by the sum t, how many pieces, different pairs and different triples of
    lengths make it; a length counts twice or thrice in one combination only if as many pieces of it are left. When a length
    runs out (or falls to one or two pieces), the sums that it was part of are taken out, each table in one vector step.
    A sum's combination is remembered with its longest part; since lengths only ever run out, the search for the next one
    goes on below it, and is made only where the index says that there is one."""

    def __init__(self, counts: np.ndarray):
        self.limit = len(counts) - 1
        self.left = np.zeros(self.limit + 1, np.int64)
        self.pairs, self.triples = np.zeros((2, 3 * self.limit + 1), np.int64)
        for n in np.flatnonzero(counts).tolist():
            for level in (1, 2, 3)[: int(min(counts[n], 3))]:
                self._count(n, level, 1)
            self.left[n] = counts[n]
        # the longest part of the combination last found for each sum
        self.pair_at, self.triple_at = np.full((2, 3 * self.limit + 1), self.limit)

    def _others(self, n: int) -> np.ndarray:
        there = self.left > 0
        there[n] = False
        return there

    def _count(self, n: int, level: int, sign: int) -> None:
        """Adds (sign 1) or takes out (-1) the sums that need `level` pieces of length n, and no more."""
        top = self.limit + 1
        if level == 1:
            if sign < 0:  # pairs are to be those without n
                self.pairs[n : n + top] -= self._others(n)
            self.triples[n:] += sign * self.pairs[: len(self.pairs) - n]
            if sign > 0:
                self.pairs[n : n + top] += self._others(n)
        elif level == 2:
            self.pairs[2 * n] += sign
            self.triples[2 * n : 2 * n + top] += sign * self._others(n)
        else:
            self.triples[3 * n] += sign

    def take(self, n: int, times: int = 1) -> None:
        """Uses up pieces of length n."""
        before, after = int(self.left[n]), int(self.left[n]) - times
        if after < 0:
            raise ValueError(f"no piece of length {n} is left")
        for level in (3, 2, 1):
            if before >= level > after:
                self._count(n, level, -1)
        self.left[n] = after

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The pair with the longest part of at most `most`."""
        a = np.arange(min(most, total - 1), max((total - 1) // 2, total - self.limit - 1), -1)
        ok = (self.left[a] > 0) & (self.left[total - a] > (a == total - a))
        k = int(np.argmax(ok)) if len(a) else 0
        return (int(a[k]), int(total - a[k])) if len(a) and ok[k] else None

    def pair(self, total: int) -> tuple[int, int] | None:
        if not self.pairs[total]:
            return None
        found = self._pair(total, int(self.pair_at[total]))
        self.pair_at[total] = found[0]
        return found

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if not self.triples[total]:
            return None
        longest = np.flatnonzero(self.left[: min(int(self.triple_at[total]), total - 2) + 1])
        for a in longest[(longest * 3 >= total) & (self.pairs[total - longest] > 0)][::-1].tolist():
            self.left[a] -= 1
            rest = self._pair(total - a, a)
            self.left[a] += 1
            if rest:
                self.triple_at[total] = a
                return (a, *rest)
        raise AssertionError(f"the index has a triple of {total} that isn't there")

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One length, a pair or a triple that fills the gap."""
        if self.left[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def best(self, gap: int) -> int:
        """The longest length left of at most gap, 0 if there is none."""
        fits = np.flatnonzero(self.left[1 : gap + 1])
        return int(fits[-1]) + 1 if len(fits) else 0


def plan(counts: np.ndarray, limit: int = LIMIT) -> Plan:
    """counts[n]: how many pieces have length n, 1 <= n <= limit."""
    counts = np.asarray(counts, np.int64)
    if len(counts) != limit + 1 or counts[0] or (counts < 0).any():
        raise ValueError("counts go from 0 to limit, and no piece is empty")
    sums, patterns, first = Sums(counts), [], 0
    left, top = sums.left, limit
    while True:
        held = np.flatnonzero(left[: top + 1])
        if not len(held):
            return Plan(patterns, first)
        top = int(held[-1])
        parts, gap = [top], limit - top
        sums.take(top)
        while gap:
            more = sums.exact(gap)
            if more is None:
                more = (sums.best(gap),)
                if not more[0]:
                    break
            for n in more:
                sums.take(n)
            parts += more
            gap -= sum(more)
        need: dict[int, int] = {}
        for n in parts:
            need[n] = need.get(n, 0) + 1
        # the same pattern again, as often as the counts allow
        more_times = int(min(left[n] // k for n, k in need.items()))
        if more_times:
            for n, k in need.items():
                sums.take(n, k * more_times)
        patterns.append((1 + more_times, first, list(need.items())))
        first += 1 + more_times


def places(plan: Plan, limit: int = LIMIT) -> tuple[np.ndarray, ...]:
    """Segments sorted by (length, first rank): key, times, per sequence, first sequence, place. The key of rank r
    of length n is n * 2**40 + r."""
    seen = np.zeros(limit + 1, np.int64)
    rows = []
    for times, first, parts in plan.patterns:
        at = 0
        for n, k in parts:
            rows.append((n << 40 | int(seen[n]), k, first, at))
            seen[n] += times * k
            at += n * k
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def assign(lengths: np.ndarray, ranks: np.ndarray, segments: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    keys, each, first, at = segments
    key = lengths << 40 | ranks
    k = np.searchsorted(keys, key, side="right") - 1
    within = key - keys[k]
    return first[k] + within // each[k], at[k] + within % each[k] * lengths


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """The pieces of docs; part is the task that made a piece, nth counts its earlier pieces of that length."""
    path = path or wordbpe.default_path()
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = wordbpe.coder(path), TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = wordbpe.wide(code.encode(data.as_py()), code.kind)
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at : at + 4 * limit]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return items.mapInArrow(thrifty(run), PIECES)


def pack(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, text, limit, path), "pieces")  # written once: part and nth never change
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for n, k in pieces.groupBy("length").agg(F.count("*")).collect():  # limit rows at most
        counts[n] = k
    segments = spark.sparkContext.broadcast(places(plan(counts, limit), limit))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.withColumn("base", F.coalesce(before, F.lit(0).cast("long"))).select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), "base")
    ranked = pieces.join(bases, (pieces["length"] == bases["b_length"]) & (pieces["part"] == bases["b_part"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = assign(batch.column(3).to_numpy(), batch.column(5).to_numpy(), segments.value)
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
