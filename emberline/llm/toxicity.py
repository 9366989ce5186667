"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (ORDERS) of the lower-cased, white-space-folded text, hashed into
BUCKETS numbers. Over the training rows the documents with each number are counted by class in a grouped
aggregation; r = log((n1 + a) / N1) - log((n0 + a) / N0) is its log-count ratio. The numbers whose counts are
furthest from chance stay (all with a G statistic of SELECT_AT or more, at least LEAST_SELECTED), scaled by r, and a logistic
regression with an L2 penalty is fitted over them, the classes weighing the same.

The classifier is fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of doc_id. Only the text of a
document is an input of its score; held-out rows (crc32 of doc_id as text, mod 3, is 1) teach nothing.

Defined cases: null text is empty, its score is that of no feature; null labels teach nothing, of repeated labels
of one doc_id the largest counts; without labels of both classes every score is the smoothed share of class 1; a row with null
doc_id is not held out and teaches nothing; repeated rows are scored each; texts of any length are scored as a whole; of equal
evidence the smaller number comes first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, text_or_empty

TRAIN_ROWS = 12_000
BUCKETS = 1 << 20
ORDERS = (4, 6, 7)
LEAST_SELECTED, SELECT_AT = 64, 16.0
#: Rows of a block of the regression.
BLOCK = 1_000
LEAST_DOCS = 3
PREDICT_AT = 0.7
CHUNK = 1 << 20
#: Chosen, with the balance of the classes, by cross-validation over the training rows of sf 0.1.
L2 = 1e-3

_fold = np.arange(128, dtype=np.uint32)
_fold[:33] = 32
for _c in b".,;:!?\"'()[]":
    _fold[_c] = 32


def windows(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, repeats included, in pieces of bounded size; capitals, white space and common punctuation are
    folded. The last characters of a stretch are kept for the next one, so stretches change nothing."""
    low, most = f" {text.lower()} ", max(ORDERS) - 1
    kept = np.zeros(0, np.uint32)
    for at in range(0, len(low), CHUNK):
        b = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        b = np.where(b < 128, _fold[np.minimum(b, 127)], b)
        b = b[~((b == 32) & np.r_[len(kept) > 0 and kept[-1] == 32, b[:-1] == 32])]
        x = np.concatenate([kept, b])
        for n in ORDERS:
            own = x[max(0, len(kept) - n + 1) :]
            if len(own) >= n:
                h = np.zeros(len(own) - n + 1, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) ^ own[k : len(own) - n + 1 + k]
                h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n)
                yield (h ^ h >> np.uint32(13)) & np.uint32(BUCKETS - 1)
        kept = x[-most:]


def numbers(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *windows(text)])


def presence(text: str) -> np.ndarray:
    """The distinct numbers of a text."""
    if len(text) <= CHUNK:
        return np.unique(numbers(text))
    there = np.zeros(BUCKETS, bool)
    for x in windows(text):
        there[x] = True
    return np.flatnonzero(there).astype(np.uint32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[label, presence(data)] += 1
    at = np.flatnonzero(n.sum(0))
    if len(at):
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["number", "n0", "n1"])


def evidence(k1: Column, k0: Column, n1: int, n0: int) -> Column:
    """The G statistic of a number's documents by class: chance alone gives about 1, rarely over 20."""
    share = n1 / (n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((k1 + k0) * p))).otherwise(0.0)
    return 2 * (part(k1, share) + part(k0, 1 - share))


@dataclass
class Model:
    """table: number to position in weight, or -1."""

    table: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, data: str) -> float:
        chosen = [np.unique(k[k >= 0]) for k in map(self.table.__getitem__, windows(data))]
        k = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, int)
        z = self.bias + self.weight[k].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def regress(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float = L2, steps: int = 250, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights (scale included) and bias of a logistic regression; rows hold each row's features. Adam on all rows, which
    weigh the same in total for either class."""
    blocks, ones = [], y.sum()
    weigh = np.where(y == 1, 0.5 / max(ones, 1), 0.5 / max(len(y) - ones, 1))
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        blocks.append((np.concatenate(part).astype(np.int32), np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part]), y[at : at + BLOCK], weigh[at : at + BLOCK]))
    bias = 0.0
    w = np.zeros(len(scale) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = np.append(l2 * w[:-1], 0.0)
        sw = scale * w[:-1]
        for flat, owner, told, share in blocks:
            z = bias + w[-1] + np.bincount(owner, sw[flat], minlength=len(told))
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - told) * share
            g[:-1] += scale * np.bincount(flat, d[owner], minlength=len(scale))
            g[-1] += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return scale * w[:-1], bias + w[-1]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out(F.col("doc_id")))
    few = told.groupBy(F.col("doc_id").cast("long").alias("f_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("f_id"), "f_id").limit(rows)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    # few is at most `rows` pairs of numbers: it may be broadcast
    sample = cut(items.join(F.broadcast(few), items["doc_id"] == few["f_id"]).select("doc_id", "label", "text"), "toxicity")
    sizes = dict(sample.groupBy("label").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    none = Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    if not n0 or not n1:
        return none
    counted = sample.select("label", "text").mapInArrow(_count, "number int, n0 long, n1 long").groupBy("number").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    judged = cut(counted.withColumn("g", F.round(evidence(F.col("n1"), F.col("n0"), n1, n0), 6)), "toxicity-counts")
    # at most BUCKETS rows of four numbers
    best = judged.where(F.col("g") >= SELECT_AT).orderBy(F.desc("g"), "number").toPandas()
    if len(best) < LEAST_SELECTED:
        best = judged.orderBy(F.desc("g"), "number").limit(LEAST_SELECTED).toPandas()
    r = np.log((best["n1"].to_numpy() + 0.5) / (n1 + 1)) - np.log((best["n0"].to_numpy() + 0.5) / (n0 + 1))
    if not len(best):
        return none
    table = np.full(BUCKETS, -1, np.int32)
    table[best["number"].to_numpy()] = np.arange(len(best))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value[presence(data)] for data in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([k[k >= 0].astype("<i4").tobytes() for k in found], pa.binary()), batch.column(2)], names=["label", "found", "doc_id"])

    # at most `rows` rows (and repeats of theirs) of the numbers chosen
    data = sample.select("label", "text", "doc_id").mapInArrow(chosen, "label int, found binary, doc_id long").orderBy(F.xxhash64("doc_id"), "found").limit(rows).toPandas()
    weight, bias = regress([np.frombuffer(x, "<i4") for x in data["found"]], data["label"].to_numpy().astype(float), r)
    return Model(table, weight, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([shared.value.score(x) for x in batch.column(2).to_pylist()], float)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty(docs, text).alias("text"))
    return items.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
