"""Quality rules: statistics of each document, hard limits on two of them, and gradient-boosted trees over
all of them as the verdict on the rest.

The statistics are computed once, in one pass over whole texts, and written; the trees are fitted on a
bounded sample of labelled rows (TRAIN_ROWS, chosen by a hash of doc_id) and scored in numpy over flat
node arrays. Monotonic features: more symbols per word, more repeated lines and more repeated words never
raise the score.

Defined cases: null text has no words and fails the base; labels that are null are left out, of
repeated labels of one doc_id the largest counts; without usable labels the base alone decides; repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import boosting
from emberline.llm.common import cut, text_or_empty

#: At most so many labelled rows are used for fitting.
TRAIN_ROWS = 12_000
#: A document is dropped by the trees only if they think it good with less than this probability.
KEEP_AT = 0.3
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_alpha", "n_ends", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{k} long" for k in STATS + MORE)
FEATURES = ("log_words", "mean_word", "symbol_ratio", "dup_lines", "repeat_words", "upper", "digits", "alpha", "ends", "distinct", "line_words")
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0)

_class = np.zeros((3, 256), np.int64)
for _k, _bytes in enumerate((range(65, 91), range(48, 58), [*range(65, 91), *range(97, 123), *range(128, 256)])):
    _class[_k, list(_bytes)] = 1


def repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) < 2_000_000:
        key = (a[:-2] * len(ids) + a[1:-1]) * len(ids) + a[2:]
    else:  # the product of three would overflow
        key = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)[1] * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(n, bool)
    for k in range(3):
        held[k : k + len(key)] |= twice
    return int(held.sum())


def statistics(data: bytes) -> tuple[int, ...]:
    """STATS and MORE of a text in UTF-8."""
    words = data.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(count[128:192].sum())
    upper, digits, alpha = (_class @ count).tolist()
    return (
        len(words), points - int(count[list(WHITE)].sum()), int(count[list(SYMBOLS)].sum()), dup, repeated_words(words),
        lines, upper, digits, alpha, int(count[list(b".!?,;:")].sum()), len(set(words)),
    )


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *STATS, *MORE]
    for batch in batches:
        rows = np.array([statistics(b) for b in batch.column(1).to_pylist()], np.int64).reshape(-1, len(names) - 1)
        yield pa.record_batch([batch.column(0), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names=names)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).cast("binary").alias("text")).mapInArrow(_measure, SCHEMA)


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES from columns STATS + MORE."""
    s = stats.astype(float)
    n, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.stack([np.log1p(s[:, 0]), s[:, 1] / n, s[:, 2] / n, s[:, 3] / lines, s[:, 4] / n, s[:, 6] / chars, s[:, 7] / chars, s[:, 8] / chars, s[:, 9] / n, s[:, 10] / n, s[:, 0] / lines], 1)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> boosting.Forest:
    """Trees fitted on at most `rows` labelled rows of measured."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_doc_id")).agg(F.max(label).cast("int").alias("l_label"))
    few = told.orderBy(F.xxhash64("l_doc_id"), "l_doc_id").limit(rows)
    got = measured.join(few, measured["doc_id"] == few["l_doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id", *STATS, *MORE).limit(rows).select(*STATS, *MORE, "l_label").toPandas().to_numpy()
    if not len(got):
        return boosting.train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return boosting.train(features(got[:, :-1]), got[:, -1].astype(float), np.array(MONOTONE))


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, STATS, base_failed, kept and score for every row of docs."""
    measured = cut(measure(docs, text), "quality")
    forest = fit(measured, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    plain = len(forest.roots) == 0

    def run(batches):
        for batch in batches:
            stats = np.stack([batch.column(k + 1).to_numpy() for k in range(len(STATS + MORE))], 1) if batch.num_rows else np.zeros((0, len(STATS + MORE)), np.int64)
            score = shared.value.score(features(stats))
            failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
            kept = ~failed & ((score >= keep_at) | plain)
            yield pa.record_batch([*batch.columns[: 1 + len(STATS)], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *STATS, "base_failed", "kept", "score"])

    return measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, kept boolean, score double")
