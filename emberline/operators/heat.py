"""Heat diffusion over a weighted, undirected graph.

The field is exp(-t (I - D^-1/2 W D^-1/2)) s as a Chebyshev series in M = -D^-1/2 W D^-1/2. Each order is one
sparse matrix-vector product: a join on the column and a sum by row. A graph of at most KERNEL_ENTRIES stored
entries, which is counted first, is run in one numpy task; a larger one by joins, with each order's vector written
to the shared folder, so that plans stay short and no executor's loss undoes the work. Either way every node of the graph
and every seed has a row. Vectors keeps what it has made: a later time combines it anew, and a higher order goes on from
its last two vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.kernel import choose_order, coefficient
from emberline.sources.lineage import Steps, cut

KERNEL_ENTRIES = 2_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """i, j, w in both directions: the largest weight of parallel edges, no loops. edges: a, b, w."""
    best = edges.where("a <> b").groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.max("w").alias("w"))
    return best.unionByName(best.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("i").agg(F.sum("w").alias("d"))


def scaled(adj: DataFrame) -> DataFrame:
    """Entries of M: i, j, m."""
    d = degrees(adj)
    x = adj.join(d.toDF("d_i", "di"), F.col("i") == F.col("d_i")).join(d.toDF("d_j", "dj"), F.col("j") == F.col("d_j"))
    return x.select("i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("m"))


def multiply(m: DataFrame, x: DataFrame) -> DataFrame:
    """M x. m: i, j, m; x: i, v."""
    return m.join(x.toDF("x_i", "v"), F.col("j") == F.col("x_i")).groupBy("i").agg(F.sum(F.col("m") * F.col("v")).alias("v"))


def _kernel(first: int, order: int, weights: list[float] | None):
    """One task: rows (i, j, w, k) that are entries of the adjacency (k is null) or numbers of the vectors first - 2 and
    first - 1 (or, if first is 0, of the seeds). Yields the orders from `first` on, or the field if there are weights."""

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        i, v = table["i"].to_numpy(), table["w"].to_numpy()
        given = np.asarray(table["k"].is_valid())
        j, step = table["j"].fill_null(0).to_numpy(), table["k"].fill_null(-1).to_numpy()
        nodes = np.unique(np.concatenate([i, j[~given]])) if len(i) else np.zeros(0, np.int64)
        row, col, w = np.searchsorted(nodes, i[~given]), np.searchsorted(nodes, j[~given]), v[~given]
        degree = np.bincount(row, w, len(nodes))
        w = -w / np.sqrt(degree[row] * degree[col])
        vector = lambda k: np.bincount(np.searchsorted(nodes, i[step == k]), v[step == k], len(nodes)).astype(float)
        product = lambda x: np.bincount(row, w * x[col], len(nodes))
        two = [vector(max(first - 2, 0)), vector(first - 1)] if first > 1 else [np.zeros(len(nodes)), vector(0)]
        total = weights[0] * two[1] if weights else None
        for k in range(first, order + 1):
            if k:
                two = [two[1], product(two[1]) if k == 1 else 2 * product(two[1]) - two[0]]
                if weights:
                    total = total + weights[k] * two[1]
            if not weights:
                yield pa.record_batch([pa.array(np.full(len(nodes), k, np.int32)), pa.array(nodes), pa.array(two[1])], names=["k", "i", "v"])
        if weights:
            yield pa.record_batch([pa.array(nodes), pa.array(total)], names=["i", "v"])

    return run


def _one_task(adj: DataFrame, given: DataFrame) -> DataFrame:
    """given: i, v, k."""
    rows = adj.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"), F.lit(None).cast("int").alias("k"))
    return rows.unionByName(given.select(F.col("i").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.col("v").cast("double").alias("w"), F.col("k").cast("int").alias("k"))).repartition(1)


def _is_small(adj: DataFrame, limit: int) -> bool:
    return adj.limit(limit + 1).count() <= limit


class Vectors:
    """The vectors T_k(M) s, k = 0, 1, ..., of seeds s (i, v), kept as they are made."""

    def __init__(self, adj: DataFrame, seeds: DataFrame, kernel_entries: int = KERNEL_ENTRIES):
        self.adj, self.seeds, self.order = cut(adj, "adjacency"), seeds, -1
        self.small = _is_small(self.adj, kernel_entries)
        self.steps, self.m = Steps(adj.sparkSession, "vectors"), None

    def extend(self, order: int) -> Vectors:
        """Makes what is missing up to the order."""
        if order > self.order:
            if self.small:
                given = self.table().where(F.col("k") > self.order - 2) if self.order > 0 else self.seeds.withColumn("k", F.lit(0))
                first = self.order + 1 if self.order > 0 else 0
                made = _one_task(self.adj, given).mapInArrow(_kernel(first, order, None), "k int, i long, v double")
                if not first:
                    self.steps = Steps(self.adj.sparkSession, "vectors")
                self.steps.add(made)
            else:
                for k in range(self.order + 1, order + 1):
                    self._join(k)
            self.order = order
        return self

    def _join(self, k: int) -> None:
        if self.m is None:
            self.m = cut(scaled(self.adj), "heat-matrix")
        zero = F.lit(0.0).alias("v")
        if k == 0:
            parts = self.seeds.select("i", F.col("v").cast("double").alias("v")).unionByName(self.adj.select("i", zero))
        else:
            now = self._one(k - 1)
            before = now.select("i", zero) if k == 1 else self._one(k - 2).select("i", (-F.col("v")).alias("v"))
            parts = multiply(self.m, now).select("i", (F.col("v") * (1 if k == 1 else 2)).alias("v")).unionByName(before)
        self.steps.add(parts.groupBy(F.col("i").cast("long").alias("i")).agg(F.sum("v").alias("v")).select(F.lit(k).alias("k"), "i", "v"))

    def _one(self, k: int) -> DataFrame:
        return self.steps.spark.read.schema(self.steps.schema).parquet(self.steps.paths[k]).select("i", "v")

    def table(self) -> DataFrame:
        """k, i, v of all orders so far."""
        return self.steps.table()

    def field(self, t: float, order: int | None = None) -> DataFrame:
        """i, v: the heat at time t."""
        order = choose_order(t) if order is None else order
        return retime(self.extend(order).table(), t, order)


def chebyshev(adj: DataFrame, seeds: DataFrame, order: int, kernel_entries: int = KERNEL_ENTRIES) -> DataFrame:
    """k, i, v: the vectors T_k(M) s, k = 0..order. seeds: i, v."""
    return Vectors(adj, seeds, kernel_entries).extend(order).table()


def retime(vectors: DataFrame, t: float, order: int) -> DataFrame:
    """The field at t from vectors up to order: another combination, no product."""
    c = F.array(*(F.lit(coefficient(k, t)) for k in range(order + 1)))
    return vectors.where(F.col("k") <= order).groupBy("i").agg(F.sum(F.element_at(c, F.col("k") + 1) * F.col("v")).alias("v"))


def heat_field(adj: DataFrame, seeds: DataFrame, t: float, order: int | None = None, kernel_entries: int = KERNEL_ENTRIES) -> DataFrame:
    """i, v: the heat at time t of seeds (i, v)."""
    order = choose_order(t) if order is None else order
    adj = cut(adj, "adjacency")
    if _is_small(adj, kernel_entries):
        return _one_task(adj, seeds.withColumn("k", F.lit(0))).mapInArrow(_kernel(0, order, [coefficient(k, t) for k in range(order + 1)]), "i long, v double")
    return Vectors(adj, seeds, kernel_entries).field(t, order)
