"""Regions of a graph: dense seeds, and what grows around them.

A region starts at a seed and takes in, one after the other, the node that has the largest share of its weight inside, while
that share is LEAST_RATIO or more, until the weight that leaves the region exceeds CUT times the weight inside. What one
region has claimed is out of reach for those of lower-ranked seeds.

Regions of a batch of seeds grow side by side, a node a round: their borders are one table (seed, node, weight inside), each
round's choices are a grouped maximum over it, and the new members' edges are joined to it. Only choices and members go
through the driver, MOST_MEMBERS for each seed of a batch. Then claims are settled in the order of the seeds: a region stands
if it took nothing that a region before it claims, for then those claims would have changed none of its choices; at the
first one that did, the next batch begins, with the claims known. Batches grow while there is no such clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.sources.lineage import cut, drop, place

# Fixed values of the method.
NEIGHBOURS, LEAST_TRIANGLES, LEAST_DEGREE = 12, 0.08, 6
MOST_REGIONS, MOST_MEMBERS, LEAST_MEMBERS, LEAST_RATIO, CUT = 12, 64, 4, 0.15, 2.6
#: Seeds of the first batch, and of the largest.
BATCH, MOST_BATCH = 16, 256


def ends(edges: DataFrame) -> DataFrame:
    """i, j, kind, w, pos: each edge from either end, parallel ones kept. edges: pos, a, b, kind, w."""
    return edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "kind", "w", "pos").unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), "kind", "w", "pos"))


def triangle_density(near: DataFrame) -> DataFrame:
    """i, deg, tri: of the pairs of a node's first NEIGHBOURS ends, containment last, then by weight and end, the share that
    is linked. Of a hub's many ends no more than these leave a task."""
    order = Window.partitionBy("i").orderBy(F.col("kind") == "contains", F.desc("w"), "j", "pos")
    few = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS).select("i", "j", "rank")
    links = near.select(F.col("i").alias("l_i"), F.col("j").alias("l_j")).distinct()
    pairs = few.join(few.toDF("i2", "j2", "rank2"), (F.col("i") == F.col("i2")) & (F.col("rank") < F.col("rank2"))).select("i", "j", "j2")
    hit = pairs.join(links, (pairs["j"] == links["l_i"]) & (pairs["j2"] == links["l_j"]), "left").groupBy("i").agg(F.avg(F.col("l_i").isNotNull().cast("double")).alias("tri"))
    deg = near.groupBy("i").agg(F.count("*").alias("deg"))
    return deg.join(hit.withColumnRenamed("i", "h_i"), F.col("i") == F.col("h_i"), "left").select("i", "deg", F.coalesce("tri", F.lit(0.0)).alias("tri"))


def candidates(near: DataFrame, conductance: DataFrame) -> DataFrame:
    """i, score of possible seeds. conductance: i, d."""
    x = triangle_density(near).join(conductance.toDF("c_i", "d"), F.col("i") == F.col("c_i"))
    x = x.where((F.col("deg") >= 2) & (F.col("d") > 0) & ((F.col("tri") >= LEAST_TRIANGLES) | (F.col("deg") >= LEAST_DEGREE)))
    return x.select("i", (F.col("d") * (0.25 + 0.75 * F.col("tri")) + F.col("deg") * 0.02).alias("score"))


def _rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple[int, ...]]) -> DataFrame:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names)))


class _Growth:
    """The rounds of a batch of seeds."""

    def __init__(self, ways: DataFrame, totals: DataFrame, seeds: list[int], claimed: list[int]):
        self.ways, self.totals, self.claimed, self.spark = ways, totals, claimed, ways.sparkSession
        self.members = {s: [s] for s in seeds}
        self.inside = dict.fromkeys(seeds, 0.0)
        self.border: DataFrame | None = None
        self.path: str | None = None

    def widen(self, entered: list[tuple[int, int]], round_: int) -> None:
        """Takes the entered nodes (seed, node) out of their regions' borders and adds their edges' far ends."""
        new = _rows(self.spark, ("n_seed", "n_node"), entered)
        held = F.broadcast(_rows(self.spark, ("h_seed", "h_node"), [(s, m) for s, own in self.members.items() for m in own]))
        far = self.ways.join(F.broadcast(new), F.col("i") == F.col("n_node")).select(F.col("n_seed").alias("seed"), F.col("j").alias("node"), "w", F.lit(round_).alias("met"))
        rows = far if self.border is None else self.border.join(F.broadcast(new.select("n_seed").distinct()), F.col("seed") == F.col("n_seed"), "left_semi").unionByName(far)
        rows = rows.join(held, (F.col("seed") == F.col("h_seed")) & (F.col("node") == F.col("h_node")), "left_anti")
        old, self.path = self.path, place(self.spark, "border")
        rows.groupBy("seed", "node").agg(F.sum("w").alias("w"), F.min("met").alias("met")).write.parquet(self.path)
        self.border = self.spark.read.schema("seed long, node long, w double, met int").parquet(self.path)
        if old:
            drop(self.spark, old)

    def choices(self) -> list:
        """Of each region with a border: the weight that leaves it, and the best node to enter, of equal ones the first met."""
        x = self.border.join(self.totals, F.col("node") == F.col("t_node"))
        share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0)
        free = ~F.col("node").isin(self.claimed) if self.claimed else F.lit(True)
        best = F.max(F.when(free, F.struct(share.alias("share"), (-F.col("met")).alias("met"), (-F.col("node")).alias("node"), "w")))
        return x.groupBy("seed").agg(F.sum("w").alias("leaves"), best.alias("best")).collect()  # a row for each seed of the batch

    def run(self) -> dict[int, list[int]]:
        entered, round_ = [(s, s) for s in self.members], 0
        while entered:
            self.widen(entered, round_)
            entered, round_ = [], round_ + 1
            for r in self.choices():
                own = self.members[r.seed]
                dense = len(own) < LEAST_MEMBERS or r.leaves <= CUT * max(self.inside[r.seed], 0.001)
                if r.best is not None and r.best.share >= LEAST_RATIO and len(own) < MOST_MEMBERS and (dense or len(own) == 1):
                    own.append(-r.best.node)
                    self.inside[r.seed] += r.best.w
                    entered.append((r.seed, -r.best.node))
        if self.path:
            drop(self.spark, self.path)
        return self.members


def grow(near: DataFrame, scored: DataFrame, n_nodes: int, include: DataFrame | None = None) -> DataFrame:
    """seed, place, member of at most MOST_REGIONS regions. near: i, j, w; scored: i, score; include: i of the nodes that may
    belong to regions, all by default."""
    spark = near.sparkSession
    near = cut(near.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")), "ways")
    totals = cut(near.groupBy(F.col("i").alias("t_node")).agg(F.sum("w").alias("total")), "totals")
    ways = near if include is None else near.join(include.select(F.col("i").alias("n_i")), F.col("j") == F.col("n_i"), "left_semi")
    left = cut(scored.select(F.col("i").cast("long").alias("i"), F.col("score").cast("double").alias("score")), "candidates")
    claimed: set[int] = set()
    regions: list[list[int]] = []
    last, batch = None, BATCH
    while len(regions) < MOST_REGIONS:
        rest = left if last is None else left.where((F.col("score") < last[1]) | ((F.col("score") == last[1]) & (F.col("i") > last[0])))
        seeds = [(r.i, r.score) for r in rest.orderBy(F.desc("score"), "i").limit(batch).collect()]
        if not seeds:
            break
        grown = _Growth(ways, totals, [i for i, _ in seeds if i not in claimed], sorted(claimed)).run()
        known, batch = frozenset(claimed), min(2 * batch, MOST_BATCH)
        for seed in seeds:
            own = grown.get(seed[0])
            fresh = claimed - known
            if own is not None and seed[0] not in fresh:
                if not fresh.isdisjoint(own):  # to be grown again, with these claims
                    batch = BATCH
                    break
                if LEAST_MEMBERS <= len(own) <= max(40, n_nodes / 3):
                    claimed.update(own)
                    regions.append(own)
                    if len(regions) == MOST_REGIONS:
                        break
            last = seed
    return _rows(spark, ("seed", "place", "member"), [(own[0], k, m) for own in regions for k, m in enumerate(own)])
