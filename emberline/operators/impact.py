"""What a change warms: mass by file, why, and the strongest nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import lookup
from emberline.operators.ranking import global_rank
from emberline.sources.lineage import Steps, cut


def masses(nodes: DataFrame, field: DataFrame, seeds: DataFrame) -> DataFrame:
    """i, id, name, kind, file, line, v and place of every warm node but the seeds: seed (in a seed's file), anchor or
    other. seeds: i."""
    s = seeds.select(F.col("i").alias("s_i")).distinct()
    files = nodes.join(s, nodes["i"] == s["s_i"], "left_semi").select(F.col("file").alias("s_file")).distinct()
    x = nodes.join(s, nodes["i"] == s["s_i"], "left_anti").join(field.toDF("f_i", "v"), F.col("i") == F.col("f_i")).where("v > 1e-6")
    x = x.join(files, x["file"] == files["s_file"], "left")
    return x.select("i", "id", "name", "kind", "file", "line", "v", F.when(F.col("s_file").isNotNull(), "seed").when(F.col("kind") == "anchor", "anchor").otherwise("other").alias("place"))


def file_mass(warm: DataFrame, names: int = 3) -> DataFrame:
    """file, mass, top: the files that aren't seeds, with their warmest symbols."""
    x = warm.where("place = 'other'")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc(F.round("v", 10)), "i"))
    top = x.where("kind <> 'file'").withColumn("rank", rank).where(F.col("rank") <= names).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("top"))
    mass = x.groupBy("file").agg(F.sum("v").alias("mass"))
    return mass.join(top.withColumnRenamed("file", "t_file"), F.col("file") == F.col("t_file"), "left").select("file", "mass", F.coalesce("top", F.lit("")).alias("top"))


def direct_reasons(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, file, reason, pos: edges between a seed's file and another one, at their far end."""
    place = nodes.select(F.col("i").alias("n_i"), "file")
    s = seeds.select(F.col("i").alias("s_i")).distinct()
    files = nodes.join(s, nodes["i"] == s["s_i"], "left_semi").select(F.col("file").alias("s_file")).distinct()
    x = edges.withColumn("reason", lookup(fixed.REASONS, F.col("kind"))).where("reason is not null")
    x = x.join(place.toDF("ia", "fa"), F.col("a") == F.col("ia")).join(place.toDF("ib", "fb"), F.col("b") == F.col("ib")).where("fa <> fb")
    x = x.join(files.toDF("sa"), F.col("fa") == F.col("sa"), "left").join(files.toDF("sb"), F.col("fb") == F.col("sb"), "left").where(F.col("sa").isNull() != F.col("sb").isNull())
    far = F.col("sa").isNotNull()
    return x.select(F.when(far, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(far, F.col("fb")).otherwise(F.col("fa")).alias("file"), "reason", "pos")


def reviewed(files: DataFrame, direct: DataFrame, far: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
    """files (file, mass, top) with reasons: those of its direct edges (direct_reasons), else those of the first path to it
    (far: file, reasons), else that there is none; first of all history, where the file is a partner (partners: partner)."""
    near = direct.groupBy(F.col("file").alias("r_file")).agg(F.array_sort(F.collect_set("reason")).alias("r"), F.min_by("reason", "pos").alias("first"))
    # as many reasons as there are kinds of edges; that of the first edge leads
    near = near.select("r_file", F.array_distinct(F.concat(F.array("first"), "r")).alias("r"))
    x = files.join(near, files["file"] == near["r_file"], "left")
    none = F.lit(None).cast("array<string>").alias("q")
    x = x.select("file", "mass", "top", "r", none) if far is None else x.join(far.toDF("q_file", "q"), x["file"] == F.col("q_file"), "left").select("file", "mass", "top", "r", "q")
    told = F.coalesce("r", "q")
    reasons = F.coalesce(told, F.array(F.lit(fixed.NO_REASON)))
    if partners is not None:
        x = x.join(partners.select("partner").distinct(), x["file"] == F.col("partner"), "left")
        history = F.array_distinct(F.concat(F.array(F.lit(fixed.HISTORY_REASON)), F.coalesce(told, F.array().cast("array<string>"))))
        reasons = F.when(F.col("partner").isNotNull(), history).otherwise(reasons)
    return x.select("file", "mass", "top", reasons.alias("reasons"))


def path_reasons(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, level, reasons: kinds of edges along the first shortest path from a seed, breadth first. From each node the
    edges go out with containment last, then by weight and target; nodes keep the order in which they are met.
    edges: pos, a, b, kind, w; seeds: i, pos. One join per level, over what is new, until nothing is."""
    ways = edges.select("a", F.col("b").alias("to"), "kind", "w", "pos").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("to"), "kind", "w", "pos"))
    ways = cut(ways.withColumn("reason", lookup(fixed.REASONS, F.col("kind"))), "ways")
    steps = Steps(edges.sparkSession, "bfs")
    frontier = steps.add(seeds.groupBy(F.col("i").alias("node")).agg(F.min("pos").cast("long").alias("place")).select("node", "place", F.lit(0).alias("level"), F.array().cast("array<string>").alias("reasons")))
    level = 0
    while frontier.head(1):
        level, seen = level + 1, steps.table()
        f = frontier.select(F.col("node").alias("f_node"), F.col("place").alias("f_place"), "reasons")
        x = ways.join(f, ways["a"] == f["f_node"])
        x = x.join(seen.select(F.col("node").alias("s_node")), x["to"] == F.col("s_node"), "left_anti")
        told = F.when(F.col("reason").isNull() | F.array_contains("reasons", F.col("reason")), F.col("reasons")).otherwise(F.concat("reasons", F.array("reason")))
        first = F.min(F.struct("f_place", (F.col("kind") == "contains").alias("last"), (-F.col("w")).alias("w"), F.col("to").alias("t"), "pos", told.alias("told"))).alias("m")
        new = x.groupBy(F.col("to").alias("node")).agg(first)
        # a place that keeps the order of discovery: the parent's order, then the edge's
        met = new.select("node", F.col("m.f_place").alias("f_place"), F.col("m.last").alias("last"), F.col("m.w").alias("w"), F.col("m.told").alias("reasons"))
        frontier = steps.add(global_rank(met, "f_place", "last", "w", "node").select("node", F.col("rank").alias("place"), F.lit(level).alias("level"), "reasons"))
    return steps.table().select("node", "level", "reasons")


def warmed(warm: DataFrame, reasons: DataFrame, cap: int = fixed.MAX_WARMED) -> DataFrame:
    """key, file, m, r: the strongest warm nodes outside the seeds' files. reasons: node, r (array)."""
    x = warm.where("place <> 'seed'").select("i", F.concat_ws("|", "kind", "id").alias("key"), "file", F.round("v", 6).alias("m"))
    x = x.join(reasons.select(F.col("node").alias("r_node"), "r"), x["i"] == F.col("r_node"), "left")
    return x.orderBy(F.desc("m"), "key").limit(cap).select("key", "file", "m", F.coalesce("r", F.array().cast("array<string>")).alias("r"))
