"""A graph at a glance: groups by mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import directory, is_test_scope
from emberline.operators import basins, heat
from emberline.sources.lineage import cut

T = 16.0
# When regions are looked for, and the shares of test groups.
FEW_ROUTES, LEAST_NODES, TEST_SHARE, TEST_ROUTE_SHARE = 6, 48, 0.1, 0.05


def directory_groups(nodes: DataFrame, field: DataFrame, claimed: DataFrame) -> DataFrame:
    """label, mass, files, top of the nodes that no other group claims. claimed: i."""
    c = claimed.select(F.col("i").alias("c_i")).distinct()
    x = nodes.where("kind <> 'anchor'").join(c, nodes["i"] == c["c_i"], "left_anti").join(field.toDF("f_i", "v"), F.col("i") == F.col("f_i")).withColumn("label", directory(F.col("file")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("v", 10)), "i"))
    top = x.where("kind <> 'file'").withColumn("rank", rank).where("rank <= 3").groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("top"))
    sums = x.groupBy("label").agg(F.sum("v").alias("mass"), F.countDistinct("file").alias("files"), F.bool_and(is_test_scope(F.col("file"))).alias("test"))
    return sums.join(top.withColumnRenamed("label", "t_label"), F.col("label") == F.col("t_label"), "left").select("label", (F.col("mass") * F.when(F.col("test"), TEST_SHARE).otherwise(1.0)).alias("mass"), "files", F.coalesce("top", F.lit("")).alias("top"))


def opening_seeds(nodes: DataFrame, conductance: DataFrame, routes: DataFrame) -> DataFrame:
    """i of at most MAX_SKETCH_SEEDS seeds: production routes, then the MAX_HUBS best-connected nodes outside tests."""
    d = conductance.toDF("d_i", "d")
    placed = nodes.join(d, nodes["i"] == d["d_i"])
    hubs = placed.where(~is_test_scope(F.col("file"))).orderBy(F.desc(F.round("d", 9)), "i").limit(fixed.MAX_HUBS).select("i")
    if not hubs.head(1):
        hubs = placed.orderBy(F.desc(F.round("d", 9)), "i").limit(fixed.MAX_HUBS).select("i")
    both = routes.select("i", F.lit(0).alias("o")).unionByName(hubs.select("i", F.lit(1).alias("o"))).groupBy("i").agg(F.min("o").alias("o"))
    return both.orderBy("o", "i").limit(fixed.MAX_SKETCH_SEEDS).select("i")


def closures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """i, a_name, at, j, file: every route with itself and the far ends of its edges, as often as there are edges."""
    near = basins.ends(edges)
    place = nodes.select(F.col("i").alias("n_i"), "file")
    reach = near.select("i", "j").unionByName(nodes.select("i", F.col("i").alias("j")))
    anchors = nodes.where("kind = 'anchor'").select(F.col("i").alias("a_i"), F.col("name").alias("a_name"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("at"))
    return reach.join(anchors, reach["i"] == anchors["a_i"]).join(place, F.col("j") == F.col("n_i")).select("i", "a_name", "at", "j", "file")


def closure_mass(closure: DataFrame, field: DataFrame) -> DataFrame:
    """i, a_name, at, mass, k, files of each route: parallel edges count each."""
    warm = closure.join(field.toDF("f_i", "v"), F.col("j") == F.col("f_i"))
    return warm.groupBy("i", "a_name", "at").agg(F.sum("v").alias("mass"), F.count("*").alias("k"), F.countDistinct("file").alias("files"))


def sketch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, mass, detail of all groups."""
    adj = cut(heat.adjacency(edges), "adjacency")
    degree = heat.degrees(adj)
    near = basins.ends(edges)
    place = nodes.select(F.col("i").alias("n_i"), "file", "name", "kind")
    closure = cut(closures(nodes, edges), "closure")
    production = closure.groupBy("i").agg(F.bool_or(~is_test_scope(F.col("file"))).alias("shipped"))
    routes = production.where("shipped").select("i")
    seeds = opening_seeds(nodes, degree, routes)
    field = cut(heat.heat_field(adj, seeds.withColumn("v", F.lit(1.0)), T), "field")
    groups = closure_mass(closure, field).join(production.toDF("p_i", "shipped"), F.col("i") == F.col("p_i"))
    out = groups.where("shipped").select(F.concat(F.lit("⚑ "), "a_name").alias("label"), "mass", F.format_string("%d nodes · %d files · %s", "k", "files", "at").alias("detail"))
    test = groups.where("not shipped").agg(F.sum("mass").alias("mass"), F.count("*").alias("k")).where("k > 0")
    out = out.unionByName(test.select(F.lit("tests/fixtures").alias("label"), (F.col("mass") * TEST_ROUTE_SHARE).alias("mass"), F.format_string("%d feature anchors collapsed", "k").alias("detail")))
    claimed = closure.select(F.col("j").alias("i"))
    n = nodes.count()
    if routes.count() < FEW_ROUTES and n >= LEAST_NODES:
        code = nodes.where(~is_test_scope(F.col("file"))).select("i", "kind")
        inside = code.select(F.col("i").alias("k_i"))
        scored = basins.candidates(near, degree).join(code.where(~F.col("kind").isin("file", "anchor")).select(F.col("i").alias("k_i")), F.col("i") == F.col("k_i"), "left_semi")
        regions = basins.grow(near, scored, n, inside.withColumnRenamed("k_i", "i"))
        x = regions.join(place, F.col("member") == F.col("n_i")).join(field.toDF("f_i", "v"), F.col("member") == F.col("f_i"))
        best = F.max(F.when(F.col("kind") != "file", F.struct("v", "name")))["name"]
        out = out.unionByName(x.groupBy("seed").agg(F.concat(F.lit("◈ region "), F.coalesce(best, F.first("name"))).alias("label"), F.sum("v").alias("mass"), F.format_string("%d nodes · %d files", F.count("*"), F.countDistinct("file")).alias("detail")).select("label", "mass", "detail"))
        claimed = claimed.unionByName(regions.select(F.col("member").alias("i")))
    dirs = directory_groups(nodes, field, claimed)
    return out.unionByName(dirs.select("label", "mass", F.format_string("%d files · top: %s", "files", "top").alias("detail")))
