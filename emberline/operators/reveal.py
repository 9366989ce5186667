"""What a field shows: relations to the seeds, tiers, order, per-file caps, and the longest list within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import location, lookup


def seed_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with exactly one end among the seeds: edges' columns, node (the other end), seed and seed_at_a.
    edges: pos, a, b, kind, w; seeds: i."""
    s = F.broadcast(seeds.select(F.col("i").alias("s")).distinct())  # at most MAX_SEEDS or MAX_SKETCH_SEEDS rows
    x = edges.join(s.withColumnRenamed("s", "sa"), F.col("a") == F.col("sa"), "left").join(s.withColumnRenamed("s", "sb"), F.col("b") == F.col("sb"), "left")
    x = x.where(F.col("sa").isNull() != F.col("sb").isNull())
    at_a = F.col("sa").isNotNull()
    return x.select(*(x[c] for c in edges.columns), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("seed"), at_a.alias("seed_at_a"))


def direct_relations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, kind, priority, w, seed, seed_at_a: the best edge between each node and a seed, of edges with one seed end."""
    best = F.struct(lookup(fixed.RELATION_PRIORITY, F.col("kind")).alias("priority"), "w", (-F.col("pos")).alias("p"), "kind", "seed", "seed_at_a")
    return seed_edges(edges, seeds).groupBy("node").agg(F.max(best).alias("r")).select("node", "r.kind", "r.priority", "r.w", "r.seed", "r.seed_at_a")


def relation_label(kind, seed_at_a, node_kind):
    side = lambda a, b: F.when(seed_at_a, a).otherwise(b)
    return (
        F.when(kind == "invokes", side("→ callee", "← caller"))
        .when(kind == "imports", side("→ import", "← importer"))
        .when(kind == "tests", side("→ subject", "← test"))
        .when(kind == "inherits", side("→ parent", "← subclass"))
        .when(kind == "anchors", F.when(seed_at_a, F.when(node_kind == "file", "→ feature file").otherwise("→ handler")).otherwise("← route"))
        .when(kind == "join", "↔ shared literal")
        .otherwise(side("◇ member", "◇ file"))
    )


def tiered(nodes: DataFrame, field: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes of the field: nodes' columns, v, h, is_seed, semantic (related by more than containment), tier (focus, direct,
    hot, warm, glow or dark), vmax, and the best edge to a seed."""
    top = field.agg(F.max("v").alias("vmax"))
    rel = direct_relations(edges, seeds).select(F.col("node").alias("r_node"), F.col("kind").alias("r_kind"), F.col("seed").alias("r_seed"), "seed_at_a")
    s = seeds.select(F.col("i").alias("s_i")).distinct()
    x = nodes.join(field.toDF("f_i", "v"), F.col("i") == F.col("f_i")).join(rel, F.col("i") == F.col("r_node"), "left").join(F.broadcast(s), F.col("i") == F.col("s_i"), "left").crossJoin(F.broadcast(top))
    x = x.withColumn("h", F.col("v") / F.col("vmax")).withColumn("is_seed", F.col("s_i").isNotNull()).withColumn("semantic", F.coalesce(F.col("r_kind") != "contains", F.lit(False)))
    tier = F.when(F.col("is_seed"), "focus").when(F.col("semantic"), "direct").when(F.col("h") >= fixed.HOT, "hot").when(F.col("h") >= fixed.WARM, "warm").when((F.col("h") >= fixed.LIT_SHARE) & (F.col("v") >= fixed.HEAT_EPS), "glow").otherwise("dark")
    return x.withColumn("tier", tier)


def lit_nodes(nodes: DataFrame, field: DataFrame, edges: DataFrame, seeds: DataFrame, disclosed: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, repeat_nucleus: bool = False, cap: int = fixed.MAX_LIT) -> DataFrame:
    """The lit nodes in order: nodes' columns, v, h, is_seed, relation, role and rank. nodes: i, id, name, kind, file,
    line, ...; the other node sets: i. Heats that are equal to ten places are ties. role is focus, direct, hot, warm or glow."""
    x = tiered(nodes, field, edges, seeds)
    x = x.where((F.col("vmax") > 0) & (F.col("semantic") | ((F.col("h") >= fixed.LIT_SHARE) & (F.col("v") >= fixed.HEAT_EPS))))
    if include is not None:
        x = x.join(include.select(F.col("i").alias("n_i")), F.col("i") == F.col("n_i"), "left_semi")
    if exclude is not None:
        x = x.join(exclude.select(F.col("i").alias("e_i")), F.col("i") == F.col("e_i"), "left_anti")
    if disclosed is not None:
        x = x.join(disclosed.select(F.col("i").alias("d_i")).distinct(), F.col("i") == F.col("d_i"), "left").where(F.col("d_i").isNull() | (F.lit(repeat_nucleus) & (F.col("is_seed") | F.col("semantic")))).drop("d_i")
    priority = F.when(F.col("is_seed"), 2).when(F.col("semantic"), 1).otherwise(0)
    order = [F.desc("p"), F.desc(F.round("v", 10)), "file", "line", "name", "i"]
    x = x.withColumn("p", priority).orderBy(*order).limit(cap)
    x = x.withColumnRenamed("tier", "role")
    # at most `cap` rows from here on
    x = x.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    unrelated = (F.col("role") == "warm") & (F.col("kind") != "file")
    seen = F.sum(unrelated.cast("int")).over(Window.partitionBy("file").orderBy("rank"))
    x = x.withColumn("role", F.when(unrelated & (seen > fixed.MAX_WARM_PER_FILE), "glow").otherwise(F.col("role")))
    label = relation_label(F.col("r_kind"), F.col("seed_at_a"), F.col("kind"))
    return x.withColumn("relation", F.when(F.col("r_kind").isNotNull(), label)).drop("f_i", "r_node", "s_i", "vmax", "p", "seed_at_a")


def lines(lit: DataFrame) -> DataFrame:
    """rank and line of what is shown: a line per node that isn't collapsed, then one per file for those that are."""
    place = location(F.col("file"), F.col("kind"), F.col("line"), F.col("line_approx"))
    context = F.when(F.col("is_seed"), "  [focus]").when(F.col("relation").isNotNull(), F.concat(F.lit("  ["), F.col("relation"), F.lit("]"))).otherwise("")
    hot = F.when(F.col("kind") == "file", F.concat(F.lit("▪ "), "file", context)).when(F.col("kind") == "anchor", F.concat(F.lit("⚑ "), "sig", context)).otherwise(F.concat(F.lit("▲ "), place, F.lit("  "), "sig", context))
    tail = F.concat("name", F.lit(" ("), "kind", F.lit(") "), place)
    warm = F.when(F.col("semantic"), F.concat(F.lit("  "), "relation", F.lit("  "), tail)).otherwise(F.concat(F.lit("  · "), tail))
    shown = lit.where("role <> 'glow'").select(F.col("rank").cast("long").alias("rank"), F.when(F.col("is_seed") | (F.col("h") >= fixed.HOT), hot).otherwise(warm).alias("line"))
    glow = lit.where("role = 'glow'").groupBy("file").agg(F.count("*").alias("n"))
    more = glow.select((F.lit(10_000) + F.row_number().over(Window.orderBy(F.desc("n"), "file"))).cast("long").alias("rank"), F.concat(F.lit("  ~ +"), F.col("n").cast("string"), F.lit(" more in "), "file").alias("line"))
    return shown.unionByName(more)


def fitting(items: DataFrame, header: int, total: int, footer: int, budget: int) -> DataFrame:
    """The longest prefix of items (rank, line) whose text is at most budget tokens: items with shown. header and footer
    are lengths; the footer, with the number of what is left, is there unless all of `total` are shown."""
    k = F.row_number().over(Window.orderBy("rank"))
    upto = F.sum(F.length("line") + 1).over(Window.orderBy("rank"))
    left = F.lit(total) - k
    length = F.lit(header) + upto + F.when(left > 0, F.lit(footer) + F.length(left.cast("string"))).otherwise(0)
    x = items.withColumn("k", k).withColumn("fits", F.ceil(length / 4) <= budget)
    most = x.agg(F.max(F.when(F.col("fits"), F.col("k"))).alias("most"))
    return x.crossJoin(F.broadcast(most)).select("rank", "line", (F.col("k") <= F.coalesce("most", F.lit(0))).alias("shown"))


def suggested_reads(nodes: DataFrame, most: int = 5) -> DataFrame:
    """path, start, lines, reason: windows around the shown nodes, merged with the first earlier one that they touch.
    The order decides what merges, so the few rows (nodes: rank, file, line, line_approx, role, relation) are folded in one task."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("rank").itertuples():
            if r.line <= 0 or r.line_approx:
                continue
            first, last = max(1, r.line - 5), max(1, r.line - 5) + 24
            near = next((o for o in out if o[0] == r.file and first <= o[1] + o[2] and last + 1 >= o[1]), None)
            if near:
                end = max(near[1] + near[2] - 1, last)
                near[1] = min(near[1], first)
                near[2] = end - near[1] + 1
                if r.role == "focus":
                    near[3] = "matched focus"
                continue
            out.append([r.file, first, 25, "matched focus" if r.role == "focus" else r.relation or f"{r.role} neighbor"])
            if len(out) == most:
                break
        return pd.DataFrame(out, columns=["path", "start", "lines", "reason"])

    few = nodes.select("rank", "file", "line", "line_approx", "role", "relation").orderBy("rank").limit(fixed.MAX_LIT).withColumn("one", F.lit(1))
    return few.groupBy("one").applyInPandas(fold, "path string, start long, lines long, reason string")
