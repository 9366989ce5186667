"""From files to a graph: all facts, nodes with numbers, and the seven kinds of edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import base_name, language_of
from emberline.operators import graph, heat, literal_index
from emberline.operators.ranking import global_rank
from emberline.sources import extract
from emberline.sources.files import coverage
from emberline.sources.lineage import cut


@dataclass
class Graph:
    """nodes: i, id, name, kind, file, line, line_approx, sig, lang. edges: pos, a, b, kind, w. keys, occ: the literal index.
    hubs: routes. adj: the matrix."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    keys: DataFrame
    occ: DataFrame
    hubs: DataFrame
    adj: DataFrame


def assemble(files: DataFrame, rules: tuple = (), max_bytes: int = fixed.MAX_FILE_BYTES, file_rules: tuple = ()) -> Graph:
    """files: file, text. Oversized and generated files are nodes without facts. rules: further route rules;
    file_rules: further rules of routes that are a file's path, as in fixed.FILE_ROUTES."""
    listing = files.select("file")
    usable = coverage(files, max_bytes).where("status = 'ok'").select("file", "text")
    symbols = cut(extract.symbols(usable), "symbols")
    drafts = extract.anchors(usable, extract.ANCHOR_RULES + rules).unionByName(extract.file_routes(usable, fixed.FILE_ROUTES + file_rules).withColumn("implicit", F.lit(False)))

    file_nodes = listing.select(F.lit(0).alias("o"), F.concat(F.lit("file:"), "file").alias("id"), base_name(F.col("file")).alias("name"), F.lit("file").alias("kind"), "file", F.lit(0).alias("line"), F.col("file").alias("sig"), language_of(F.col("file")).alias("lang"))
    symbol_nodes = symbols.select(F.lit(1).alias("o"), F.concat_ws("@", "name", "file").alias("id"), "name", "kind", "file", "line", "sig", "lang")
    base = cut(global_rank(file_nodes.unionByName(symbol_nodes), "o", "file", "line", "name"), "nodes")
    base = base.withColumn("i", F.col("rank") - 1)
    file_at = base.where("o = 0").select(F.col("file").alias("at_file"), F.col("i").alias("at"))
    starts = base.where("o = 1").select("file", "line", F.col("i").alias("idx"), F.col("i").alias("pos"))

    def placed(sites: DataFrame) -> DataFrame:
        """sites (site, file, line) with node: the enclosing symbol, else the file."""
        x = graph.enclosing(sites, starts)
        return x.join(file_at, x["file"] == file_at["at_file"]).select("site", "file", "line", F.coalesce("idx", "at").alias("node"))

    def edge(df: DataFrame, a: str, b: str, kind: str, w) -> DataFrame:
        return df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("kind"), (F.col(w) if isinstance(w, str) else F.lit(w)).cast("double").alias("w"))

    numbered = lambda df, *by: cut(global_rank(df, *by).withColumnRenamed("rank", "site"), "sites")
    parts = [edge(base.where("o = 1").join(file_at, F.col("file") == F.col("at_file")), "at", "i", "contains", fixed.EDGE_WEIGHT["contains"])]

    targets = cut(graph.resolve_imports(extract.imports(usable), listing), "imports")
    between = targets.join(file_at.toDF("f1", "a"), F.col("file") == F.col("f1")).join(file_at.toDF("f2", "b"), F.col("target") == F.col("f2"))
    parts.append(edge(between, "a", "b", "imports", fixed.EDGE_WEIGHT["imports"]))
    parts.append(edge(graph.test_wiring(between), "a", "b", "tests", fixed.EDGE_WEIGHT["tests"]))

    defs = base.where("o = 1").select(F.col("i").alias("idx"), "file", "name")
    calls = numbered(extract.calls(usable), "file", "line", "callee")
    resolved = graph.resolve_calls(calls.select(F.col("site").alias("call"), "file", "callee"), defs, targets)
    callers = placed(calls.select("site", "file", "line")).select(F.col("site").alias("c_site"), "node")
    parts.append(edge(resolved.join(callers, F.col("call") == F.col("c_site")), "node", "to", "invokes", "w"))
    parts.append(edge(graph.inherited(base.where("kind = 'class'").select(F.col("i").alias("idx"), "sig"), defs), "idx", "to", "inherits", fixed.EDGE_WEIGHT["inherits"]))

    lits = numbered(extract.literals(usable), "file", "line", "text")
    sites = lits.join(placed(lits.select("site", "file", "line")).select(F.col("site").alias("p_site"), "node"), F.col("site") == F.col("p_site")).select("file", "line", "text", "node", F.col("site").alias("pos"))
    occ = cut(literal_index.occurrences(sites), "occurrences")
    keys = cut(literal_index.keys(occ), "keys")
    parts.append(edge(literal_index.edges(occ, keys), "a", "b", "join", "w"))

    routes = numbered(drafts, "id", "file", "line")
    routes = routes.join(placed(routes.select("site", "file", "line")).select(F.col("site").alias("p_site"), "node"), F.col("site") == F.col("p_site")).withColumn("pos", F.col("site")).drop("p_site", "site")
    routes = cut(routes, "routes")
    hubs = cut(graph.anchor_hubs(routes), "hubs")
    n = base.count()
    hub_nodes = global_rank(hubs, "id").withColumn("i", F.col("rank") - 1 + n)
    sig = F.concat(F.when(F.col("implicit"), "(△ discovered) ").otherwise(""), F.when(F.col("sites") > 1, F.concat("id", F.lit(" ("), F.col("sites").cast("string"), F.lit(" sites)"))).otherwise(F.col("id")))
    hub_nodes = cut(hub_nodes.select("i", F.concat(F.lit("anchor:"), "id").alias("id"), F.col("id").alias("name"), F.lit("anchor").alias("kind"), "file", "line", sig.alias("sig"), F.lit("anchor").alias("lang")), "hub-nodes")
    ends = graph.hub_edges(routes, hubs).join(hub_nodes.select(F.col("name").alias("hub_name"), F.col("i").alias("hub")), F.col("id") == F.col("hub_name")).join(file_at, F.col("file") == F.col("at_file"), "left")
    parts.append(edge(ends.withColumn("end", F.coalesce("node", "at")), "hub", "end", "anchors", "w"))

    nodes = base.select("i", "id", "name", "kind", "file", "line", "sig", "lang").unionByName(hub_nodes).withColumn("line_approx", F.lit(False))
    edges = cut(global_rank(reduce(DataFrame.unionByName, parts).where("a <> b"), "kind", "a", "b", "w").withColumnRenamed("rank", "pos"), "edges")
    return Graph(listing, cut(nodes, "graph-nodes"), edges, keys, occ, hubs, cut(heat.adjacency(edges), "adjacency"))
