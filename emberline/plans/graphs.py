"""Queries over the graph of shared literals and the graph of business keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import fixed, text
from emberline.functions.kernel import bessel_i, choose_order, coefficient, coefficients
from emberline.operators import basins, graph, heat, impact, literal_index, reveal, seeds
from emberline.operators.ranking import global_rank
from emberline.plans.bindings import ADJ_SQL, EDGES_SQL, KEYS_SQL, NODES_SQL, heat_sql, key_graph, page_literals, table
from emberline.plans.files_and_names import ASKED_NAME, SCOPE, SIMILAR_SQL
from emberline.plans.files_and_names import names as part_names
from emberline.plans.registry import query, values
from emberline.sources.lineage import cut

HUB = 500000
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"
PRIORITY = "CASE kind WHEN 'contains' THEN 0 WHEN 'imports' THEN 2 WHEN 'join' THEN 3 WHEN 'anchors' THEN 4 WHEN 'tests' THEN 5 WHEN 'inherits' THEN 6 ELSE 7 END"
#: Seeds of the key graph's queries: the first three suppliers.
SEEDS = [(2000001, 1.0), (2000002, 1.0), (2000003, 1.0)]
SEED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {v}::DOUBLE)" for i, v in SEEDS) + ") AS s(i, v)"


def seed_rows(spark, rows=SEEDS):
    return spark.createDataFrame(rows, "i long, v double")


def key_field(spark, sf, rows=SEEDS):
    nodes, edges = key_graph(spark, sf)
    return nodes, edges, heat.heat_field(heat.adjacency(edges), seed_rows(spark, rows), 2.0)


# literals ---------------------------------------------------------------------------------------------------------
def literal_tables(spark, sf):
    occ = cut(literal_index.occurrences(page_literals(spark, sf)), "occurrences")
    return occ, literal_index.keys(occ)


@query(f"WITH {KEYS_SQL} SELECT key, cls, df, round(spec, 6) AS spec, round(w, 6) AS w FROM weighted")
def d1_literal_keys(spark, sf):
    _, keys = literal_tables(spark, sf)
    return keys.select("key", "cls", "df", F.round("spec", 6).alias("spec"), F.round("w", 6).alias("w"))


@query(f"WITH {KEYS_SQL} SELECT a, b, round(w, 6) AS w FROM edges")
def c6_literal_edges(spark, sf):
    occ, keys = literal_tables(spark, sf)
    return literal_index.edges(occ, keys).select("a", "b", F.round("w", 6).alias("w"))


@query(f"WITH {KEYS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY node, line, text) AS k FROM occ) SELECT key, node, line::INT AS line FROM r WHERE k <= 3")
def d1_literal_lookup(spark, sf):
    occ, _ = literal_tables(spark, sf)
    return literal_index.lookup(occ, cap=3).select("key", "node", "line")


LITERAL_QUERY = "/de"


@query(f"""WITH {KEYS_SQL}, hit AS (SELECT key, 1.0::DOUBLE AS s FROM keys WHERE key = '{LITERAL_QUERY}' UNION ALL SELECT key, 0.8 FROM keys WHERE cls = 'path' AND key LIKE '{LITERAL_QUERY}/%')
SELECT node AS i, max(s) AS score FROM occ JOIN hit USING (key) GROUP BY node""")
def c14_literal_seeds(spark, sf):
    occ, keys = literal_tables(spark, sf)
    return seeds.literal_seeds(keys, occ, LITERAL_QUERY).groupBy("i").agg(F.max("score").alias("score"))


FOCUS_CTES = f"""WITH RECURSIVE {KEYS_SQL}, {ADJ_SQL},
{heat_sql(f"SELECT DISTINCT node AS i, 1.0::DOUBLE AS v FROM occ WHERE key = '{LITERAL_QUERY}'", 2.0, 21, coefficients(2.0, 21))},
lit AS (SELECT i, v, v / (SELECT max(v) FROM field) AS h, i IN (SELECT i FROM seed) AS is_seed FROM field),
rel AS (SELECT DISTINCT j AS i FROM adj WHERE i IN (SELECT i FROM seed) AND j NOT IN (SELECT i FROM seed)),
kept AS (SELECT lit.*, rel.i IS NOT NULL AS semantic FROM lit LEFT JOIN rel ON rel.i = lit.i WHERE rel.i IS NOT NULL OR (h >= 0.002 AND v >= 1e-9)),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN is_seed THEN 2 WHEN semantic THEN 1 ELSE 0 END DESC, round(v, 10) DESC, 'page/' || i, i) AS rank FROM kept),
roles AS (SELECT *, 'page/' || i AS file, CASE WHEN is_seed THEN 'focus' WHEN semantic THEN 'direct' WHEN h >= 0.3 THEN 'hot' WHEN h >= 0.02 THEN 'warm' ELSE 'glow' END AS role FROM placed WHERE rank <= 400)"""
FOCUS_SQL = f"{FOCUS_CTES} SELECT rank::INT AS rank, i, round(h, 6) AS h, role FROM roles"
BUDGET = 512
FITTING_SQL = f"""{FOCUS_CTES}, items AS (
  SELECT rank, CASE WHEN is_seed THEN '▪ ' || file || '  [focus]' WHEN h >= 0.3 AND semantic THEN '▪ ' || file || '  [↔ shared literal]' WHEN h >= 0.3 THEN '▪ ' || file
    WHEN semantic THEN '  ↔ shared literal  ' || file || ' (file) ' || file ELSE '  · ' || file || ' (file) ' || file END AS line FROM roles WHERE role <> 'glow'
  UNION ALL SELECT 10000 + row_number() OVER (ORDER BY file), '  ~ +1 more in ' || file FROM roles WHERE role = 'glow'
), sized AS (
  SELECT *, row_number() OVER (ORDER BY rank) AS k, sum(length(line) + 1) OVER (ORDER BY rank) AS upto, (SELECT count(*) FROM roles) AS total FROM items
), fit AS (
  SELECT *, ceil(({len(f"focus {LITERAL_QUERY}") + 1} + upto + CASE WHEN total > k THEN {len("X...  more")} + length((total - k)::VARCHAR) ELSE 0 END) / 4.0) <= {BUDGET} AS ok FROM sized
)
SELECT rank::BIGINT AS rank, line, k <= coalesce((SELECT max(k) FROM fit WHERE ok), 0) AS shown FROM fit"""


def literal_graph(spark, sf):
    occ, keys = literal_tables(spark, sf)
    edges = cut(literal_index.edges(occ, keys).select("a", "b", "w", F.lit("join").alias("kind"), F.xxhash64("a", "b").alias("pos")), "literal-edges")
    nodes = table(spark, sf, "pages").select(F.col("page_id").alias("i"), F.concat(F.lit("file:page/"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("name"), F.lit("file").alias("kind"))
    nodes = nodes.select("i", "id", "name", "kind", F.col("name").alias("file"), F.lit(0).alias("line"), F.lit(False).alias("line_approx"), F.col("name").alias("sig"), F.lit("config").alias("lang"))
    return nodes, edges, occ, keys


def literal_focus(spark, sf):
    nodes, edges, occ, _ = literal_graph(spark, sf)
    start = occ.where(F.col("key") == LITERAL_QUERY).select(F.col("node").alias("i")).distinct()
    field = heat.heat_field(heat.adjacency(edges), start.withColumn("v", F.lit(1.0)), 2.0, 21)
    return reveal.lit_nodes(nodes, field, edges, start)


@query(FOCUS_SQL)
def g11_focus(spark, sf):
    """What a focus on LITERAL_QUERY shows, in order: at most MAX_LIT nodes, as a focus has it."""
    return literal_focus(spark, sf).select("rank", "i", F.round("h", 6).alias("h"), "role")


@query(FITTING_SQL)
def e12_budgeted_focus(spark, sf):
    """The same as text within BUDGET tokens."""
    lit = cut(literal_focus(spark, sf), "lit")
    items = reveal.lines(lit)
    return reveal.fitting(items, len(f"focus {LITERAL_QUERY}\n"), lit.count(), len("\n...  more"), BUDGET)


# assembly ---------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT event_id % 1000 AS file, user_id AS line, event_id AS idx FROM events WHERE event_type = 'view'), x AS (SELECT event_id % 1000 AS file, user_id AS line, event_id AS site FROM events WHERE event_type <> 'view'),
j AS (SELECT x.site, s.idx, row_number() OVER (PARTITION BY x.site ORDER BY s.line DESC, s.idx DESC) AS r FROM x LEFT JOIN s ON s.file = x.file AND s.line <= x.line) SELECT site, idx FROM j WHERE r = 1""")
def c1_enclosing_symbol(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 1000).alias("file"), F.col("user_id").alias("line"), F.col("event_id"), "event_type")
    symbols = e.where("event_type = 'view'").select("file", "line", F.col("event_id").alias("idx"), F.col("event_id").alias("pos"))
    sites = e.where("event_type <> 'view'").select(F.col("event_id").alias("site"), "file", "line")
    return graph.enclosing(sites, symbols).select("site", "idx")


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n, round(sum(w), 4) AS w FROM edges GROUP BY kind")
def g1_graph_edges(spark, sf):
    _, edges = key_graph(spark, sf)
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


@query(f"WITH {NODES_SQL} SELECT kind, lang, count(*) AS n, count(DISTINCT file) AS files FROM nodes GROUP BY kind, lang")
def g1_graph_nodes(spark, sf):
    nodes, _ = key_graph(spark, sf)
    return nodes.groupBy("kind", "lang").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


CALLS_SQL = """defs AS (SELECT p_partkey AS idx, p_brand AS file, split_part(p_name, ' ', 1) || '.' || split_part(p_name, ' ', 2) AS name FROM part),
keys AS (SELECT DISTINCT idx, file, unnest([lower(name), lower(split_part(name, '.', 2))]) AS key FROM defs),
calls AS (SELECT s_suppkey AS call, 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) AS file, split_part(p_name, ' ', 1) || '.' || split_part(p_name, ' ', 2) AS callee FROM supplier JOIN part ON p_partkey = s_suppkey),
imports AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) AS file, 'Brand#' || ((s_suppkey + 1) % 5 + 1) || (s_suppkey % 4 + 1) AS target FROM supplier),
cand AS (SELECT c.call, c.file, k.idx, k.file AS def_file, count(*) OVER (PARTITION BY c.call) AS cands FROM calls c JOIN keys k ON k.key = lower(c.callee)),
tiers AS (SELECT *, CASE WHEN def_file = file THEN 0 WHEN (file, def_file) IN (SELECT (file, target) FROM imports) THEN 1 WHEN cands = 1 THEN 2 END AS tier FROM cand WHERE cands <= 48),
best AS (SELECT *, min(tier) OVER (PARTITION BY call) AS t FROM tiers WHERE tier IS NOT NULL),
chosen AS (SELECT *, count(*) OVER (PARTITION BY call) AS n FROM best WHERE tier = t)"""


@query(f"WITH {CALLS_SQL} SELECT call, idx AS \"to\", CASE WHEN cands <= 8 THEN 0.7 WHEN cands <= 24 THEN 0.45 ELSE 0.25 END::DOUBLE AS w FROM chosen WHERE n <= 3")
def c4_resolve_calls(spark, sf):
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    name = F.concat_ws(".", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)))
    defs = part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("file"), name.alias("name"))
    brand = lambda a, b: F.concat(F.lit("Brand#"), (a % 5 + 1).cast("string"), (b % 4 + 1).cast("string"))
    s = F.col("s_suppkey")
    calls = supplier.join(part, F.expr("p_partkey = s_suppkey")).select(s.alias("call"), brand(s, s).alias("file"), name.alias("callee"))
    imports = supplier.select(brand(s, s).alias("file"), brand(s + 1, s).alias("target"))
    return graph.resolve_calls(calls, defs, imports)


@query("""SELECT p_brand AS id, min(p_type) AS kind, count(*) AS sites, count(DISTINCT p_size) AS files, bool_and(p_size > 2) AS implicit,
round((CASE WHEN bool_and(p_size > 2) THEN 0.5 ELSE 1.0 END / sqrt(count(*)))::DOUBLE, 6) AS w, round(CASE WHEN count(DISTINCT p_size) BETWEEN 2 AND 12 THEN 0.35 / sqrt(count(DISTINCT p_size)) END::DOUBLE, 6) AS file_w FROM part GROUP BY p_brand""")
def d3_anchor_hubs(spark, sf):
    sites = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("node"), F.col("p_size").cast("string").alias("file"), F.lit(1).alias("line"), (F.col("p_size") > 2).alias("implicit"), F.concat_ws("|", "p_type", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("pos"))
    return graph.anchor_hubs(sites).select("id", "kind", "sites", "files", "implicit", F.round("w", 6).alias("w"), F.round("file_w", 6).alias("file_w"))


@query("""WITH h AS (SELECT p_brand AS id, count(*) AS n, count(DISTINCT p_size) AS f FROM part GROUP BY p_brand)
SELECT p_brand AS id, p_partkey AS node, NULL::VARCHAR AS file, round((1 / sqrt(n))::DOUBLE, 6) AS w FROM part JOIN h ON h.id = p_brand
UNION ALL SELECT DISTINCT p_brand, NULL::BIGINT, p_size::VARCHAR, round((0.35 / sqrt(f))::DOUBLE, 6) FROM part JOIN h ON h.id = p_brand WHERE f BETWEEN 2 AND 12""")
def c7_hub_edges(spark, sf):
    sites = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("node"), F.col("p_size").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(False).alias("implicit"), F.col("p_partkey").alias("pos"))
    return graph.hub_edges(sites, graph.anchor_hubs(sites)).select("id", "node", "file", F.round("w", 6).alias("w"))


# matrix and heat --------------------------------------------------------------------------------------------------
@query(f"WITH {EDGES_SQL}, {ADJ_SQL} SELECT i, round(d, 6) AS d, (SELECT count(*) FROM adj a WHERE a.i = deg.i) AS n FROM deg")
def d2_adjacency(spark, sf):
    _, edges = key_graph(spark, sf)
    return heat.adjacency(edges).groupBy("i").agg(F.round(F.sum("w"), 6).alias("d"), F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL}, {ADJ_SQL}, x AS ({SEED_SQL}) SELECT m.i, round(sum(m.m * x.v), 6) AS v FROM m JOIN x ON x.i = m.j GROUP BY m.i")
def c15_sparse_product(spark, sf):
    _, edges = key_graph(spark, sf)
    return heat.multiply(heat.scaled(heat.adjacency(edges)), seed_rows(spark)).select("i", F.round("v", 6).alias("v"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {ADJ_SQL}, {heat_sql(SEED_SQL, 2.0, 4, coefficients(2.0, 4))} SELECT k::INT AS k, count(*) AS n, round(sum(v * v), 6) AS energy FROM (SELECT 0 AS k, v FROM start UNION ALL SELECT k, cur FROM cheb) GROUP BY k")
def g2_chebyshev_vectors(spark, sf):
    """The recurrence by joins, each order written: the path of large graphs."""
    _, edges = key_graph(spark, sf)
    adj = heat.adjacency(edges)
    vectors = heat.chebyshev(adj, seed_rows(spark), 4, kernel_entries=0)
    return vectors.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("energy"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {ADJ_SQL}, {heat_sql(SEED_SQL, 2.0, 21, coefficients(2.0, 21))} SELECT i, round(v, 6) AS v FROM field")
def g3_heat_field(spark, sf):
    _, _, field = key_field(spark, sf)
    return field.select("i", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH RECURSIVE {EDGES_SQL}, {ADJ_SQL}, {heat_sql(SEED_SQL, 4.0, 25, coefficients(4.0, 25))} SELECT i, round(v, 6) AS v FROM field")
def g4_retimed_field(spark, sf):
    """The field at t = 4 from vectors kept for t = 2 and extended."""
    _, edges = key_graph(spark, sf)
    vectors = heat.Vectors(heat.adjacency(edges), seed_rows(spark)).extend(choose_order(2.0))
    return vectors.field(4.0).select("i", (F.round("v", 6) + 0.0).alias("v"))


@query(values("t DOUBLE, terms INT", [(2.0, 21), (4.0, 25), (16.0, 52), (64.0, 90)]))
def b26_choose_order(spark, sf):
    return spark.createDataFrame([(t, choose_order(t)) for t in (2.0, 4.0, 16.0, 64.0)], "t double, terms int")


@query(values("k INT, t DOUBLE, value DOUBLE", [(0, 3.0, 4.880793), (1, 3.0, 3.95337), (5, 10.0, 777.188286), (0, 0.0, 1.0)]))
def b27_bessel(spark, sf):
    return spark.createDataFrame([(k, t, round(bessel_i(k, t), 6)) for k, t in ((0, 3.0), (1, 3.0), (5, 10.0), (0, 0.0))], "k int, t double, value double")


@query(values("k INT, c DOUBLE", [(0, 0.308508), (1, -0.430539), (2, 0.186478)]))
def b27_coefficients(spark, sf):
    return spark.createDataFrame([(k, round(coefficient(k, 2.0), 6)) for k in range(3)], "k int, c double")


# reveal -----------------------------------------------------------------------------------------------------------
#: Seeds whose reveal has all tiers: two nations.
WIDE = [(101, 1.0), (102, 1.0)]
WIDE_SQL = "SELECT * FROM (VALUES (101::BIGINT, 1.0::DOUBLE), (102::BIGINT, 1.0::DOUBLE)) AS s(i, v)"
REL_BODY = f"""rel AS (SELECT CASE WHEN a IN (SELECT i FROM seeds) THEN b ELSE a END AS node, kind, {PRIORITY} AS priority, w, CASE WHEN a IN (SELECT i FROM seeds) THEN a ELSE b END AS seed FROM edges
  WHERE (a IN (SELECT i FROM seeds)) <> (b IN (SELECT i FROM seeds)))"""
REL_SQL = f"seeds(i) AS (VALUES (2000001), (2000002), (2000003)), {REL_BODY}"


@query(f"WITH {EDGES_SQL}, {REL_SQL} SELECT node, max(priority) AS priority, arg_max(kind, priority) AS kind, max(w) AS w FROM rel GROUP BY node")
def e4_direct_relations(spark, sf):
    _, edges = key_graph(spark, sf)
    return reveal.direct_relations(edges, seed_rows(spark)).select("node", "priority", "kind", "w")


@query(f"WITH {EDGES_SQL}, {REL_SQL} SELECT kind, count(*) AS n FROM rel GROUP BY kind")
def c11_seed_edges(spark, sf):
    """Edges with exactly one end among the seeds."""
    _, edges = key_graph(spark, sf)
    return reveal.seed_edges(edges, seed_rows(spark)).groupBy("kind").agg(F.count("*").alias("n"))


FIELD_SQL = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {ADJ_SQL}, {heat_sql(SEED_SQL, 2.0, 21, coefficients(2.0, 21))}, {REL_SQL}"
WIDE_FIELD_SQL = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {ADJ_SQL}, {heat_sql(WIDE_SQL, 2.0, 21, coefficients(2.0, 21))}, seeds(i) AS (VALUES (101), (102)), {REL_BODY}"
LIT_SQL = f"""{WIDE_FIELD_SQL}, best AS (SELECT node, arg_max(kind, priority) AS kind FROM rel GROUP BY node),
lit AS (SELECT n.*, f.v, f.v / (SELECT max(v) FROM field) AS h, n.i IN (SELECT i FROM seeds) AS is_seed, coalesce(best.kind <> 'contains', false) AS semantic FROM nodes n JOIN field f ON f.i = n.i LEFT JOIN best ON best.node = n.i),
kept AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN is_seed THEN 2 WHEN semantic THEN 1 ELSE 0 END DESC, round(v, 10) DESC, file, line, name, i) AS rank FROM lit WHERE semantic OR (h >= 0.002 AND v >= 1e-9)),
capped AS (SELECT *, CASE WHEN is_seed THEN 'focus' WHEN semantic THEN 'direct' WHEN h >= 0.3 THEN 'hot' WHEN h >= 0.02 THEN 'warm' ELSE 'glow' END AS tier FROM kept WHERE rank <= 400),
shown AS (SELECT *, CASE WHEN tier = 'warm' AND kind <> 'file' AND count(*) FILTER (tier = 'warm' AND kind <> 'file') OVER (PARTITION BY file ORDER BY rank) > 4 THEN 'glow' ELSE tier END AS role FROM capped)"""


@query(f"{LIT_SQL} SELECT tier, count(*) AS n FROM (SELECT CASE WHEN is_seed THEN 'focus' WHEN semantic THEN 'direct' WHEN h >= 0.3 THEN 'hot' WHEN h >= 0.02 THEN 'warm' WHEN h >= 0.002 AND v >= 1e-9 THEN 'glow' ELSE 'dark' END AS tier FROM lit) GROUP BY tier")
def g12_tiers(spark, sf):
    """All nodes by tier, before any cap."""
    nodes, edges, field = key_field(spark, sf, WIDE)
    return reveal.tiered(nodes, field, edges, seed_rows(spark, WIDE)).groupBy("tier").agg(F.count("*").alias("n"))


def key_lit(spark, sf):
    nodes, edges, field = key_field(spark, sf, WIDE)
    nodes = nodes.withColumn("line_approx", F.lit(False)).withColumn("sig", F.col("name"))
    return reveal.lit_nodes(nodes, field, edges, seed_rows(spark, WIDE))


@query(f"{LIT_SQL} SELECT is_seed, semantic, kind, count(*) AS n, round(sum(h), 4) AS h FROM capped GROUP BY ALL")
def e5_lit_order(spark, sf):
    """The first MAX_LIT nodes of the reveal order, summed up so that ties at its end don't show."""
    return key_lit(spark, sf).groupBy("is_seed", "semantic", "kind").agg(F.count("*").alias("n"), F.round(F.sum("h"), 4).alias("h"))


@query(f"{LIT_SQL} SELECT role, count(*) AS n FROM shown GROUP BY role")
def e3_warm_per_file(spark, sf):
    return key_lit(spark, sf).groupBy("role").agg(F.count("*").alias("n"))


@query(f"{LIT_SQL} SELECT split_part(file, '/', 1) AS top, count(*) AS n FROM shown WHERE role = 'glow' GROUP BY ALL")
def d16_glow_counts(spark, sf):
    return key_lit(spark, sf).where("role = 'glow'").groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("n"))


@query(values("path VARCHAR, start BIGINT, lines BIGINT, reason VARCHAR", [("a.ts", 5, 45, "matched focus"), ("b.py", 1, 25, "hot neighbor"), ("a.ts", 95, 25, "→ callee")]))
def e11_suggested_reads(spark, sf):
    rows = [(1, "a.ts", 10, False, "focus", None), (2, "b.py", 3, False, "hot", None), (3, "a.ts", 30, False, "direct", "→ callee"), (4, "a.ts", 100, False, "direct", "→ callee"), (5, "c.go", 0, False, "hot", None), (6, "d.go", 9, True, "hot", None)]
    return reveal.suggested_reads(spark.createDataFrame(rows, "rank int, file string, line int, line_approx boolean, role string, relation string"))


# seeds ------------------------------------------------------------------------------------------------------------
ASKED = "Supplier#000000001"


@query(f"WITH {NODES_SQL} SELECT i, CASE WHEN lower(name) = lower('{ASKED}') THEN 1.0 WHEN lower(name) LIKE lower('{ASKED}') || '%' THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM nodes WHERE kind NOT IN ('file', 'anchor') AND contains(lower(name), lower('{ASKED}'))")
def c10_substring_match(spark, sf):
    nodes, _ = key_graph(spark, sf)
    return seeds.substring_seeds(nodes, ASKED)


@query(f"WITH {NODES_SQL}, x AS (SELECT i, file, 0.9::DOUBLE AS score FROM nodes WHERE kind = 'anchor' AND (split_part(name, ' ', 2) = '/brand' OR split_part(name, ' ', 2) LIKE '/brand/%') UNION ALL SELECT i, file, CASE WHEN starts_with(lower(name), 'customer#00000000') THEN 0.8 ELSE 0.5 END FROM nodes WHERE kind NOT IN ('file', 'anchor') AND contains(lower(name), 'customer#00000000')) SELECT count(*) AS n, max(score) AS best, min(score) AS least FROM (SELECT * FROM x ORDER BY score DESC, file, i LIMIT 16)")
def f1_resolve_seeds(spark, sf):
    """A question without exact answers: substrings, best MAX_SEEDS."""
    nodes, _ = key_graph(spark, sf)
    occ = spark.createDataFrame([], "key string, node long")
    keys = spark.createDataFrame([], "key string, cls string")
    found = seeds.resolve(nodes, keys, occ, "Customer#00000000")
    return found.agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("least"))


@query(f"WITH {NODES_SQL}, x AS (SELECT i, file, 1.0::DOUBLE AS score FROM nodes WHERE kind NOT IN ('file', 'anchor') AND lower(name) = lower('{ASKED}')) SELECT i, score FROM x ORDER BY score DESC, file, i LIMIT 16")
def e7_seed_ranking(spark, sf):
    nodes, _ = key_graph(spark, sf)
    return seeds.resolve(nodes, spark.createDataFrame([], "key string, cls string"), spark.createDataFrame([], "key string, node long"), ASKED)


@query(f"WITH {SIMILAR_SQL} SELECT p_partkey AS i, name, p_brand AS file, round(score, 6) AS score FROM scored WHERE score >= {fixed.SUGGEST_AT} ORDER BY scored.score DESC, name, p_brand, p_partkey LIMIT 5")
def e8_suggestions(spark, sf):
    """The five names most like a question that nothing answers."""
    nodes = part_names(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("file")), F.expr("i = p_partkey"))
    found = seeds.suggestions(nodes.select("i", "name", "file", F.lit("function").alias("kind"), F.lit("Go").alias("lang")), ASKED_NAME)
    return found.select("i", "name", "file", F.round("score", 6).alias("score"))


# sketch -----------------------------------------------------------------------------------------------------------
DIR_SQL = "CASE len(string_split(file, '/')) WHEN 1 THEN '(root)' WHEN 2 THEN string_split(file, '/')[1] || '/' ELSE string_split(file, '/')[1] || '/' || string_split(file, '/')[2] || '/' END"


@query(f"{FIELD_SQL} SELECT {DIR_SQL} AS label, round(sum(v), 5) AS mass, count(DISTINCT file) AS files FROM nodes JOIN field ON field.i = nodes.i WHERE kind <> 'anchor' GROUP BY ALL")
def d8_directory_mass(spark, sf):
    from emberline.operators.sketch import directory_groups

    nodes, _, field = key_field(spark, sf)
    none = spark.createDataFrame([], "i long")
    return directory_groups(nodes, field, none).select("label", F.round("mass", 5).alias("mass"), "files")


@query(f"{FIELD_SQL}, r AS (SELECT {DIR_SQL} AS label, name, kind, row_number() OVER (PARTITION BY {DIR_SQL}, kind <> 'file' ORDER BY round(v, 10) DESC, nodes.i) AS k FROM nodes JOIN field ON field.i = nodes.i WHERE kind <> 'anchor') SELECT label, coalesce(string_agg(name, ', ' ORDER BY k) FILTER (kind <> 'file' AND k <= 3), '') AS top FROM r GROUP BY label")
def e2_top_names(spark, sf):
    """The three warmest symbols of each directory."""
    from emberline.operators.sketch import directory_groups

    nodes, _, field = key_field(spark, sf)
    return directory_groups(nodes, field, spark.createDataFrame([], "i long")).select("label", "top")


@query(f"WITH {EDGES_SQL}, near AS (SELECT a AS i, b AS j, kind, w FROM edges UNION ALL SELECT b, a, kind, w FROM edges), r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY kind = 'contains', w DESC, j) AS k FROM near), few AS (SELECT * FROM r WHERE k <= 12), links AS (SELECT DISTINCT i, j FROM near), p AS (SELECT x.i, x.j, y.j AS j2 FROM few x JOIN few y ON x.i = y.i AND x.k < y.k), t AS (SELECT p.i, avg((l.i IS NOT NULL)::INT) AS tri FROM p LEFT JOIN links l ON l.i = p.j AND l.j = p.j2 GROUP BY p.i) SELECT n.i, n.deg, round(coalesce(tri, 0), 6)::DOUBLE AS tri FROM (SELECT i, count(*) AS deg FROM near GROUP BY i) n LEFT JOIN t ON t.i = n.i")
def d13_triangle_density(spark, sf):
    _, edges = key_graph(spark, sf)
    return basins.triangle_density(basins.ends(edges)).select("i", "deg", F.round("tri", 6).alias("tri"))


CLIQUES = [(a, b, 1.0) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 5, 0.05)]


@query(values("seed BIGINT, place BIGINT, member BIGINT", [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (6, 0, 6), (6, 1, 7), (6, 2, 8), (6, 3, 9), (6, 4, 5)]))
def g8_regions(spark, sf):
    """Regions of two five-cliques joined by a weak edge."""
    edges = spark.createDataFrame([(k, a, b, "invokes", w) for k, (a, b, w) in enumerate(CLIQUES)], "pos long, a long, b long, kind string, w double")
    near = basins.ends(edges)
    return basins.grow(near, basins.candidates(near, heat.degrees(heat.adjacency(edges))), 10)


@query(f"{FIELD_SQL} SELECT label, mass, rank FROM (SELECT label, round(mass, 5) AS mass, row_number() OVER (ORDER BY round(mass, 5) DESC, label) AS rank FROM (SELECT {DIR_SQL} AS label, sum(v) AS mass FROM nodes JOIN field ON field.i = nodes.i WHERE kind <> 'anchor' GROUP BY ALL))")
def f0_group_order(spark, sf):
    from emberline.operators.sketch import directory_groups

    nodes, _, field = key_field(spark, sf)
    groups = directory_groups(nodes, field, spark.createDataFrame([], "i long")).select("label", F.round("mass", 5).alias("mass"))
    return global_rank(groups.withColumn("down", -F.col("mass")), "down", "label").select("label", "mass", "rank")


SKETCH_CTES = f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {ADJ_SQL}, near AS (SELECT a AS i, b AS j FROM edges UNION ALL SELECT b, a FROM edges UNION ALL SELECT i, i FROM nodes),
closure AS (SELECT h.i, h.name, h.file || ':' || h.line AS spot, n.i AS j, n.file FROM nodes h JOIN near ON near.i = h.i JOIN nodes n ON n.i = near.j WHERE h.kind = 'anchor'),
production AS (SELECT i FROM closure GROUP BY i HAVING bool_or(NOT {SCOPE})),
hubs AS (SELECT nodes.i FROM nodes JOIN deg ON deg.i = nodes.i WHERE NOT {SCOPE} ORDER BY round(d, 9) DESC, nodes.i LIMIT {fixed.MAX_HUBS}),
opening AS (SELECT i, min(o) AS o FROM (SELECT i, 0 AS o FROM production UNION ALL SELECT i, 1 FROM hubs) GROUP BY i ORDER BY o, i LIMIT {fixed.MAX_SKETCH_SEEDS})"""
SKETCH_SQL = f"""{SKETCH_CTES},
{heat_sql("SELECT i, 1.0::DOUBLE AS v FROM opening", 16.0, choose_order(16.0), coefficients(16.0, choose_order(16.0)))},
dirs AS (SELECT nodes.*, v, {DIR_SQL} AS label, row_number() OVER (PARTITION BY {DIR_SQL}, kind <> 'file' ORDER BY round(v, 10) DESC, nodes.i) AS k FROM nodes JOIN field ON field.i = nodes.i WHERE kind <> 'anchor' AND nodes.i NOT IN (SELECT j FROM closure))
SELECT '⚑ ' || name AS label, round(sum(v), 4) AS mass, count(*) || ' nodes · ' || count(DISTINCT file) || ' files · ' || spot AS detail FROM closure JOIN field ON field.i = closure.j WHERE closure.i IN (SELECT i FROM production) GROUP BY closure.i, name, spot
UNION ALL SELECT label, round(sum(v) * CASE WHEN bool_and({SCOPE}) THEN 0.1 ELSE 1 END, 4), count(DISTINCT file) || ' files · top: ' || coalesce(string_agg(name, ', ' ORDER BY k) FILTER (kind <> 'file' AND k <= 3), '') FROM dirs GROUP BY label"""


@query(SKETCH_SQL)
def g10_sketch(spark, sf):
    """Groups of the whole key graph by mass: routes with what they reach, and directories."""
    from emberline.operators.sketch import sketch

    nodes, edges = key_graph(spark, sf)
    return sketch(nodes, edges).select("label", F.round("mass", 4).alias("mass"), "detail")


@query(f"{SKETCH_CTES} SELECT i FROM opening")
def e6_hubs(spark, sf):
    """The seeds of a sketch: routes of production code, then the MAX_HUBS nodes of the highest degree outside tests."""
    from emberline.operators.sketch import closures, opening_seeds

    nodes, edges = key_graph(spark, sf)
    routes = closures(nodes, edges).where(~text.is_test_scope(F.col("file"))).select("i").distinct()
    return opening_seeds(nodes, heat.degrees(heat.adjacency(edges)), routes)


@query(f"{SKETCH_CTES}, {heat_sql(SEED_SQL, 2.0, 21, coefficients(2.0, 21))} SELECT closure.i AS hub, round(sum(v), 6) AS mass, count(*) AS nodes, count(DISTINCT file) AS files FROM closure JOIN field ON field.i = closure.j GROUP BY closure.i")
def d9_anchor_closures(spark, sf):
    """What each route reaches, with its mass in the seeds' field."""
    from emberline.operators.sketch import closure_mass, closures

    nodes, edges, field = key_field(spark, sf)
    return closure_mass(closures(nodes, edges), field).select(F.col("i").alias("hub"), F.round("mass", 6).alias("mass"), F.col("k").alias("nodes"), "files")


# impact -----------------------------------------------------------------------------------------------------------
IMPACT_SQL = f"""{FIELD_SQL}, sf AS (SELECT DISTINCT file FROM nodes WHERE i IN (SELECT i FROM seeds)),
warm AS (SELECT n.*, f.v, CASE WHEN n.file IN (SELECT file FROM sf) THEN 'seed' WHEN kind = 'anchor' THEN 'anchor' ELSE 'other' END AS place FROM nodes n JOIN field f ON f.i = n.i WHERE n.i NOT IN (SELECT i FROM seeds) AND v > 1e-6)"""


@query(f"{IMPACT_SQL} SELECT file, round(sum(v), 6) AS mass FROM warm WHERE place = 'other' GROUP BY file")
def d7_file_mass(spark, sf):
    nodes, _, field = key_field(spark, sf)
    return impact.file_mass(impact.masses(nodes, field, seed_rows(spark))).select("file", F.round("mass", 6).alias("mass"))


REASON_SQL = "CASE e.kind WHEN 'invokes' THEN 'call dependency' WHEN 'imports' THEN 'import dependency' ELSE 'shared route' END"


@query(f"""{IMPACT_SQL}, mass AS (SELECT file, sum(v) AS mass FROM warm WHERE place = 'other' GROUP BY file),
named AS (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY round(v, 10) DESC, i) AS k FROM warm WHERE place = 'other' AND kind <> 'file'),
top AS (SELECT file, string_agg(name, ', ' ORDER BY k) AS top FROM named WHERE k <= 3 GROUP BY file),
crossing AS (SELECT p.file AS fa, q.file AS fb, {REASON_SQL} AS reason FROM edges e JOIN nodes p ON p.i = e.a JOIN nodes q ON q.i = e.b WHERE p.file <> q.file AND e.kind <> 'contains'),
told AS (SELECT CASE WHEN fa IN (SELECT file FROM sf) THEN fb ELSE fa END AS file, reason FROM crossing WHERE (fa IN (SELECT file FROM sf)) <> (fb IN (SELECT file FROM sf))),
why AS (SELECT file, string_agg(DISTINCT reason, ', ' ORDER BY reason) AS reasons FROM told GROUP BY file)
SELECT mass.file, round(mass, 6) AS mass, coalesce(top, '') AS top, coalesce(reasons, '{fixed.NO_REASON}') AS reasons, row_number() OVER (ORDER BY round(mass, 9) DESC, mass.file) AS rank FROM mass LEFT JOIN top ON top.file = mass.file LEFT JOIN why ON why.file = mass.file""")
def g9_impact(spark, sf):
    """The files that a change of the seeds warms, in the order of review, with their warmest names and what ties them to it."""
    nodes, edges, field = key_field(spark, sf)
    warm = impact.masses(nodes, field, seed_rows(spark))
    found = impact.reviewed(impact.file_mass(warm), impact.direct_reasons(edges, nodes, seed_rows(spark)))
    ranked = global_rank(found.withColumn("down", -F.round("mass", 9)), "down", "file")
    return ranked.select("file", F.round("mass", 6).alias("mass"), "top", F.array_join(F.sort_array("reasons"), ", ").alias("reasons"), "rank")


@query(f"{IMPACT_SQL} SELECT place, count(*) AS n, round(sum(v), 5) AS mass FROM warm GROUP BY place")
def g9_warm_places(spark, sf):
    nodes, _, field = key_field(spark, sf)
    return impact.masses(nodes, field, seed_rows(spark)).groupBy("place").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("mass"))


@query(f"WITH {GRAPH}, {REL_SQL}, sf AS (SELECT DISTINCT file FROM nodes WHERE i IN (SELECT i FROM seeds)), x AS (SELECT e.kind, p.file AS fa, q.file AS fb, e.a, e.b FROM edges e JOIN nodes p ON p.i = e.a JOIN nodes q ON q.i = e.b WHERE p.file <> q.file AND e.kind <> 'contains') SELECT CASE WHEN fa IN (SELECT file FROM sf) THEN b ELSE a END AS node, CASE kind WHEN 'invokes' THEN 'call dependency' WHEN 'imports' THEN 'import dependency' ELSE 'shared route' END AS reason, count(*) AS n FROM x WHERE (fa IN (SELECT file FROM sf)) <> (fb IN (SELECT file FROM sf)) GROUP BY ALL")
def g7_direct_reasons(spark, sf):
    nodes, edges = key_graph(spark, sf)
    return impact.direct_reasons(edges, nodes, seed_rows(spark)).groupBy("node", "reason").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES_SQL}, near AS (SELECT a AS i, b AS j FROM edges UNION SELECT b, a FROM edges), bfs(i, level) AS (SELECT i, 0 FROM ({SEED_SQL}) UNION SELECT near.j, level + 1 FROM bfs JOIN near ON near.i = bfs.i WHERE level < 16) SELECT level::INT AS level, count(*) AS n FROM (SELECT i, min(level) AS level FROM bfs GROUP BY i) GROUP BY level")
def g6_path_reasons(spark, sf):
    _, edges = key_graph(spark, sf)
    x = impact.path_reasons(edges, seed_rows(spark).select("i", F.col("i").alias("pos")))
    return x.groupBy("level").agg(F.count("*").alias("n"))


@query(f"{IMPACT_SQL} SELECT count(*) AS n, round(sum(m), 4) AS m FROM (SELECT round(v, 6) AS m FROM warm WHERE place <> 'seed' ORDER BY round(v, 6) DESC LIMIT {fixed.MAX_WARMED})")
def e9_warmed_cap(spark, sf):
    nodes, _, field = key_field(spark, sf)
    none = spark.createDataFrame([], "node long, r array<string>")
    return impact.warmed(impact.masses(nodes, field, seed_rows(spark)), none).agg(F.count("*").alias("n"), F.round(F.sum("m"), 4).alias("m"))
