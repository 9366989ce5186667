"""The driver's tables as the relations that operators take, each in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# paths made of documents ------------------------------------------------------------------------------------------
PATH_SQL = """(source || '/' || CASE WHEN doc_id % 11 = 0 THEN 'node_modules' WHEN doc_id % 7 = 0 THEN 'tests' ELSE lang END || '/' ||
 CASE doc_id % 8 WHEN 0 THEN 'f' || doc_id || '.py' WHEN 1 THEN 'f' || doc_id || '.test.ts' WHEN 2 THEN 'f' || doc_id || '_test.go'
 WHEN 3 THEN 'README' || doc_id || '.md' WHEN 4 THEN 'yarn.lock' WHEN 5 THEN 'lib' || doc_id || '.so' WHEN 6 THEN 'app/x' || doc_id || '/page.tsx'
 ELSE 'f' || doc_id || '.min.js' END)"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH_SQL).alias("file"), "text")


FILES_SQL = f"SELECT doc_id, {PATH_SQL} AS file, text FROM documents"


# quoted literals of pages -----------------------------------------------------------------------------------------
def page_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, text, node, pos: distinct quoted strings of each line of each page; pos orders them."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))
    found = lines.select("page_id", (F.col("n") + 1).alias("line"), F.explode(F.expr(r"""regexp_extract_all(line, '"([^"\\n]{2,200})"', 1)""")).alias("text")).distinct()
    pos = F.concat_ws("|", F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lpad(F.col("line").cast("string"), 8, "0"), "text")
    return found.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), "line", "text", F.col("page_id").alias("node"), pos.alias("pos"))


LITERALS_SQL = r"""lines AS (
  SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) AS line, unnest(string_split(html, chr(10))) AS t FROM pages
), lits AS (
  SELECT DISTINCT page_id AS node, 'page/' || page_id AS file, line, unnest(regexp_extract_all(t, '"([^"\n]{2,200})"', 1)) AS text FROM lines
)"""


def class_sql(text: str) -> str:
    t = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    return rf"""CASE WHEN length({t}) < 3 OR length({t}) > 200 THEN NULL
 WHEN regexp_matches({t}, '{fixed.ENV_TOKEN}') THEN 'env'
 WHEN regexp_matches(regexp_replace({t}, '{fixed.ORIGIN}', ''), '{fixed.PATH_TOKEN}') THEN 'path'
 WHEN regexp_matches({t}, '{fixed.WORD_TOKEN}') AND (contains({t}, '.') OR contains({t}, '::') OR contains({t}, '-') OR contains({t}, '_') OR regexp_matches({t}[2:], '[A-Z][a-z]')) THEN 'word' END"""


def norm_sql(text: str, cls: str) -> str:
    t = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    joined = rf"array_to_string(list_transform(string_split(regexp_replace({t}, '{fixed.ORIGIN}', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '{fixed.PLACEHOLDER}') THEN '{{*}}' ELSE s END), '/')"
    return f"CASE {cls} WHEN 'env' THEN upper({t}) WHEN 'word' THEN {t} ELSE CASE WHEN length({joined}) > 1 AND {joined} LIKE '%/' THEN {joined}[:-2] ELSE {joined} END END"


KEYS_SQL = f"""{LITERALS_SQL}, told AS (
  SELECT *, {class_sql("text")} AS cls FROM lits
), keyed AS (
  SELECT *, {norm_sql("text", "cls")} AS key FROM told WHERE cls IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key, file ORDER BY node, line, text) AS r FROM keyed
), occ AS (
  SELECT key, file, cls, node, line, text FROM ranked WHERE r = 1
), keys AS (
  SELECT key, arg_min(cls, lpad(node::VARCHAR, 12, '0') || '|' || lpad(line::VARCHAR, 8, '0') || '|' || text) AS cls, count(*) AS df,
         least(1.0::DOUBLE, ln((SELECT count(*) FROM occ)::DOUBLE / count(*)) / ln(greatest((SELECT count(*) FROM occ), 2)::DOUBLE)) AS spec
  FROM occ GROUP BY key
), weighted AS (
  SELECT *, CASE cls WHEN 'path' THEN 1.0::DOUBLE WHEN 'env' THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END * (0.25 + 0.75 * spec) / greatest(1.0::DOUBLE, df / 6.0::DOUBLE) AS w FROM keys
), edges AS (
  SELECT a.node AS a, b.node AS b, max(w) AS w FROM occ a JOIN occ b ON a.key = b.key AND a.node < b.node
  JOIN weighted k ON k.key = a.key WHERE k.df BETWEEN 2 AND 48 GROUP BY a.node, b.node
)"""


# a graph of business keys -----------------------------------------------------------------------------------------
NODES_SQL = """nodes AS (
  SELECT r_regionkey::BIGINT AS i, 'file:region/' || r_name AS id, r_name AS name, 'file' AS kind, 'region/' || r_name AS file, 0 AS line, 'config' AS lang FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name || '@nation/' || n_name, n_name, 'file', 'nation/' || n_name, 0, 'config' FROM nation
  UNION ALL SELECT 1000000 + c_custkey, c_name || '@' || n_name, c_name, 'function', 'nation/' || n_name, (c_custkey % 500)::INT + 1, 'Python' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 2000000 + s_suppkey, s_name || '@' || n_name, s_name, 'class', 'nation/' || n_name, (s_suppkey % 500)::INT + 1, 'Go' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 10000000 + p_partkey, p_name || p_partkey || '@part', p_name, 'method', 'part/' || p_type || '/' || p_brand, (p_partkey % 900)::INT + 1, 'Rust' FROM part
  UNION ALL SELECT DISTINCT 500000 + regexp_extract(p_brand, '[0-9]+', 0)::BIGINT, 'anchor:GET /' || p_brand, 'GET /' || p_brand, 'anchor', 'brand/' || p_brand, 1, 'anchor' FROM part
)"""
EDGES_SQL = """sp AS (
  SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem
), spn AS (
  SELECT s, p, count(*) OVER (PARTITION BY p) AS n FROM sp
), brands AS (
  SELECT 500000 + regexp_extract(p_brand, '[0-9]+', 0)::BIGINT AS hub, p_partkey AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part
), edges AS (
  SELECT 100 + c_nationkey::BIGINT AS a, 1000000 + c_custkey AS b, 'contains' AS kind, 1.0::DOUBLE AS w FROM customer
  UNION ALL SELECT 100 + s_nationkey::BIGINT, 2000000 + s_suppkey, 'contains', 1.0 FROM supplier
  UNION ALL SELECT 100 + n_nationkey::BIGINT, n_regionkey::BIGINT, 'imports', 0.3 FROM nation
  UNION ALL SELECT 2000000 + s, 10000000 + p, 'invokes', CASE WHEN n <= 8 THEN 0.7 WHEN n <= 24 THEN 0.45 ELSE 0.25 END FROM spn WHERE n <= 48
  UNION ALL SELECT hub, 10000000 + p, 'anchors', 1.0 / sqrt(n) FROM brands
)"""


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (i, id, name, kind, file, line, lang) and edges (pos, a, b, kind, w)."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, i, id_, name, kind, file, line, lang: df.select(F.expr(i).cast("long").alias("i"), F.expr(id_).alias("id"), F.expr(name).alias("name"), F.lit(kind).alias("kind"), F.expr(file).alias("file"), F.expr(line).cast("int").alias("line"), F.lit(lang).alias("lang"))
    nation = t("nation").select("n_nationkey", "n_name")
    brand = "500000 + cast(regexp_extract(p_brand, '[0-9]+', 0) as bigint)"
    nodes = [
        node(t("region"), "r_regionkey", "concat('file:region/', r_name)", "r_name", "file", "concat('region/', r_name)", "0", "config"),
        node(t("nation"), "100 + n_nationkey", "concat(n_name, '@nation/', n_name)", "n_name", "file", "concat('nation/', n_name)", "0", "config"),
        node(t("customer").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey")), "1000000 + c_custkey", "concat(c_name, '@', n_name)", "c_name", "function", "concat('nation/', n_name)", "c_custkey % 500 + 1", "Python"),
        node(t("supplier").join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey")), "2000000 + s_suppkey", "concat(s_name, '@', n_name)", "s_name", "class", "concat('nation/', n_name)", "s_suppkey % 500 + 1", "Go"),
        node(t("part"), "10000000 + p_partkey", "concat(p_name, p_partkey, '@part')", "p_name", "method", "concat('part/', p_type, '/', p_brand)", "p_partkey % 900 + 1", "Rust"),
        node(t("part"), brand, "concat('anchor:GET /', p_brand)", "concat('GET /', p_brand)", "anchor", "concat('brand/', p_brand)", "1", "anchor").distinct(),
    ]
    sp = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    per = sp.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") <= fixed.MAX_CANDIDATES).toDF("n_p", "n")
    spn = sp.join(per, sp["p"] == per["n_p"])
    of_brand = t("part").groupBy("p_brand").agg(F.count("*").alias("n")).toDF("n_brand", "n")
    brands = t("part").select("p_brand", "p_partkey").join(F.broadcast(of_brand), F.col("p_brand") == F.col("n_brand"))  # a brand is two digits: 100 rows at most
    edge = lambda df, a, b, kind, w: df.select(F.expr(a).cast("long").alias("a"), F.expr(b).cast("long").alias("b"), F.lit(kind).alias("kind"), F.expr(w).cast("double").alias("w"))
    edges = [
        edge(t("customer"), "100 + c_nationkey", "1000000 + c_custkey", "contains", "1.0"),
        edge(t("supplier"), "100 + s_nationkey", "2000000 + s_suppkey", "contains", "1.0"),
        edge(t("nation"), "100 + n_nationkey", "n_regionkey", "imports", "0.3"),
        edge(spn, "2000000 + s", "10000000 + p", "invokes", "case when n <= 8 then 0.7 when n <= 24 then 0.45 else 0.25 end"),
        edge(brands, brand, "10000000 + p_partkey", "anchors", "1 / sqrt(n)"),
    ]
    union = lambda x: x[0] if len(x) == 1 else union(x[:-1]).unionByName(x[-1])
    return union(nodes), union(edges).withColumn("pos", F.xxhash64("a", "b", "kind"))


ADJ_SQL = """half AS (
  SELECT least(a, b) AS x, greatest(a, b) AS y, max(w) AS w FROM edges WHERE a <> b GROUP BY least(a, b), greatest(a, b)
), adj AS (
  SELECT x AS i, y AS j, w FROM half UNION ALL SELECT y, x, w FROM half
), deg AS (
  SELECT i, sum(w) AS d FROM adj GROUP BY i
), m AS (
  SELECT adj.i, adj.j, -adj.w / sqrt(p.d * q.d) AS m FROM adj JOIN deg p ON p.i = adj.i JOIN deg q ON q.i = adj.j
)"""


def heat_sql(seeds: str, t: float, order: int, coefficients: list[float]) -> str:
    """CTEs up to field(i, v): the Chebyshev series as a recursive query. seeds is SQL for (i, v)."""
    c = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(coefficients))
    return f"""coef(k, c) AS (VALUES {c}), seed AS ({seeds}), ids AS (SELECT DISTINCT i FROM (SELECT i FROM m UNION ALL SELECT i FROM seed)),
start AS (SELECT ids.i, coalesce(s.v, 0)::DOUBLE AS v FROM ids LEFT JOIN seed s ON s.i = ids.i),
one AS (SELECT start.i, coalesce(sum(m.m * o.v), 0)::DOUBLE AS v FROM start LEFT JOIN m ON m.i = start.i LEFT JOIN start o ON o.i = m.j GROUP BY start.i),
cheb(k, i, cur, prev) AS (
  SELECT 1, one.i, one.v, start.v FROM one JOIN start ON start.i = one.i
  UNION ALL
  SELECT any_value(k) + 1, i, 2 * sum(mv) - sum(pv), sum(cv) FROM (
    SELECT cheb.k, m.i, m.m * cheb.cur AS mv, 0.0::DOUBLE AS pv, 0.0::DOUBLE AS cv FROM cheb JOIN m ON m.j = cheb.i WHERE cheb.k < {order}
    UNION ALL
    SELECT cheb.k, cheb.i, 0.0, cheb.prev, cheb.cur FROM cheb WHERE cheb.k < {order}
  ) GROUP BY i
), field AS (
  SELECT i, sum(c * v) AS v FROM (SELECT 0 AS k, i, v FROM start UNION ALL SELECT k, i, cur FROM cheb) JOIN coef USING (k) GROUP BY i
)"""


# commits made of orders -------------------------------------------------------------------------------------------
COMMITS_SQL = "commits AS (SELECT l_orderkey AS commit, o_orderdate AS ts, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, ts, file."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey")).select(F.col("l_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("l_partkey").alias("file"))


# drift made of documents ------------------------------------------------------------------------------------------
DRIFT_SQL = """before AS (SELECT source || '/' || doc_id AS file, text FROM documents),
after AS (
  SELECT source || '/' || doc_id AS file, CASE doc_id % 10 WHEN 3 THEN text || ' extra' WHEN 5 THEN replace(text, ' ', '  ') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7
  UNION ALL SELECT 'new/' || doc_id, text FROM documents WHERE doc_id % 10 = 1
)"""


def drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(file, text) before and after deterministic edits."""
    d = table(spark, sf_dir, "documents")
    path = F.expr("source || '/' || doc_id").alias("file")
    k = F.col("doc_id") % 10
    text = F.when(k == 3, F.concat("text", F.lit(" extra"))).when(k == 5, F.replace(F.col("text"), F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    after = d.where(k != 7).select(path, text.alias("text")).unionByName(d.where(k == 1).select(F.expr("'new/' || doc_id").alias("file"), "text"))
    return d.select(path, "text"), after
