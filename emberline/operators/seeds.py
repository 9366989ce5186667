"""From a question to seed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import in_scope, literal_class, normal_literal, same_terms, similarity, trimmed
from emberline.operators.graph import name_keys


def _symbols(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin("file", "anchor"))


def literal_seeds(keys: DataFrame, occ: DataFrame, query: str) -> DataFrame:
    """i, score: 1 at occurrences of the query as a literal, 0.8 at those of paths below it."""
    q = F.lit(query)
    cls = literal_class(q)
    norm = normal_literal(q, cls)
    same = keys.where(cls.isNotNull() & (F.col("key") == norm)).select(F.col("key").alias("k"), F.lit(1.0).alias("score"))
    under = keys.where((cls == "path") & (F.col("cls") == "path") & F.col("key").startswith(F.concat(norm, F.lit("/")))).select(F.col("key").alias("k"), F.lit(0.8).alias("score"))
    x = same.unionByName(under)
    return occ.join(x, occ["key"] == x["k"]).select(F.col("node").alias("i"), "score")


def anchor_seeds(nodes: DataFrame, query: str) -> DataFrame:
    q = F.lit(query)
    norm = normal_literal(q, literal_class(q))
    route = F.regexp_replace("name", r"^\S+ ", "")
    return nodes.where((F.col("kind") == "anchor") & (literal_class(q) == "path") & ((route == norm) | F.startswith(route, F.concat(norm, F.lit("/"))))).select("i", F.lit(0.9).alias("score"))


def query_terms(query: str) -> list[str]:
    return [t.lower() for t in query.split() if len(t) > 1]


def name_seeds(nodes: DataFrame, query: str) -> DataFrame:
    keys = name_keys(_symbols(nodes).select(F.col("i").alias("idx"), "file", "name"))
    return keys.where(F.col("key").isin(*query_terms(query))).select(F.col("idx").alias("i"), F.lit(1.0).alias("score"))


def substring_seeds(nodes: DataFrame, query: str) -> DataFrame:
    low = F.lower("name")
    terms = F.array(*map(F.lit, query_terms(query))).cast("array<string>")
    score = F.array_max(F.transform(terms, lambda t: F.when(low == t, 1.0).when(F.startswith(low, t), 0.8).when(F.contains(low, t), 0.5)))
    return _symbols(nodes).withColumn("score", score).where("score is not null").select("i", "score")


def term_seeds(nodes: DataFrame, query: str) -> DataFrame:
    return _symbols(nodes).where(same_terms(F.lit(query), F.col("name"))).select("i", F.lit(0.7).alias("score"))


def file_seeds(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.where((F.col("kind") == "file") & ((F.col("file") == query) | F.col("file").endswith("/" + query))).select("i", F.lit(1.0).alias("score"))


def resolve(nodes: DataFrame, keys: DataFrame, occ: DataFrame, query: str, **scope) -> DataFrame:
    """i, score of at most MAX_SEEDS seeds, best first, then by file. Substrings are tried only if nothing else is
    found, equal terms only if those find nothing either; file paths always count."""
    query = query.strip()
    allowed = nodes.where(in_scope(F.col("file"), F.col("lang"), F.col("kind"), **scope))
    ok = lambda x: x.join(allowed.select(F.col("i").alias("a_i")), F.col("i") == F.col("a_i"), "left_semi")
    found = ok(literal_seeds(keys, occ, query).unionByName(anchor_seeds(nodes, query)).unionByName(name_seeds(nodes, query)))
    for stage in (substring_seeds, term_seeds):
        if found.head(1):
            break
        found = ok(stage(nodes, query))
    found = found.unionByName(ok(file_seeds(nodes, query))).groupBy("i").agg(F.max("score").alias("score"))
    place = nodes.select(F.col("i").alias("n_i"), "file")
    return found.join(place, found["i"] == place["n_i"]).orderBy(F.desc("score"), "file", "i").limit(fixed.MAX_SEEDS).select("i", "score")


def suggestions(nodes: DataFrame, query: str, most: int = 5, **scope) -> DataFrame:
    """i, name, file, score of the symbols most like a query that found nothing. Each name is scored once, spread over all
    cores: names are short, so that few files and few partitions hold many. The best symbols have the best `most` names."""
    x = _symbols(nodes).where(in_scope(F.col("file"), F.col("lang"), F.col("kind"), **scope))
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    told = x.select(F.col("name").alias("t_name")).where("t_name is not null").distinct().repartition(cores, "t_name")
    scored = told.select("t_name", similarity(trimmed(F.lit(query)), F.col("t_name")).alias("score"))
    # the threshold comes after the limit, or it would be pushed below the score and compute it twice
    best = scored.orderBy(F.desc("score"), "t_name").limit(most).where(F.col("score") >= fixed.SUGGEST_AT)
    found = x.join(F.broadcast(best), x["name"] == best["t_name"])  # `most` rows
    return found.orderBy(F.desc("score"), "name", "file", "i").limit(most).select("i", "name", "file", "score")
