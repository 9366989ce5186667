"""Shared literals: keys, their specificity and weight, occurrences, and the edges between what shares them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import literal_class, normal_literal


def occurrences(sites: DataFrame) -> DataFrame:
    """The first site of each key in each file. sites: file, line, text, node, pos (an order of sites)."""
    told = sites.withColumn("cls", literal_class(F.col("text"))).where("cls is not null").withColumn("key", normal_literal(F.col("text"), F.col("cls")))
    return told.groupBy("key", "file").agg(F.min_by(F.struct("cls", "node", "line", "pos"), F.col("pos")).alias("s")).select("key", "file", "s.*")


def keys(occ: DataFrame) -> DataFrame:
    """key, cls, df, spec and w of every key; the number of occurrences is one scalar."""
    total = occ.agg(F.count("*").cast("double").alias("total"))
    x = occ.groupBy("key").agg(F.min_by("cls", "pos").alias("cls"), F.count("*").alias("df")).crossJoin(F.broadcast(total))
    spec = F.least(F.lit(1.0), F.log(F.col("total") / F.col("df")) / F.log(F.greatest(F.col("total"), F.lit(2.0))))
    base = F.when(F.col("cls") == "path", fixed.LITERAL_BASE["path"]).when(F.col("cls") == "env", fixed.LITERAL_BASE["env"]).otherwise(fixed.LITERAL_BASE["word"])
    return x.select("key", "cls", "df", spec.alias("spec")).withColumn("w", base * (0.25 + 0.75 * F.col("spec")) / F.greatest(F.lit(1.0), F.col("df") / 6))


def edges(occ: DataFrame, key_table: DataFrame) -> DataFrame:
    """a < b and the largest weight over their keys. The gate on df comes before the self-join and bounds it."""
    gated = key_table.where(F.col("df").between(2, fixed.MAX_DF)).select(F.col("key").alias("k_key"), "w")
    member = occ.join(gated, occ["key"] == gated["k_key"]).select("key", "node", "w")
    left, right = member.toDF("key", "a", "w"), member.select(F.col("key").alias("r_key"), F.col("node").alias("b"))
    return left.join(right, (left["key"] == right["r_key"]) & (left["a"] < right["b"])).groupBy("a", "b").agg(F.max("w").alias("w"))


def lookup(occ: DataFrame, cap: int = fixed.LOOKUP_CAP) -> DataFrame:
    """Occurrences kept for look-ups: the first `cap` of a key."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    return occ.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
