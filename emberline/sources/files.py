"""Files: listing, what is left out and why, versions, incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import is_generated, is_junk, is_supported


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, size, mtime, sha, text of the listed files below root, in any store Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/") + "/"
    file = F.regexp_replace("path", "^(?:[a-z]+:/*)?(?=/)", "")
    file = F.replace(file, F.lit(top.removeprefix("file://")), F.lit(""))
    x = files.select(file.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha"), F.col("content").cast("string").alias("text"))
    return x.where(is_supported(F.col("file")) & ~is_junk(F.col("file")))


def listed(files: DataFrame, cap: int = fixed.MAX_FILES) -> DataFrame:
    """The first `cap` supported files in order; the cap is the listing's own."""
    return files.where(is_supported(F.col("file")) & ~is_junk(F.col("file"))).orderBy("file").limit(cap)


def nested_owner(files: DataFrame, roots: DataFrame) -> DataFrame:
    """file, owner, listed: the innermost nested root that holds a file, and whether its files are listed: all roots on the
    way must be enrolled. roots: root, enrolled. Every prefix of a path is looked up, so no range join is needed."""
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    x = files.select("file", F.explode(prefixes).alias("prefix"))
    hit = x.join(roots, x["prefix"] == roots["root"]).groupBy("file").agg(F.max_by("root", F.length("root")).alias("owner"), F.bool_and("enrolled").alias("ok"))
    return files.join(hit.toDF("h_file", "owner", "ok"), F.col("file") == F.col("h_file"), "left").select("file", "owner", F.coalesce("ok", F.lit(True)).alias("listed"))


def coverage(files: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """files with status: unreadable, oversized, generated or ok."""
    status = F.when(F.col("text").isNull(), "unreadable").when(F.octet_length("text") > max_bytes, "oversized").when(is_generated(F.col("file"), F.col("text")), "generated").otherwise("ok")
    return files.withColumn("status", status)


def version(files: DataFrame) -> DataFrame:
    """One row: 12 hex digits that stand for all files and their contents. files: file, sha; a repository's listing, whose
    size MAX_FILES bounds."""
    return files.agg(F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "file", "sha"))), "\n")), 1, 12).alias("version"))


def same_stat(a_size, a_mtime, b_size, b_mtime):
    return (a_size == b_size) & (F.abs(a_mtime - b_mtime) < 1e-6)


def refresh(cached: DataFrame, current: DataFrame, extract) -> DataFrame:
    """Facts of current files: those of unchanged content are taken from cached, the others extracted anew.
    cached: file, sha, ...; current: file, sha, text; extract: (files) -> facts with cached's columns."""
    keys = current.select(F.col("file").alias("c_file"), F.col("sha").alias("c_sha"))
    kept = cached.join(keys, (cached["file"] == keys["c_file"]) & (cached["sha"] == keys["c_sha"]), "left_semi")
    known = cached.select(F.col("file").alias("k_file"), F.col("sha").alias("k_sha")).distinct()
    dirty = current.join(known, (current["file"] == known["k_file"]) & (current["sha"] == known["k_sha"]), "left_anti")
    return kept.unionByName(extract(dirty))
