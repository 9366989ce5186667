"""Co-change: which files move together in commits, and how warm that still is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import pair_score, recency


def sized(commits: DataFrame) -> DataFrame:
    """Distinct (commit, ts, file) of commits with 2 to MAX_FILES_PER_COMMIT files. The gate bounds the self-join."""
    rows = commits.groupBy("commit", "file").agg(F.max("ts").alias("ts"))
    ok = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, fixed.MAX_FILES_PER_COMMIT)).select(F.col("commit").alias("k_commit"))
    return rows.join(ok, rows["commit"] == ok["k_commit"], "left_semi")


def last_commits(commits: DataFrame, cap: int = fixed.MAX_COMMITS) -> DataFrame:
    """The rows of the last `cap` commits: the commits are few columns, ordered by a bounded top-k."""
    last = commits.groupBy("commit").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("commit")).limit(cap).select(F.col("commit").alias("k_commit"))
    return commits.join(last, commits["commit"] == last["k_commit"], "left_semi")


def pairs(commits: DataFrame) -> DataFrame:
    """a < b, n, solo_a, solo_b, w, last_ts of pairs with MIN_SHARED commits or more."""
    rows = sized(commits)
    solo = rows.groupBy("file").agg(F.count("*").alias("solo"))
    left, right = rows.select("commit", F.col("file").alias("a"), "ts"), rows.select(F.col("commit").alias("r_commit"), F.col("file").alias("b"))
    n = left.join(right, (left["commit"] == right["r_commit"]) & (left["a"] < right["b"])).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where(F.col("n") >= fixed.MIN_SHARED)
    x = n.join(solo.toDF("s_a", "solo_a"), F.col("a") == F.col("s_a")).join(solo.toDF("s_b", "solo_b"), F.col("b") == F.col("s_b"))
    return x.withColumn("w", pair_score(F.col("n"), F.col("solo_a"), F.col("solo_b"))).where("w > 0").select("a", "b", "n", "solo_a", "solo_b", "w", "last_ts")


def age_days(ts, now):
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(ts.cast("timestamp"))) / 86400.0)


def effective(w, ts, now):
    return w * recency(age_days(ts, now))


def kept(scored: DataFrame, now, cap: int = fixed.MAX_PARTNERS) -> DataFrame:
    """Pairs that are among the cap warmest of either file."""
    x = scored.withColumn("eff", effective(F.col("w"), F.col("last_ts"), now))
    both = x.select(F.col("a").alias("file"), "a", "b", "eff").unionByName(x.select(F.col("b").alias("file"), "a", "b", "eff"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("eff"), "a", "b"))
    best = both.withColumn("rank", rank).where(F.col("rank") <= cap).select(F.col("a").alias("k_a"), F.col("b").alias("k_b")).distinct()
    return scored.join(best, (scored["a"] == best["k_a"]) & (scored["b"] == best["k_b"]), "left_semi")


def both_ways(scored: DataFrame) -> DataFrame:
    """file, partner, w, last_ts in both directions."""
    return scored.select(F.col("a").alias("file"), F.col("b").alias("partner"), "w", "last_ts").unionByName(scored.select(F.col("b").alias("file"), F.col("a").alias("partner"), "w", "last_ts"))


def partner_seeds(history: DataFrame, seeds: DataFrame, now) -> DataFrame:
    """partner, w: the warmest tie of each partner of the seed files that is no seed itself. seeds: file."""
    s = seeds.select(F.col("file").alias("s_file")).distinct()
    x = history.join(s, history["file"] == s["s_file"], "left_semi").withColumn("eff", effective(F.col("w"), F.col("last_ts"), now)).where("eff > 1e-6")
    return x.join(s, x["partner"] == s["s_file"], "left_anti").groupBy("partner").agg(F.max("eff").alias("w"))
