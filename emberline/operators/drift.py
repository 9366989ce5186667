"""Drift against a stored baseline: what changed in meaning, what that warms beyond what is known, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import fixed
from emberline.functions.text import decayed, is_test_scope, lookup


def fingerprint(facts: DataFrame) -> DataFrame:
    """file, semantics: a digest of a file's facts without their lines. facts: file, kind, value; white space folds."""
    value = F.regexp_replace("value", r"\s+", " ")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("kind", value.alias("value")))), lambda s: F.to_json(s))
    return facts.groupBy("file").agg(F.sha1(F.array_join(rows, "\n")).alias("semantics"))


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """file, status of what isn't as it was: added, deleted, semantic or format. Both: file, sha, semantics."""
    b = baseline.toDF("b_file", "b_sha", "b_semantics")
    x = current.join(b, current["file"] == b["b_file"], "full_outer")
    status = F.when(F.col("b_file").isNull(), "added").when(F.col("file").isNull(), "deleted").when(~F.col("semantics").eqNullSafe(F.col("b_semantics")), "semantic").when(F.col("sha") != F.col("b_sha"), "format")
    return x.select(F.coalesce("file", "b_file").alias("file"), status.alias("status")).where("status is not null")


def anchor_changes(before: DataFrame, now: DataFrame, moved: DataFrame) -> DataFrame:
    """id, file, change, evidenced: routes that came or went; evidence is a change of the file that carries them.
    before, now: id, file; moved: file."""
    new = now.join(before.select(F.col("id").alias("b_id")), F.col("id") == F.col("b_id"), "left_anti").select("id", "file", F.lit("added").alias("change"))
    gone = before.join(now.select(F.col("id").alias("n_id")), F.col("id") == F.col("n_id"), "left_anti").select("id", "file", F.lit("removed").alias("change"))
    x = new.unionByName(gone)
    m = moved.select(F.col("file").alias("m_file")).distinct()
    return x.join(m, x["file"] == m["m_file"], "left").select("id", "file", "change", F.col("m_file").isNotNull().alias("evidenced"))


def channel(reasons: Column) -> Column:
    """The strongest prior among reasons; UNKNOWN_CHANNEL without any."""
    each = F.transform(reasons, lambda r: F.coalesce(lookup(fixed.CHANNEL_WEIGHT, r), F.lit(fixed.UNKNOWN_CHANNEL)))
    return F.coalesce(F.array_max(each), F.lit(fixed.UNKNOWN_CHANNEL))


def cooled(memory: DataFrame, now: Column, cap: int | None = fixed.MEMORY_CAP) -> DataFrame:
    """key, m: what the memory still holds at now, the strongest `cap` entries; all of them if it is None. memory: key, m, t."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 3.6e9
    x = memory.select("key", decayed(F.col("m"), hours).alias("m")).where("m > 1e-9")
    return x if cap is None else strongest(x, cap)


def strongest(entries: DataFrame, cap: int = fixed.MEMORY_CAP) -> DataFrame:
    """The `cap` entries (key, m) that hold most."""
    return entries.orderBy(F.desc("m"), "key").limit(cap)


def surprise(warmed: DataFrame, memory: DataFrame, known: DataFrame) -> DataFrame:
    """key, file, mass, held, delta of nodes outside known files. warmed: key, file, m, r; memory: key, m; known: file."""
    x = warmed.join(known.select(F.col("file").alias("k_file")).distinct(), F.col("file") == F.col("k_file"), "left_anti")
    x = x.join(memory.toDF("h_key", "held"), F.col("key") == F.col("h_key"), "left")
    mass = F.col("m") * channel(F.col("r"))
    return x.select("key", "file", mass.alias("mass"), F.coalesce("held", F.lit(0.0)).alias("held")).withColumn("delta", F.greatest(F.col("mass") - F.col("held"), F.lit(0.0)))


def file_surprise(deltas: DataFrame) -> DataFrame:
    return deltas.where("delta > 1e-9").groupBy("file").agg(F.sum("delta").alias("surprise"))


def verdict(changes: DataFrame, deleted: DataFrame, total: DataFrame, newly_implicit: int = 0, armed: bool = True, degraded: bool = False, threshold: float = fixed.STEER_AT) -> DataFrame:
    """One row: structural, warmth, red, armed. changes as of anchor_changes; deleted: file; total: surprise."""
    a = changes.agg(F.count_if((F.col("change") == "added") & F.col("evidenced")).alias("added"), F.count_if((F.col("change") == "removed") & F.col("evidenced")).alias("removed"))
    d = deleted.agg(F.count_if(~is_test_scope(F.col("file"))).alias("gone"))
    s = total.agg(F.coalesce(F.sum("surprise"), F.lit(0.0)).alias("s"))
    x = a.crossJoin(d).crossJoin(s)  # three rows of one row each
    structural = (F.col("added") - newly_implicit > 0) | ((F.col("removed") > 0) & (not degraded)) | (F.col("gone") > 0)
    warmth = F.lit(armed) & (F.col("s") >= threshold)
    x = x.select("s", structural.alias("structural"), warmth.alias("warmth")).withColumn("red", F.col("structural") | F.col("warmth"))
    return x.withColumn("armed", ~F.col("red") & (F.lit(armed) | (F.col("s") <= threshold * fixed.REARM_SHARE)))


def charge(memory: DataFrame, deltas: DataFrame, red: bool) -> DataFrame:
    """key, m after a sync: a red one raises each covered node to its mass."""
    if not red:
        return memory
    x = memory.select("key", "m").unionByName(deltas.select("key", F.col("mass").alias("m")))
    return x.groupBy("key").agg(F.max("m").alias("m"))


def latch(steps: DataFrame, threshold: float = fixed.STEER_AT) -> DataFrame:
    """key, n, red, armed over a key's syncs in order (key, n, structural, s), by a fold over each key's ordered rows; a key
    has as many rows as it had syncs."""
    rows = F.sort_array(F.collect_list(F.struct("n", "structural", "s")))
    start = F.struct(F.lit(True).alias("armed"), F.array().cast("array<struct<n:bigint,red:boolean,armed:boolean>>").alias("out"))

    def step(a, x):
        red = x["structural"] | (a["armed"] & (x["s"] >= threshold))
        armed = ~red & (a["armed"] | (x["s"] <= threshold * fixed.REARM_SHARE))
        return F.struct(armed.alias("armed"), F.concat(a["out"], F.array(F.struct(x["n"].alias("n"), red.alias("red"), armed.alias("armed")))).alias("out"))

    return steps.select("key", F.col("n").cast("long"), "structural", "s").groupBy("key").agg(rows.alias("rows")).select("key", F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("key", "x.*")


def attended(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of files whose scope was observed. scopes: scope."""
    from emberline.functions.text import sync_scope

    return files.join(scopes.select(F.col("scope").alias("o_scope")).distinct(), sync_scope(F.col("file")) == F.col("o_scope"), "left_semi")


def recent_journal(journal: DataFrame, now: Column, cap: int = fixed.JOURNAL_CAP, days: int = fixed.JOURNAL_DAYS) -> DataFrame:
    """Each owner's last `cap` real mutations within `days`. journal: owner, file, before_sha, after_sha, at, ..."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 8.64e10
    x = journal.where(~F.col("before_sha").eqNullSafe(F.col("after_sha")) & (age <= days))
    order = [c for c in ("commit_order", "file") if c in journal.columns]
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("at"), *(F.desc(c) for c in order)))).where(F.col("rank") <= cap).drop("rank")
