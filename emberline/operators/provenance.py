"""Who changed what: owners whose mutations lead from a file's state before to that after."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABSENT = "\0absent"


def transition_owners(journal: DataFrame, changes: DataFrame) -> DataFrame:
    """file, owners (sorted array). journal: file, before_sha, after_sha, owner, at, commit_order, tool_call_id; changes: file,
    before_sha, after_sha. Records are replayed in order, one file's in one task: a journal keeps a bounded number per owner."""
    sha = lambda c: F.coalesce(F.col(c), F.lit(ABSENT)).alias(c)
    j = journal.select("file", sha("before_sha"), sha("after_sha"), "owner", F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("commit_order").cast("long"), F.lit(2**53)).alias("commit_order"), "tool_call_id")
    c = changes.select(F.col("file").alias("c_file"), sha("before_sha").alias("c_before"), sha("after_sha").alias("c_after"))
    x = c.join(j, c["c_file"] == j["file"], "left").drop("file").withColumnRenamed("c_file", "file")

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        states: dict[str, set] = {first.c_before: set()}
        for r in rows[rows.owner.notna()].sort_values(["at", "owner", "commit_order", "tool_call_id"]).itertuples():
            if r.before_sha in states:
                states.setdefault(r.after_sha, set()).update(states[r.before_sha] | {r.owner})
        return pd.DataFrame({"file": [first.file], "owners": [sorted(states.get(first.c_after, ()))]})

    return x.groupBy("file").applyInPandas(replay, "file string, owners array<string>")


def kinds(owners: DataFrame, current: str) -> DataFrame:
    n = F.size("owners")
    kind = F.when(n == 0, "unattributed").when(n > 1, "mixed").when(F.col("owners")[0] == current, "current-session").otherwise("other-session")
    return owners.select("file", kind.alias("kind"))


def overall(kind_table: DataFrame) -> DataFrame:
    """One row: kind."""
    x = kind_table.agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("k"))
    return x.select(F.when(F.col("n") == 0, "unattributed").when(F.col("n") == 1, F.col("k")).otherwise("mixed").alias("kind"))


def delivery(kind):
    return F.when(kind == "other-session", "next-prompt").otherwise("steer")
