"""What git prints, as rows. The output is given as text; nothing here runs a command."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relative(path, prefix: str):
    """path below the prefix of a subdirectory; null if it lies outside."""
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))) if prefix else path


def status(output: DataFrame, prefix: str = "") -> DataFrame:
    """code, file, odd of `status --porcelain=v1 -z --no-renames` (column text). odd says the listing can't be trusted."""
    x = output.select(F.explode(F.split("text", "\\x00")).alias("f")).where("f <> ''")
    code = F.left("f", F.lit(2))
    file = relative(F.substr("f", F.lit(4)), prefix)
    odd = (F.length("f") < 4) | file.isNull() | ~code.rlike("^[ MARCUD?!]{2}$")
    return x.select(F.when(F.length("f") >= 4, code).alias("code"), F.when(F.length("f") >= 4, file).alias("file"), odd.alias("odd"))


def log(lines: DataFrame, prefix: str = "") -> DataFrame:
    """commit, ts, file of `log --numstat --no-renames --format=%H%x00%ct`: lines (n, line) in order. A file belongs to the
    last commit line before it; commits are told apart by the number of that line."""
    from pyspark.sql import Window

    head = F.contains("line", F.lit("\x00"))
    x = lines.withColumn("head", head)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a log of at most MAX_COMMITS commits
    x = x.withColumn("commit", F.last(F.when(F.col("head"), F.split_part("line", F.lit("\x00"), F.lit(1))), ignorenulls=True).over(w)).withColumn("ts", F.last(F.when(F.col("head"), F.split_part("line", F.lit("\x00"), F.lit(2)).cast("long")), ignorenulls=True).over(w))
    parts = F.split("line", "\t")
    return x.where(~F.col("head") & (F.size(parts) >= 3)).select("commit", F.timestamp_seconds("ts").alias("ts"), relative(F.element_at(parts, 3), prefix).alias("file")).where("file is not null")
