"""Facts and histories kept between runs, as tables keyed by what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1


def save(df: DataFrame, path: str, key: str) -> None:
    """Replaces the table at path; key says what it is valid for. The new rows are computed before the old ones go."""
    df.withColumn("__key", F.lit(f"{VERSION}:{key}")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table at path, if it is there and valid for key; an unreadable one counts as missing."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "__key" not in df.columns:
        return None
    good = df.where(F.col("__key") == f"{VERSION}:{key}").drop("__key")
    return good if good.head(1) else None


def spill(items: DataFrame, path: str) -> None:
    """All lines of a truncated listing, in order, as text. items: rank, line."""
    items.repartitionByRange("rank").sortWithinPartitions("rank").select("line").write.mode("overwrite").text(path)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per line; torn lines are left out."""
    return spark.read.schema(schema + ", __torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__torn").json(path).where("__torn is null").drop("__torn")
