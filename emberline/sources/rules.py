"""Users' route rules from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "rules array<struct<id:string,pattern:string,methods:string,langs:array<string>,kind:string>>"


def parse_rules(docs: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """id, pattern, methods, langs, kind, valid of the rules in JSON documents (doc). A rule needs a pattern, methods and
    languages; a document that can't be read has none."""
    rows = docs.select(F.explode(F.from_json("doc", SCHEMA)["rules"]).alias("r")).select("r.*")
    x = rows.withColumn("valid", F.col("pattern").isNotNull() & F.col("methods").isNotNull() & F.col("langs").isNotNull())
    return x if keep_invalid else x.where("valid")


def as_anchor_rules(parsed: DataFrame) -> tuple:
    """Parsed rules in the form that extraction takes. A rules file is short, so it may be collected."""
    return tuple((r["id"] or r["pattern"], tuple(r["langs"]), r["pattern"], r["methods"], "", "") for r in parsed.where("valid").collect())
