"""A corpus from documents: language ID, exact dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. A stage that drops rows decides on each row by its own number (see common.numbered), carries only
numbers, ids and digests until then, and reads the rows that stay from docs, which isn't shuffled for that.

Defined cases: null text is empty; text without letters has no language and goes; of equal texts the row of the smallest
doc_id stays, of rows that share that too the first in the files, and so it is in groups of near-duplicates, where a
null doc_id comes last; a row with a null doc_id and a unique text stays; rows of one doc_id with different texts are judged
each; texts of any length are read whole; further columns are kept up to packing; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import credentials, exact_dedup, langid, neardup, packing
from emberline.llm.common import ROW, cut, numbered, only, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    rows = numbered(docs)
    told = langid.identify(langid.document_items(rows, ROW), carry=(ROW,))
    return only(rows, ROW, told.where("kept").select(ROW)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, of the smallest doc_id."""
    rows = numbered(docs)
    told = exact_dedup.exact_dedup(rows, row=ROW).where("kept")
    first = told.groupBy("text_sha256").agg(F.min(ROW).alias(ROW))
    return only(rows, ROW, first.select(ROW)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, of the smallest doc_id."""
    rows = numbered(docs)
    told = cut(neardup.near_duplicates(rows, row=ROW).where("kept").select(ROW, "group"), "near")
    first = told.where("group is not null").groupBy("group").agg(F.min(ROW).alias(ROW)).select(ROW)
    return only(rows, ROW, first.unionByName(told.where("group is null").select(ROW))).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; drops nothing."""
    return credentials.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", pack)]

#: Language scores and packing can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
