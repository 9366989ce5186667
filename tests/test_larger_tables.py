"""Queries over tables larger than those at hand: copies with shifted keys."""

import duckdb
import pytest
from emberline.functions import fixed
from emberline.functions.text import similarity
from emberline.operators.seeds import suggestions
from emberline.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """Events of so many users that the memory of heat has 5,000 entries, more than a sync keeps."""
    folder = tmp_path_factory.mktemp("many_users")
    duckdb.sql(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id + k * 1503 AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(200) AS r(k)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def same_as_sql(spark, check_rows, name, tables):
    check_rows(catalog.queries()[name](spark, tables), catalog.oracles()[name], tables)


def test_surprise_beyond_the_cap(spark, check_rows, many_users):
    same_as_sql(spark, check_rows, "d10_surprise", many_users)


def test_charge_beyond_the_cap(spark, check_rows, many_users):
    same_as_sql(spark, check_rows, "h7_ledger_charge", many_users)


@pytest.fixture(scope="module")
def unnamed(tmp_path_factory):
    """Events some of which have no type, some no user."""
    folder = tmp_path_factory.mktemp("unnamed")
    duckdb.sql(f"COPY (SELECT event_id, ts, CASE WHEN event_id % 9 <> 4 THEN user_id END AS user_id, CASE WHEN event_id % 5 <> 3 THEN event_type END AS event_type, value, props FROM '{SF}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["h7_ledger_charge", "d10_surprise", "d11_channel_prior", "e10_memory_cap"])
def test_memory_of_events_without_type_or_user(spark, check_rows, unnamed, name):
    same_as_sql(spark, check_rows, name, unnamed)


#: Of the expression of terms; its constant parts are folded.
SPLIT = "[^a-z0-9]+"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_computes_terms_once(spark):
    """Where terms occur again in lambdas over bigrams, they are computed anew for each bigram, or each two."""
    names = spark.range(9).select(F.concat(F.lit("loadUser"), F.col("id").cast("string")).alias("name"))
    assert optimized(names.select(similarity(F.lit("load the users"), F.col("name")).alias("score"))).count(SPLIT) == 1


def test_suggestions_compute_terms_for_the_filter_and_the_score(spark):
    nodes = spark.range(9).selectExpr("id AS i", "'loadUser' || id AS name", "'a.go' AS file", "'function' AS kind", "'Go' AS lang")
    assert optimized(suggestions(nodes, "load the users")).count(SPLIT) <= 2


def test_suggestions_score_each_name_once(spark):
    """Not once a row, nor again for the threshold, and with the rows of a score for each row."""
    names = ["loadUsers", None, "theUser", "loadUsers", "storeUser", "load_user", "the.loadUser"]
    nodes = spark.createDataFrame([(i, n, f"{i % 2}.go", "function", "Go") for i, n in enumerate(names * 3)], "i long, name string, file string, kind string, lang string")
    found = suggestions(nodes, "load the users", 7)
    assert optimized(found).count(SPLIT) == 1
    plan = optimized(found)
    assert plan.index("Aggregate [") > plan.index(SPLIT)  # below the score
    plain = nodes.withColumn("score", similarity(F.lit("load the users"), F.col("name"))).where(F.col("score") >= fixed.SUGGEST_AT)
    rows = plain.orderBy(F.desc("score"), "name", "file", "i").limit(7).select("i", "name", "file", "score").collect()
    assert found.collect() == rows and len(rows) == 7
