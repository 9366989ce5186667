import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("emberline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return "~" if value is None else str(value)


def same_rows(df, sql: str, tables: str = SF) -> None:
    """df has the columns and, in any order, the rows of the SQL over the tables."""
    import duckdb

    con = duckdb.connect()
    for f in Path(tables).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted(tuple(shown(r[k]) for k in at) for r in cursor.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == want


@pytest.fixture(scope="session")
def check_rows():
    return same_rows
