import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(table):
    """Sorted rows of an Arrow table, columns by name."""
    names = sorted(table.column_names)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="session")
def agrees():
    """Asserts that a DataFrame has exactly the rows that SQL gives over the same tables."""

    def check(df, sql, sf=SF, **views):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        for name, path in views.items():
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
        assert rows_of(df.toArrow()) == rows_of(con.execute(sql).to_arrow_table())

    return check
