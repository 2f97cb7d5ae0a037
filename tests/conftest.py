import os
import sys
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A database with the tables of one size."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    return order, sorted((tuple(_plain(dict(zip(names, r, strict=True))[n]) for n in order) for r in found.fetchall()), key=repr)


def _plain(v):
    return round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
