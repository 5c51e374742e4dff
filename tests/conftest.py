import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(df):
    """Rows of a pandas frame in a form that compares: columns by name, numbers by value, nulls alike."""

    def plain(v):
        if v is None or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else round(v, 9)
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)
