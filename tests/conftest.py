import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir: str, sql: str):
    """Columns and rows of a statement over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def same_rows(df, columns, rows) -> None:
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    assert mine == theirs
