from __future__ import annotations

import os
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(got: DataFrame | pd.DataFrame, expected: pd.DataFrame) -> None:
    """The same rows in any order, columns by name."""
    got = got if isinstance(got, pd.DataFrame) else got.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: df[columns].sort_values(columns, kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(rows(got), rows(expected), check_dtype=False, check_exact=True)
