from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled",
            "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://"
            + str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of an SQL text over the tables of a folder, as sorted tuples by column name."""
    import duckdb

    def run(sql: str, folder: str = TESTDATA):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con.sql(sql).df()

    return run


@pytest.fixture(scope="session")
def same(oracle):
    def check(df, sql: str, folder: str = TESTDATA):
        import pandas as pd

        a, b = df.toPandas(), oracle(sql, folder)
        assert sorted(a.columns) == sorted(b.columns)

        def plain(v):
            """Numbers as floats where that is exact: a column of whole numbers with nulls comes as floats from one side only."""
            if v is None or v is pd.NA or v != v:
                return None
            v = v.item() if hasattr(v, "item") else v
            return float(v) if isinstance(v, float) or type(v) is int and abs(v) < 2**53 else v

        rows = lambda x: sorted(repr([plain(v) for v in r]) for r in x[sorted(x.columns)].astype(object).values.tolist())
        assert rows(a) == rows(b)

    return check
