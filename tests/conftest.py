import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Checks a query against its SQL twin on a folder of tables."""
    import os

    import duckdb

    def run(query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
        df = query(spark, folder)
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.execute(sql).description]
        assert sorted(names) == sorted(df.columns)

        def norm(rows):
            fix = lambda v: round(v, 6) if isinstance(v, float) else v
            return sorted((tuple(fix(v) for v in r) for r in rows), key=repr)

        assert norm(tuple(r[n] for n in names) for r in df.collect()) == norm(want)

    return run
