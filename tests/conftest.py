import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(table):
    """Comparable rows of an Arrow table: columns by name, numbers to six figures."""

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return "~"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.fixture(scope="session")
def same(spark, duck, data):
    def check(query, sql):
        got, want = rows_of(query(spark, data).toArrow()), rows_of(duck.execute(sql).to_arrow_table())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
