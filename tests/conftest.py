import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows):
    """Rows as a sorted list of comparable texts."""

    def one(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Hold a query against its DuckDB form, column by column."""

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        found = duck.execute(sql)
        theirs = [d[0] for d in found.description]
        assert sorted(theirs) == names
        at = [theirs.index(n) for n in names]
        assert normal(tuple(r) for r in df.select(*names).collect()) == normal(tuple(r[i] for i in at) for r in found.fetchall())

    return check
